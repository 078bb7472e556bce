"""Every registered codec query with SQL gives that SQL's rows."""

import os

import pytest

from rasterloom import queries

SF = "/root/testdata/sf0.001"
TABLES = ("part", "embeddings", "lineitem", "conversations", "events")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_whole_planes(spark):
    """Outputs grow with the table: every block row, sample row and pixel row takes part."""
    from rasterloom.sources import derived

    blocks = derived.blocks(spark, SF).filter("k = 0")
    w, h = blocks.selectExpr("max(gx) + 1", "max(gy) + 1").first()
    assert queries.QUERIES["smooth_downsample_whole"](spark, SF).count() == w * 4 * h * 4
    moved = queries.QUERIES["transform_flip_v_whole"](spark, SF).filter("k = 0").select("id", "gy")
    assert blocks.join(moved.withColumnRenamed("gy", "to"), "id").filter(f"gy < {h} - 1 AND to <> {h} - 2 - gy").isEmpty()
    assert queries.QUERIES["trim_blocks_whole"](spark, SF).selectExpr("max(gy) + 1").first()[0] == (h * 8 - 1) // 16 * 2
    rows = derived.pixels(spark, SF).selectExpr("max(y) + 1").first()[0]
    assert queries.QUERIES["pad_edges_whole"](spark, SF).selectExpr("count(distinct y)").first()[0] == -(-rows // 8) * 8


def test_smooth_downsample_of_a_ragged_plane(spark, tmp_path):
    """The last row of blocks ends early: no cell is made of neighbours alone."""
    import duckdb

    rows = [(i, [float((i * 64 + k) * 37 % 101 - 50) / 100 for k in range(64)]) for i in range(27)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT y, x, v FROM ({queries.SQL['smooth_downsample_whole']})").fetchall()
    assert sorted(map(tuple, queries.QUERIES["smooth_downsample_whole"](spark, str(tmp_path)).select("y", "x", "v").collect())) == sorted(want)
