"""Helpers shared by the operators: tables in the shared folder, checked
broadcasts, readers, and word tokens as byte ranges."""

from __future__ import annotations

import gc
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of values of a table that may be broadcast; beyond either the
#: join is a shuffled one. A million rows take about 100 MB in an executor.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Environment of Python workers: freed arrays go back to the system, as workers outlive tasks.
WORKER = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows and bytes handed to a Python worker at once, where the session has Spark's defaults: texts are long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    for key, value in WORKER.items():
        env.setdefault(key, value)
    for key, value in ARROW.items():
        if spark.conf.get(key, None) in (None, "10000", "-1", str(2**63 - 1)):  # Spark's defaults
            spark.conf.set(key, value)
    return spark


_cached: dict = {}


def cached(name: str | None = None, make=None):
    """One object that outlives tasks in a Python worker. Asking for another
    name, or for none, lets the old one go: workers serve all operators."""
    if name not in _cached:
        _cached.clear()
        if name is not None:
            _cached[name] = make()
    return _cached.get(name)


class Seen(dict):
    """What ``make`` gave for keys of at most 64 characters or bytes met lately.

    ``age`` keeps the last ``limit`` keys and as many before them: what is met
    again in time stays."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= 64:
            self[key] = made
        return made

    def age(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session (tests)
    gets one of this machine; a cluster has to name its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints/rasterloom"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder.

    A written table cuts lineage: an executor that is lost later costs only
    the tasks it ran. ``drop`` removes tables that no later step reads; what
    the returned DataFrame reads has to stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = ready(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def table(self, df: DataFrame, path: str | None = None, rows: int | None = None, per_file: int = 250_000) -> DataFrame:
        """``df`` written and read again; with a bound of its rows known, in no more files than they need."""
        path = path or self.path()
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_file)))
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        delete(self.spark, *(t._scratch_path for t in tables))


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders of the shared store, if there."""
    sc = spark.sparkContext
    for path in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows and their bytes prove small, else as it is.

    ``df`` should be a written table: it is read for this."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if k in ("string", "binary") else F.coalesce(F.size(c) * 16, F.lit(0)) if k in ("array", "map") else F.lit(8) for c, k in kinds.items()), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def sweep(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove shuffle files that nothing refers to
    any more: it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings for the jobs run inside the block."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ascii_lower(text):
    """Column: A-Z to lower case, all other characters unchanged; null is empty."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), up, up.lower())


def fresh_name(df: DataFrame, want: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want
