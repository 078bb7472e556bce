"""Operator 4, chat formatting by quotation linking.

Every message is split into runs of lines of one quote level (the number of
leading ">"). Quoted runs are hashed after normalisation (lower case, white
space collapsed) and joined to the messages whose own words they repeat: units
of an original are its whole unquoted text, its unquoted runs and their lines.
A quote that isn't found as a run is looked up by its first line. Within the
conversation the latest earlier message wins; else the smallest (conversation,
turn) anywhere. Without a found quote of the own conversation a message replies
to the turn before it.

The result is the conversation without quotes in reply order: ``position``
numbers the messages of a conversation by (reply_turn, turn), so every message
comes after the one it answers, and answers to one message are adjacent.
``chat`` is a message's text in the format; a conversation's text is its chats
in order of position.

Hot units: only hashes that some quote asks for are kept. Anywhere, a hash is
reduced to its two smallest places in different conversations before the
shuffle; inside conversations the latest earlier message is a running maximum
over distinct turns, in blocks. The turn before is an equi-join on turn - 1;
only turns at gaps are ordered in a window.

Defined results: null texts are empty; rows with a null conversation or turn
have no reply and aren't found as originals; without a conversation the
position is null. Repeated rows each give a row. An
empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
UNIT = pa.struct([("level", pa.int32()), ("nth", pa.int32()), ("run", pa.binary()), ("line", pa.binary())])
#: Turns of a conversation in one window of the running maximum.
BLOCK = 4096
PARSED = "body string, units array<binary>, quotes array<struct<level:int,nth:int,run:binary,line:binary>>"


def digest(text: str) -> bytes | None:
    """128-bit hash of the normalised text; None if nothing is left."""
    words = " ".join(text.lower().split())
    return hashlib.md5(words.encode()).digest() if words else None


def levels(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one quote level, without their markers."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = QUOTE.match(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    return [(level, "\n".join(lines)) for level, lines in runs]


def _parse(batches):
    base.cached()
    for batch in batches:
        bodies, units, quotes = [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            runs = levels(text)
            own = [t for level, t in runs if level == 0]
            body = "\n".join(own).strip("\n")
            parts = [body, *own, *(line for t in own for line in t.split("\n"))]
            bodies.append(body)
            units.append(sorted({h for p in parts if (h := digest(p))}))
            quotes.append([{"level": level, "nth": i, "run": h, "line": digest(next(x for x in t.split("\n") if digest(x)))} for i, (level, t) in enumerate(runs) if level and (h := digest(t))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies), pa.array(units, pa.list_(pa.binary())), pa.array(quotes, pa.list_(UNIT))], names=["rid", "conv_id", "turn", "role", "body", "units", "quotes"])


def latest_before(originals: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, h, turn, t): for every asked (conv_id, h, turn) the latest turn
    before it that says h in the same conversation.

    A running maximum over both sides in turn order, first inside blocks of
    ``BLOCK`` turns, then over the last turns of the blocks: no pairs, and no
    window holds a whole long thread."""
    says = originals.select("conv_id", "h", "turn", F.col("turn").alias("said"), F.lit(False).alias("asks"))
    wants = asked.select("conv_id", "h", "turn", F.lit(None).cast(says.schema["said"].dataType).alias("said"), F.lit(True).alias("asks"))
    both = says.unionByName(wants).groupBy("conv_id", "h", "turn").agg(F.max("said").alias("said"), F.max("asks").alias("asks"))
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "h", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("conv_id", "h", "block").agg(F.max("said").alias("end"))
    earlier = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.max("end").over(earlier)).filter("carried IS NOT NULL").drop("end")
    near = both.withColumn("near", F.max("said").over(inside)).filter("asks")
    return near.join(ends, ["conv_id", "h", "block"], "left").select("conv_id", "h", "turn", F.coalesce("near", "carried").alias("t")).filter("t IS NOT NULL")


def elsewhere(originals: DataFrame) -> DataFrame:
    """(h, one, two): the smallest (conv_id, turn) that says h, and the smallest
    in another conversation. The limit of two is applied before the shuffle too."""
    per = originals.groupBy("h", "conv_id").agg(F.min("turn").alias("turn"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("conv_id", "turn"))
    place = F.struct("conv_id", "turn")
    return per.withColumn("nth", nth).filter("nth <= 2").groupBy("h").agg(F.min(place).alias("one"), F.max(place).alias("two"))


def link_quotes(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (no quotes), reply_turn, position, quoted_conv,
    quoted_turn, n_quotes, n_linked, chat."""
    spark = table.sparkSession
    scratch = base.Scratch(spark, "quotes")
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    rows = table.select(F.monotonically_increasing_id().alias("rid"), "conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parsed = scratch.table(rows.mapInArrow(_parse, f"rid long, conv_id {types['conv_id']}, turn {types['turn']}, role {types['role']}, {PARSED}"))

    placed = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = parsed.select("rid", "conv_id", "turn", F.explode("quotes").alias("q")).select("rid", "conv_id", "turn", "q.*")
    asked = quotes.select("rid", "conv_id", "turn", "level", "nth", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("run").alias("h")), F.struct(F.lit(1).alias("by"), F.col("line").alias("h")))).alias("x")).select("rid", "conv_id", "turn", "level", "nth", "x.by", "x.h")
    asked = scratch.table(asked)
    # only what is asked for travels further
    wanted = base.small(scratch.table(asked.select("h").distinct()))
    originals = scratch.table(placed.select(F.explode("units").alias("h"), "conv_id", "turn").join(wanted, "h", "left_semi"))

    one, two = F.col("one"), F.col("two")
    own = lambda place: place.conv_id == F.col("conv_id")
    place = F.when(F.col("conv_id").isNull() | F.col("turn").isNull() | ~own(one), one).when(~own(two), two)
    anywhere = asked.join(elsewhere(originals), "h").withColumn("at", place).filter("at IS NOT NULL").select("rid", "level", "nth", "by", "at")
    here = asked.join(latest_before(originals, asked.filter("conv_id IS NOT NULL AND turn IS NOT NULL")), ["conv_id", "h", "turn"])
    found = anywhere.join(here.select("rid", "level", "nth", "by", "t"), ["rid", "level", "nth", "by"], "full")
    # one place per quote (the run before the line, the own conversation first), then the outermost first quote of a message
    best = found.groupBy("rid", "level", "nth").agg(F.min_by("t", "by").alias("t"), F.min_by("at", "by").alias("at"))
    order = F.struct(F.col("t").isNull(), F.col("level"), F.col("nth"))
    links = best.groupBy("rid").agg(F.count(F.lit(1)).alias("n_linked"), F.min_by("t", order).alias("t"), F.min_by("at", order).alias("at"))

    turns = scratch.table(placed.select("conv_id", "turn").distinct())
    after = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    ends = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_anti")
    starts = turns.join(after.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    edges = ends.unionByName(starts).distinct()
    gaps = edges.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).join(starts, ["conv_id", "turn"], "left_semi").filter("before IS NOT NULL")
    before = after.join(turns, ["conv_id", "turn"], "left_semi").unionByName(gaps.select("conv_id", "turn", "before"))

    out = parsed.join(links, "rid", "left").join(before, ["conv_id", "turn"], "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    out = out.select(
        "rid", "conv_id", "turn", "role", F.col("body").alias("text"), F.coalesce("t", "before").alias("reply_turn"),
        F.when(F.col("t").isNotNull(), F.col("conv_id")).otherwise(F.col("at.conv_id")).alias("quoted_conv"), F.coalesce("t", "at.turn").alias("quoted_turn"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), chat.alias("chat"),
    )
    return reply_order(out, scratch)


def reply_order(linked: DataFrame, scratch: base.Scratch) -> DataFrame:
    """``linked`` with each message's position (from 0) in its conversation's
    reply order, in the order of the rows: one range exchange, then the rows of
    a conversation are numbered across the partitions that hold them."""
    keys = ["conv_id", "reply_turn", "turn", "rid"]
    parts = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = linked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = scratch.table(ordered.withColumns({"pid": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}))
    held = ordered.groupBy("conv_id", "pid").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), (before - F.col("first")).alias("shift"))
    placed = ordered.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")))
    position = F.when(F.col("conv_id").isNotNull(), F.col("mid") + F.col("shift"))
    return placed.select("conv_id", "turn", "role", "text", "reply_turn", position.alias("position"), "quoted_conv", "quoted_turn", "n_quotes", "n_linked", "chat")


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(base.read(spark, sf_dir, "conversations"))
