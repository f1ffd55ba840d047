"""Rendezvous hashing of record keys over weighted shards, and gapless slots within each shard.

Each shard draws a number from (key, shard); the shard whose -ln(draw) / weight is least takes the key. A new
shard draws on its own, so it only takes keys into itself and moves no other. All of it is a row's own arithmetic.

Slots number the rows of a shard without gaps. Rows are numbered within the piece of the input that they came from, and
pieces are offset by the counts of those before; so no task holds a shard, and a hot key, however many rows
it has, is spread over the pieces. The rows (without texts) are written with their piece's number first, which fixes it
for any later run of a task.

A null key counts as its own key; null texts have size 8 and crc 0; repeated rows each get a slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import materialise

#: Counts by (shard, piece) are broadcast up to so many, else joined by shuffle.
BROADCAST_COUNTS = 200_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards; a weight of 0 takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard must have weight")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 52 bits of the hash, as a number between 0 and 1.
            draw = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
            draws.append(F.struct((-F.log(draw) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, columns: Sequence[Column] = ()) -> DataFrame:
    """Key, the given columns, shard, slot and (with grown weights) grown_shard of every row."""
    own = df.select(F.col(key), *columns, rendezvous(F.col(key), weights).alias("shard"), *([rendezvous(F.col(key), grown).alias("grown_shard")] if grown else []), F.spark_partition_id().alias("_piece"))
    return numbered(materialise(own, "shards"), key)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds gapless slots by (shard, _piece) to rows whose pieces are fixed."""
    counts = rows.groupBy("shard", "_piece").count()
    # At most shards x pieces rows: the window of a shard holds a row for each piece.
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")), "shard-counts")
    if starts.count() <= BROADCAST_COUNTS:
        starts = F.broadcast(starts)
    others = [c for c in rows.columns if c not in (key, "shard", "_piece")]
    within = Window.partitionBy("shard", "_piece").orderBy(key, *others)
    placed = rows.withColumn("_own", F.row_number().over(within) - 1).join(starts, ["shard", "_piece"])
    return placed.select(key, *others, "shard", (F.col("_start") + F.col("_own")).alias("slot"))
