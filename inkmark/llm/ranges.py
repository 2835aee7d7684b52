"""Deterministic shards: contiguous key ranges of about equal weight, the same on every cluster and run."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells of the key histogram; the table of cells is sent to every task, so this bounds that broadcast.
CELLS = 1 << 16


def key_shards(df: DataFrame, key: str, weight: Column, target: int) -> DataFrame:
    """Add ``shard`` (int): 0 for null keys, then 1, 2, ... for rising ranges of an integer key.

    The histogram has equal cells over the range of the key, so it is exact and needs no sampling. A cell is never cut:
    one that outweighs the target is a shard alone, and rows of one key always share a shard.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn("shard", F.lit(0))
    shift = 0
    while (high >> shift) - (low >> shift) >= CELLS:
        shift += 1
    cell = (F.shiftright(F.col(key).cast("long"), shift) - F.lit(low >> shift)).cast("int")
    heavy = {r.cell: r.weight for r in df.filter(F.col(key).isNotNull()).groupBy(cell.alias("cell")).agg(F.sum(weight).alias("weight")).collect()}
    cells = sorted(heavy)
    before = [0, *accumulate(heavy[c] or 0 for c in cells)]
    numbers: dict[int, int] = {}
    rows = [(c, numbers.setdefault(b // target, len(numbers) + 1)) for c, b in zip(cells, before)]
    schema = T.StructType([T.StructField("_cell", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    shards = df.sparkSession.createDataFrame(rows, schema)
    placed = df.withColumn("_cell", cell).join(F.broadcast(shards), "_cell", "left").drop("_cell")
    return placed.withColumn("shard", F.coalesce("shard", F.lit(0)))


def shard_count(df: DataFrame) -> int:
    """Tasks for a shuffle by shard: as many as the shuffle partitions, which AQE may join."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
