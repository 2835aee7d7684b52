"""Joins with tables whose keys are unique but unevenly used: the most used keys are broadcast, the others shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_of(df: DataFrame, weight: str, most: int) -> int:
    """A weight that at most ``most`` rows reach; from a histogram with eight classes per doubling."""
    level = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1))) * 8).cast("int")
    total, cut = 0, None
    for row in df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("least")).orderBy(F.desc("level")).collect():
        total += row.n
        if total > most:
            break
        cut = row.least
    return cut if cut is not None else (1 << 62)


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], weight: str, most: int = 50_000) -> DataFrame:
    """Left join with ``right``, which has one row per key and in ``weight`` how many left rows may share it.

    At most ``most`` rows of it, those with the highest weights, are sent to every task; what is left of a key in the
    shuffled join is therefore a small share of the rows. The result is the same wherever the cut lies.
    """
    cut = cut_of(right, weight, most)
    heavy = right.filter(F.col(weight) >= cut)
    known = left.join(F.broadcast(heavy), keys)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right.filter(F.col(weight) < cut), keys, "left")
    return known.unionByName(rest)
