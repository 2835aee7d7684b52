"""Exact quota cuts: the k smallest hash keys per stratum, without sorting a stratum.

Picking the k rows with the smallest ``md5(seed|key)`` is the same as comparing each
row's hash with the k-th smallest hash of its stratum. That threshold is found from
counts per (stratum, hash prefix): the running count names the one prefix bucket in
which the k-th hash lies, and only rows of that bucket are ranked. With four hex digits
a bucket holds 1/65536 of a stratum, so neither a hot stratum nor a large corpus gives a
large sort; the rows themselves are not shuffled at all, they only meet a tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.operators.joins import join_null_safe
from inkmark.session import broadcast_checked, cut_lineage

SEED = 42
PREFIX = 4


def hash_key(*keys: str, seed: int = SEED) -> Column:
    """Portable pseudo-random order of rows: hex md5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def ceil_share(n: Column, numerator: int, denominator: int) -> Column:
    """``ceil(n * numerator / denominator)`` in integers."""
    return F.floor((n * numerator + (denominator - 1)) / denominator).cast("bigint")


def largest_remainder(counts: DataFrame, total: str, within: list[str], label: str = "label") -> DataFrame:
    """Split ``total`` over classes in proportion to ``n``: floors, then largest remainders.

    ``counts`` has one row per (``within``, label) with columns ``n`` and ``total``; the
    windows see a handful of classes each.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    by_rest = group.orderBy(F.desc("_rest"), F.asc(label))
    return (
        counts.withColumn("_all", F.sum("n").over(group))
        .withColumn("_floor", F.floor(F.col("n") * F.col(total) / F.col("_all")).cast("bigint"))
        .withColumn("_rest", F.col("n") * F.col(total) - F.col("_floor") * F.col("_all"))
        .withColumn("_missing", F.col(total) - F.sum("_floor").over(group))
        .withColumn("quota", F.col("_floor") + F.when(F.row_number().over(by_rest) <= F.col("_missing"), 1).otherwise(0))
        .drop("_all", "_floor", "_rest", "_missing")
    )


def thresholds(
    hashed: DataFrame, strata: list[str], quotas: DataFrame, cuts: list[str], few_strata: bool = True
) -> DataFrame:
    """Per stratum the hash of its ``cut``-th row for each column of ``cuts``.

    ``hashed`` has the strata and ``_h``; ``quotas`` has the strata and one count column
    per cut. A cut of zero gives '' (nothing is below it). ``few_strata`` says that the
    strata are a short list by construction; otherwise the size is checked before a broadcast.
    NULL is a stratum like any other.

    The result is fitted at once, in two passes over narrow columns, and materialised, so the
    plan of the split itself is one pass over the rows and never repeats these.
    """
    buckets = hashed.groupBy(*strata, F.substring("_h", 1, PREFIX).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = buckets.withColumn("_upto", F.sum("_n").over(running)).withColumn("_before", F.col("_upto") - F.col("_n"))
    wanted = quotas.select(
        *strata, F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("k")) for c in cuts])).alias("_q")
    ).select(*strata, "_q.cut", "_q.k")
    # an equi-join on the strata of two tables of bucket counts, then one bucket per cut is left
    edge = join_null_safe(sums, wanted, strata).filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_upto")))
    edge = cut_lineage(edge.select(*strata, "_b", "cut", (F.col("k") - F.col("_before")).alias("_r")))
    small = F.broadcast(edge) if few_strata else broadcast_checked(edge)
    inside = join_null_safe(hashed.withColumn("_b", F.substring("_h", 1, PREFIX)), small, [*strata, "_b"])
    rank = F.row_number().over(Window.partitionBy(*strata, "_b", "cut").orderBy("_h"))
    found = inside.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_r"))
    hashes = found.groupBy(*strata).agg(*[F.max(F.when(F.col("cut") == c, F.col("_h"))).alias(c) for c in cuts])
    return cut_lineage(hashes.na.fill("", cuts))


def with_thresholds(
    df: DataFrame,
    strata: list[str],
    key: list[str],
    quotas: DataFrame,
    cuts: list[str],
    seed: int = SEED,
    few_strata: bool = True,
) -> DataFrame:
    """Attach ``_h`` and the threshold hash of each cut."""
    hashed = df.withColumn("_h", hash_key(*key, seed=seed))
    limits = thresholds(hashed.select(*strata, "_h"), strata, quotas, cuts, few_strata)
    limits = F.broadcast(limits) if few_strata else broadcast_checked(limits)
    return join_null_safe(hashed, limits, strata, "left")


def take_quota(
    df: DataFrame, strata: list[str], key: list[str], quotas: DataFrame, seed: int = SEED, few_strata: bool = True
) -> DataFrame:
    """Keep the ``quota`` rows with the smallest hashes per stratum; missing strata keep nothing."""
    cut = with_thresholds(df, strata, key, quotas, ["quota"], seed, few_strata)
    return cut.filter(F.col("_h") <= F.col("quota")).select(*df.columns)
