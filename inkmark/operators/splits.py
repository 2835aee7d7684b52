"""Sampling and leakage-safe splits. A split is a column, never a copy of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.operators.joins import join_null_safe
from inkmark.operators.quota import (
    SEED,
    ceil_share,
    hash_key,
    largest_remainder,
    take_quota,
    thresholds,
    with_thresholds,
)
from inkmark.session import broadcast_checked, cut_lineage

# What stands for missing metadata in sampling and hold-outs.
UNKNOWN = {"domain": "unknown", "model": "", "attack": "none"}


def _known(column: str) -> Column:
    """The column, with its stand-in where it is NULL."""
    return F.coalesce(F.col(column), F.lit(UNKNOWN[column]))


def _class_counts(df: DataFrame, within: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*within, label).agg(F.count(F.lit(1)).alias("n"))


def _with_total(counts: DataFrame, within: list[str], numerator: int, denominator: int, name: str) -> DataFrame:
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return counts.withColumn(name, ceil_share(F.sum("n").over(group), numerator, denominator))


def _stratified_quota(df: DataFrame, within: list[str], numerator: int, denominator: int) -> DataFrame:
    counts = _with_total(_class_counts(df, within), within, numerator, denominator, "total")
    return largest_remainder(counts, "total", within).select(*within, "label", "quota")


def sample_balanced(df: DataFrame, max_human: int, max_ai: int, key: str = "doc_id") -> DataFrame:
    """The same number of rows from both classes; an error if one class is empty."""
    counts = df.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    size = F.least(F.lit(max_human), F.lit(max_ai), "n0", "n1")
    size = F.when(size == 0, F.raise_error(F.lit("both classes are needed")).cast("bigint")).otherwise(size)
    quotas = counts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), size.alias("quota"))
    return take_quota(df, ["label"], [key], quotas)


def sample_cap(df: DataFrame, max_rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` rows in hash order."""
    one = df.withColumn("_all", F.lit(1))
    quotas = one.groupBy("_all").agg(F.least(F.count(F.lit(1)), F.lit(max_rows)).alias("quota"))
    return take_quota(one, ["_all"], [key], quotas).drop("_all")


def sample_nested_quota(
    df: DataFrame, max_per_model: int, max_per_domain_label: int, max_human: int, max_ai: int, key: str = "doc_id"
) -> DataFrame:
    """Caps per generator, then per (domain, label), then per label, each in hash order.

    The counters of the scan-order rule depend on each other row by row and do not
    distribute; nested cuts keep every cap and give the same result on every run. Rows without
    generator or domain are a stratum of their own.
    """

    def capped(rows: DataFrame, strata: list[str], cap) -> DataFrame:
        counts = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
        return counts.select(*strata, F.least("_n", cap).alias("quota"))

    is_ai = F.col("label") == 1
    columns = df.columns
    # human rows are not capped by generator
    model_cap = F.when(F.col("_stratum") == "human", F.col("_n")).otherwise(F.lit(max_per_model))
    first = df.withColumn("_stratum", F.when(is_ai, F.concat(F.lit("ai:"), _known("model"))).otherwise("human"))
    first = first.select(key, _known("domain").alias("domain"), "label", "_stratum")
    by_model = capped(first, ["_stratum"], model_cap)
    first = cut_lineage(take_quota(first, ["_stratum"], [key], by_model, few_strata=False))
    by_domain = capped(first, ["domain", "label"], F.lit(max_per_domain_label))
    second = cut_lineage(take_quota(first, ["domain", "label"], [key], by_domain, few_strata=False))
    label_cap = F.when(is_ai, F.lit(max_ai)).otherwise(F.lit(max_human))
    third = take_quota(second, ["label"], [key], capped(second, ["label"], label_cap))
    # at most max_human + max_ai ids; small caps are broadcast, large ones joined by shuffle
    kept = broadcast_checked(cut_lineage(third.select(key)))
    return df.join(kept, key, "left_semi").select(*columns)


def sample_coupled_quota(
    df: DataFrame, max_per_model: int, max_per_domain_label: int, max_human: int, max_ai: int, key: str = "doc_id"
) -> DataFrame:
    """The scan-order rule in hash order: a row is taken if none of its counters is full, and only taken rows count.

    A row refused by one cap thus uses up no other. Each counter (generator of machine rows, domain and label, label) is full
    from some row on, and a row is taken where it comes no later than all its counters' last rows. These last rows are a
    fixed point: a counter's last row is the cap-th of its rows that the other counters let pass. Rounds of prefix counts
    find it. Each settles at least the next counter to fill, as that depends on earlier rows only, so there are at most as many
    rounds as counters, and in practice a few; no counter's rows are ever sorted whole.

    Rows without generator or domain have counters of their own, as in :func:`sample_nested_quota`. Equal keys are equal
    hashes: give a key that is unique.
    """
    is_ai = F.col("label") == 1
    named = lambda kind, *values: F.concat_ws("|", F.lit(kind), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    label_cap = F.when(is_ai, F.lit(max_ai)).otherwise(F.lit(max_human))
    counter = lambda name, cap: F.struct(name.alias("counter"), cap.cast("long").alias("quota"))
    counters = F.filter(
        F.array(
            counter(F.when(is_ai, named("model", _known("model"))), F.lit(max_per_model)),
            counter(named("domain", F.col("label"), _known("domain")), F.lit(max_per_domain_label)),
            counter(named("label", F.col("label")), label_cap),
        ),
        lambda c: c["counter"].isNotNull(),
    )
    rows = cut_lineage(df.select(F.col(key), hash_key(key).alias("_h"), counters.alias("counters")))
    one = rows.select("_h", F.posexplode("counters").alias("at", "own")).select("_h", "own.counter", "own.quota")
    caps = cut_lineage(one.groupBy("counter").agg(F.first("quota").alias("quota"), F.count(F.lit(1)).alias("n")))
    # no hash is behind "g"; a counter that is never full has no last row, one with cap zero none but ''
    last = cut_lineage(caps.select("counter", F.when(F.col("quota") <= 0, "").otherwise("g").alias("last")))
    for _ in range(caps.count() + 1):
        open_to = F.filter(F.col("held"), lambda c: c["last"] < F.col("_h"))
        full = _with_last(rows, last).select("_h", "held", F.size(open_to).alias("full"))
        # a row counts for a counter if no other one of its counters is full
        counted = full.filter("full <= 1").select("_h", "full", F.explode("held").alias("c"))
        counted = counted.filter((F.col("full") == 0) | (F.col("c.last") < F.col("_h"))).select("_h", F.col("c.counter").alias("counter"))
        found = thresholds(counted, ["counter"], caps.select("counter", "quota"), ["quota"], few_strata=False)
        now = caps.select("counter", F.col("quota").alias("cap")).join(broadcast_checked(found.withColumnRenamed("quota", "found")), "counter", "left")
        now = cut_lineage(now.select("counter", F.when(F.col("cap") <= 0, "").otherwise(F.coalesce("found", F.lit("g"))).alias("last")))
        settled = now.join(last.withColumnRenamed("last", "before"), "counter").filter("last <> before").isEmpty()
        last = now
        if settled:
            break
    taken = _with_last(rows, last).filter(F.forall("held", lambda c: c["last"] >= F.col("_h"))).select(key)
    return df.join(broadcast_checked(cut_lineage(taken)), key, "left_semi")


def _with_last(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The rows with ``held``: their counters, each with its last row's hash."""
    out = rows
    for i in range(3):
        own = broadcast_checked(last.select(F.col("counter").alias(f"_c{i}"), F.col("last").alias(f"_l{i}")))
        out = out.withColumn(f"_c{i}", F.get(F.col("counters"), F.lit(i))["counter"]).join(own, f"_c{i}", "left")
    held = F.array(*[F.struct(F.col(f"_c{i}").alias("counter"), F.col(f"_l{i}").alias("last")) for i in range(3)])
    return out.select(*rows.columns, F.filter(held, lambda c: c["counter"].isNotNull()).alias("held"))


def split_stratified(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """80/20 by label: ``ceil(n/5)`` test rows, shared over the classes in proportion."""
    columns = df.columns
    cut = with_thresholds(df, ["label"], [key], _stratified_quota(df, [], 20, 100), ["quota"])
    return cut.select(*columns, F.when(F.col("_h") <= F.col("quota"), "test").otherwise("train").alias("split"))


def three_way_quotas(df: DataFrame) -> DataFrame:
    """Per label: size of test, and of test plus validation, for 70/15/15."""
    held = largest_remainder(_with_total(_class_counts(df, []), [], 30, 100, "total"), "total", [])
    held = held.select("label", F.col("quota").alias("n"))
    test = largest_remainder(_with_total(held, [], 1, 2, "total"), "total", [])
    return test.select("label", F.col("quota").alias("test"), F.col("n").alias("held"))


def split_three_way(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """70/15/15 by label: one hash order, two cut points."""
    columns = df.columns
    cut = with_thresholds(df, ["label"], [key], three_way_quotas(df), ["test", "held"])
    name = F.when(F.col("_h") <= F.col("test"), "test").when(F.col("_h") <= F.col("held"), "val").otherwise("train")
    return cut.select(*columns, name.alias("split"))


def _group_limits(df: DataFrame, group: str) -> DataFrame:
    """One row: the hash thresholds of the test groups and of test plus validation groups."""
    groups = df.select(F.lit(1).alias("_all"), hash_key(group).alias("_h")).distinct()
    sizes = groups.groupBy("_all").agg(F.count(F.lit(1)).alias("_g"))
    sizes = sizes.withColumn("test", ceil_share(F.col("_g"), 20, 100)).withColumn(
        "held", F.col("test") + ceil_share(F.col("_g") - F.col("test"), 20, 100)
    )
    sizes = sizes.withColumn(
        "test", F.when(F.col("_g") < 3, F.raise_error(F.lit("three groups are needed")).cast("bigint")).otherwise(F.col("test"))
    )
    return thresholds(groups, ["_all"], sizes, ["test", "held"])


def split_grouped(df: DataFrame, group: str) -> DataFrame:
    """20 % of the groups to test, 20 % of the others to validation; groups never cross.

    A row's side follows from the hash of its own group, so rows are neither shuffled by
    group nor joined with a group table, and a hot group costs nothing extra.
    """
    columns = df.columns
    filled = F.coalesce(F.col(group).cast("string"), F.lit("missing"))
    rows = df.withColumn("_group", filled).withColumn("_all", F.lit(1))
    cut = rows.withColumn("_h", hash_key("_group")).join(F.broadcast(_group_limits(rows, "_group")), "_all")
    name = F.when(F.col("_h") <= F.col("test"), "test").when(F.col("_h") <= F.col("held"), "val").otherwise("train")
    return cut.select(*columns, name.alias("split"))


def split_source_grouped(df: DataFrame, sources: list[str], key: str = "doc_id") -> DataFrame:
    """20 % of the source groups to test; a stratified 20 % of the remaining rows to validation."""
    columns = df.columns
    filled = F.coalesce(*[F.col(c).cast("string") for c in sources], F.col(key).cast("string"))
    rows = df.withColumn("_group", filled).withColumn("_all", F.lit(1)).withColumn("_gh", hash_key("_group"))
    cut = rows.join(F.broadcast(_group_limits(rows, "_group")), "_all")
    cut = cut.withColumn("_side", F.when(F.col("_gh") <= F.col("test"), "test").otherwise("rest"))
    cut = cut.select(*columns, "_side")
    rest = cut.filter(F.col("_side") == "rest")
    return _validation_within(cut, rest, key).select(*columns, "split")


def _validation_within(rows: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    quotas = _stratified_quota(rest, [], 20, 100)
    limits = thresholds(rest.select("label", hash_key(key).alias("_h")), ["label"], quotas, ["quota"])
    joined = rows.withColumn("_h", hash_key(key)).join(F.broadcast(limits), "label", "left")
    name = F.when(F.col("_side") == "test", "test").when(F.col("_h") <= F.col("quota"), "val").otherwise("train")
    return joined.withColumn("split", name)


def _names(values: DataFrame, column: str) -> list[str]:
    """The hold-out names; each is a full train/test experiment, so there are as many as experiments."""
    return [r[0] for r in values.select(column).collect()]


def _per_holdout(df: DataFrame, names: list[str]) -> DataFrame:
    """Every row once per hold-out: each hold-out is an experiment over the whole table."""
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return df.select("*", F.explode(listed).alias("holdout"))


def _both_classes(rows: DataFrame) -> DataFrame:
    """Hold-outs whose train and test parts both have two classes."""
    sides = rows.groupBy("holdout").agg(
        F.count_distinct(F.when(F.col("_test"), F.col("label"))).alias("_c1"),
        F.count_distinct(F.when(F.col("_train"), F.col("label"))).alias("_c2"),
    )
    return sides.filter((F.col("_c1") == 2) & (F.col("_c2") == 2)).select("holdout")


def _finish_holdout(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Drop unusable hold-outs, carve out validation, and emit one row per (hold-out, side, row).

    ``_test`` and ``_train`` may both hold for a row; it then appears on both sides.
    """
    usable = rows.filter(F.col("holdout").isin(_names(_both_classes(rows), "holdout")))
    train = usable.filter("_train")
    limits = thresholds(
        train.select("holdout", "label", hash_key(key).alias("_h")),
        ["holdout", "label"],
        _stratified_quota(train, ["holdout"], 20, 100),
        ["quota"],
    )
    joined = usable.withColumn("_h", hash_key(key)).join(F.broadcast(limits), ["holdout", "label"], "left")
    side = F.when(F.col("_h") <= F.col("quota"), "val").otherwise("train")
    sides = F.array_compact(
        F.array(F.when(F.col("_test"), F.lit("test")), F.when(F.col("_train"), side))
    )
    return joined.select("holdout", *columns, F.explode(sides).alias("split"))


def split_domain_holdout(df: DataFrame, min_rows: int = 50, key: str = "doc_id") -> DataFrame:
    """Each domain with enough rows is the test set once."""
    large = df.groupBy(_known("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    rows = _per_holdout(df, _names(large, "domain"))
    own = _known("domain") == F.col("holdout")
    rows = rows.withColumns({"_test": own, "_train": ~own})
    return _finish_holdout(rows, df.columns, key)


def _top_values(df: DataFrame, column: str, min_rows: int, top: int, never: str | None = None) -> list[str]:
    ai = df.filter(F.col("label") == 1)
    counts = ai.groupBy(_known(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    if never is not None:
        counts = counts.filter(F.col(column) != never)
    return _names(counts.filter(F.col("n") >= min_rows).orderBy(F.desc("n"), F.asc(column)).limit(top), column)


def split_generator_holdout(
    df: DataFrame, min_rows: int = 250, top: int = 4, mode: str = "disjoint", key: str = "doc_id"
) -> DataFrame:
    """Test: one generator and human rows of its domains. Train: the other generators.

    ``reference`` keeps those human rows in train as well; ``disjoint`` gives a fifth of
    them, in hash order, to test and the others to train.
    """
    rows = _per_holdout(df, _top_values(df, "model", min_rows, top))
    own = _known("model") == F.col("holdout")
    domains = rows.filter(own).select("holdout", "domain").distinct().withColumn("_own_domain", F.lit(True))
    rows = join_null_safe(rows, broadcast_checked(cut_lineage(domains)), ["holdout", "domain"], "left")
    eligible = (F.col("label") == 0) & F.coalesce("_own_domain", F.lit(False))
    rows = rows.withColumns({"_own": own, "_human": eligible})
    return _finish_holdout(_assign_human(rows, mode, key), df.columns, key)


def split_attack_holdout(
    df: DataFrame, min_rows: int = 250, top: int = 3, mode: str = "disjoint", key: str = "doc_id"
) -> DataFrame:
    """Test: one attack and human rows. Train: rows without that attack."""
    rows = _per_holdout(df, _top_values(df, "attack", min_rows, top, never="none"))
    rows = rows.withColumns({"_own": _known("attack") == F.col("holdout"), "_human": F.col("label") == 0})
    return _finish_holdout(_assign_human(rows, mode, key), df.columns, key)


def _assign_human(rows: DataFrame, mode: str, key: str) -> DataFrame:
    if mode == "reference":
        return rows.withColumns({"_test": F.col("_own") | F.col("_human"), "_train": ~F.col("_own")})
    human = rows.filter(F.col("_human") & ~F.col("_own"))
    quotas = human.groupBy("holdout").agg(ceil_share(F.count(F.lit(1)), 20, 100).alias("cut"))
    limits = thresholds(human.select("holdout", hash_key(key, seed=SEED + 1).alias("_h")), ["holdout"], quotas, ["cut"])
    rows = rows.withColumn("_hh", hash_key(key, seed=SEED + 1)).join(F.broadcast(limits), "holdout", "left")
    to_test = F.col("_own") | (F.col("_human") & (F.col("_hh") <= F.coalesce("cut", F.lit(""))))
    return rows.withColumns({"_test": to_test, "_train": ~to_test})


def shuffle_labels(df: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Random labels with the same class counts: the n1 smallest hashes get label 1."""
    one = df.withColumn("_all", F.lit(1))
    quotas = one.groupBy("_all").agg(F.count_if(F.col("label") == 1).alias("quota"))
    cut = with_thresholds(one, ["_all"], [key], quotas, ["quota"], seed + 1)
    return cut.select(*df.columns, F.when(F.col("_h") <= F.col("quota"), 1).otherwise(0).alias("shuffled_label"))
