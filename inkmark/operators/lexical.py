"""TF-IDF vocabularies and weights, scaling, class weights and feature assembly.

Terms, some fifty times larger than the text, are counted in the task of their row, piece by
piece of an Arrow batch; only distinct terms of a piece leave it. Rows that share an id are one
document: where there are any, their terms are exploded and grouped by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.functions import gram_arrays
from inkmark.functions.ngrams import TermSpec, add_terms, prepared
from inkmark.operators.joins import join_null_safe
from inkmark.session import broadcast_checked, cut_lineage


def by_document(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    spark = docs.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return docs.repartition(slots, key)


def term_counts(docs: DataFrame, spec: TermSpec, keep: list[str], text: str = "text", block: int = 0) -> DataFrame:
    """(keep, block, term, tf); a document without terms gives one row with a NULL term."""
    terms = add_terms(docs.select(*keep, text), text, spec)
    exploded = terms.select(*keep, F.explode_outer("terms").alias("term"))
    return exploded.groupBy(*keep, "term").agg(F.count("term").alias("tf")).withColumn("block", F.lit(block))


def _by_repetition(docs: DataFrame, key: str) -> tuple[int, DataFrame, DataFrame | None]:
    """The number of rows, those whose id is their own, and the others if there are any."""
    ids = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows, repeated = ids.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") > 1)).first()
    if not repeated:
        return rows, docs, None
    shared = cut_lineage(ids.filter("_n > 1").select(key))
    return rows, join_null_safe(docs, shared, [key], "left_anti"), join_null_safe(docs, shared, [key], "left_semi")


def _totals(placed: DataFrame, spec: TermSpec, text: str) -> DataFrame:
    """(term, df, cf), several rows per term: its totals in pieces of the rows, each a document."""

    def run(batches):
        for batch in batches:
            for piece in gram_arrays.pieces(batch, [0]):
                yield from gram_arrays.totals(piece.column(0), spec)

    return placed.select(prepared(F.col(text), spec).alias("made")).mapInArrow(run, "term string, df bigint, cf bigint")


def fit_vocabulary(
    docs: DataFrame, specs: list[TermSpec], text: str = "text", key: str = "doc_id", sizes: bool = False
) -> DataFrame:
    """(block, term, df, cf, idf, term_id), fitted on the rows given, which must be training rows.

    Only counts per term leave the map side. The table is materialised, because every later
    job joins it; with ``max_features`` set it has a fixed upper size.
    """
    n_docs, own, shared = _by_repetition(docs.select(key, text), key)
    placed = by_document(own, key)
    tables = []
    for block, spec in enumerate(specs):
        parts = _totals(placed, spec, text)
        if shared is not None:
            counts = term_counts(by_document(shared, key), spec, [key], text).filter(F.col("term").isNotNull())
            parts = parts.unionByName(counts.select("term", F.lit(1).cast("bigint").alias("df"), F.col("tf").alias("cf")))
        terms = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).withColumn("block", F.lit(block))
        terms = terms.filter((F.col("df") >= spec.min_df) & (F.col("df") <= spec.max_df * n_docs))
        if spec.max_features is not None:
            terms = terms.orderBy(F.desc("cf"), F.asc("term")).limit(spec.max_features)
        tables.append(terms)
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    fitted = union.withColumn("idf", F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).select("block", "term", "df", "cf", "idf")
    if any(spec.max_features is None for spec in specs):
        return cut_lineage(fitted.withColumn("term_id", F.xxhash64("block", "term")))
    numbered = F.row_number().over(Window.orderBy("block", "term")) - 1
    # one ordered window over at most the sum of the feature limits
    return cut_lineage(fitted.withColumn("term_id", numbered))


def _weight(spec: TermSpec) -> Column:
    tf = F.col("tf").cast("double")
    return (F.ln(tf) + 1.0 if spec.sublinear else tf) * F.col("idf")


def known_terms(vocabulary: DataFrame, specs: list[TermSpec]) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per block the terms, their ids and idf; as many as the vocabulary's limit."""
    rows = vocabulary.select("block", "term", "term_id", "idf").toPandas()
    out = []
    for block in range(len(specs)):
        own = rows[rows["block"] == block]
        out.append((pa.array(own["term"], pa.string()), own["term_id"].to_numpy(np.int64), own["idf"].to_numpy(np.float64)))
    return out


def _weigh_joined(docs: DataFrame, vocabulary: DataFrame, specs: list[TermSpec], keep: list[str], text: str, key: str) -> DataFrame:
    """The same by exploding and joining: for rows that share an id, and vocabularies without a limit."""
    placed = by_document(docs.select(*keep, text), key)
    known = broadcast_checked(vocabulary.select("block", "term", "term_id", "idf"))
    tables = []
    for block, spec in enumerate(specs):
        counts = term_counts(placed, spec, keep, text, block)
        tables.append(counts.join(known, ["block", "term"]).withColumn("_w", _weight(spec)))
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key, "block")))
    return union.select(*keep, "block", "term", "term_id", "tf", (F.col("_w") / norm).alias("w"))


def weigh(
    docs: DataFrame, vocabulary: DataFrame, specs: list[TermSpec], keep: list[str] | None = None, text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(keep, block, term, term_id, tf, w): idf-weighted counts, each block of unit length per document."""
    keep = keep or [key]
    if any(spec.max_features is None for spec in specs):
        return _weigh_joined(docs, vocabulary, specs, keep, text, key)
    _, own, shared = _by_repetition(docs.select(*keep, text), key)
    known = docs.sparkSession.sparkContext.broadcast(known_terms(vocabulary, specs))
    made = [prepared(F.col(text), spec).alias(f"_made{b}") for b, spec in enumerate(specs)]

    def run(batches):
        width = len(keep)
        for batch in batches:
            for piece in gram_arrays.pieces(batch, [width + b for b in range(len(specs))]):
                for block, spec in enumerate(specs):
                    terms, ids, idf = known.value[block]
                    row, at, tf, w = gram_arrays.weights(piece.column(width + block), spec, terms, idf)
                    rows = [piece.column(c).take(pa.array(row)) for c in range(width)]
                    cells = [np.full(len(row), block, np.int32), terms.take(pa.array(at)), ids[at], tf, w]
                    yield pa.RecordBatch.from_arrays(
                        [*rows, *[c if isinstance(c, pa.Array) else pa.array(c) for c in cells]], names=names
                    )

    names = [*keep, "block", "term", "term_id", "tf", "w"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    placed = by_document(own, key).select(*keep, *made)
    out = placed.mapInArrow(run, f"{schema}, block int, term string, term_id bigint, tf bigint, w double")
    if shared is not None:
        out = out.unionByName(_weigh_joined(shared, vocabulary, specs, keep, text, key))
    return out


def scaler(train: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean and population deviation per feature of the training rows."""
    stats = [F.avg(c).alias(f"{c}__mean") for c in names] + [F.stddev_pop(c).alias(f"{c}__std") for c in names]
    return train.agg(*stats)


def scale(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Centre and scale; a constant feature becomes 0. The statistics are one fitted row."""
    row = stats.first()
    columns = []
    for c in names:
        mean, std = row[f"{c}__mean"], row[f"{c}__std"]
        constant = std is None or std < 1e-12
        columns.append((F.lit(0.0) if constant else (F.col(c) - F.lit(mean)) / F.lit(std)).alias(c))
    return df.select(*[c for c in df.columns if c not in names], *columns)


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (2 n_c)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("weight", F.round(total / (2.0 * F.col("n")), 6))


def embedding_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, mean, std) per dimension; the row count per dimension never leaves the map side."""
    cells = df.select(F.posexplode(vector).alias("pos", "x"))
    x = F.col("x").cast("double")
    return cells.groupBy("pos").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def scale_embeddings(df: DataFrame, stats: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    """Standardise every dimension. ``stats`` has one row per dimension and is packed into one array."""
    rows = stats.orderBy("pos").collect()
    means = F.array(*[F.lit(float(r["mean"])) for r in rows])
    stds = F.array(*[F.lit(float(r["std"])) for r in rows])
    scaled = F.transform(
        F.col(vector),
        lambda x, i: F.when(F.get(stds, i) < 1e-12, F.lit(0.0)).otherwise(
            (x.cast("double") - F.get(means, i)) / F.get(stds, i)
        ),
    )
    return df.select(*keep, scaled.alias(vector))


def masked_mean_pool(df: DataFrame, group: str, mask: Column, vector: str = "embedding") -> DataFrame:
    """(group, pos, value): mean of the unmasked vectors of a group, per dimension."""
    cells = df.filter(mask).select(group, F.posexplode(vector).alias("pos", "x"))
    return cells.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
