"""Feature vectors for Spark ML: TF-IDF blocks, stylometry and embeddings."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions import gram_arrays, stylometry
from inkmark.functions.ngrams import TermSpec, prepared
from inkmark.operators import lexical, reshape
from inkmark.operators.columns import check_features_safe
from inkmark.session import cut_lineage, stored

STYLE = {"v2": stylometry.V2_FEATURES, "v1": stylometry.V1_FEATURES, "length": stylometry.LENGTH_FEATURES}


@dataclass
class FeaturePlan:
    """Which blocks a model reads: term blocks and one stylometric set."""

    specs: list[TermSpec] = field(default_factory=list)
    style: str | None = None
    scaled: bool = True


@dataclass
class FittedFeatures:
    """Statistics of the training rows: vocabulary and scaler, both small tables."""

    plan: FeaturePlan
    vocabulary: DataFrame | None
    n_terms: int
    stats: DataFrame | None

    @property
    def style_names(self) -> list[str]:
        return STYLE[self.plan.style] if self.plan.style else []

    @property
    def size(self) -> int:
        return self.n_terms + len(self.style_names)


def _style(docs: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    if f"_style_{kind}" in docs.columns:
        return docs.select(*keep, *[F.get(f"_style_{kind}", F.lit(i)).alias(n) for i, n in enumerate(STYLE[kind])])
    if kind == "v2":
        return stylometry.add_v2_features(docs, keep=keep)
    return stylometry.add_v1_features(docs, keep=keep).select(*keep, *STYLE[kind])


def style_columns(docs: DataFrame) -> list[str]:
    """Columns of stylometry that ``with_style`` has stored."""
    return [c for c in docs.columns if c.startswith("_style_")]


def with_style(docs: DataFrame, plans: list[FeaturePlan], key: str = "doc_id") -> DataFrame:
    """The rows, stored, with the stylometry of the plans as an array column each.

    A text's features follow from that text alone, so they are computed once for all models, splits and sides that read them.
    """
    rows = lexical.by_document(docs, key)
    kinds = sorted({p.style for p in plans if p.style})
    for kind in kinds:
        values = F.array(*STYLE[kind]).alias(f"_style_{kind}")
        rows = _style(rows, kind, rows.columns).select(*rows.columns, values)
    return stored(rows, "style")


def _shared_vocabulary(rows: DataFrame, specs: list[TermSpec], known: dict) -> tuple[DataFrame, int]:
    """The vocabulary of all blocks and its size; one that ``known`` holds for its terms is taken from there."""
    tables, n_terms = [], 0
    for block, spec in enumerate(specs):
        if spec not in known:
            fitted = lexical.fit_vocabulary(rows, [spec])
            known[spec] = fitted, fitted.count()
        own, n = known[spec]
        tables.append(own.withColumns({"block": F.lit(block), "term_id": F.col("term_id") + n_terms}))
        n_terms += n
    return reshape.union_all(tables), n_terms


def fit_features(train: DataFrame, plan: FeaturePlan, key: str = "doc_id", known: dict | None = None) -> FittedFeatures:
    """Fit on training rows only. ``known`` holds vocabularies fitted on the same rows and takes up new ones."""
    rows = train.select(key, "text")
    check_features_safe(rows.columns, (key, "text"))
    vocabulary, n_terms = None, 0
    if plan.specs and all(spec.max_features is not None for spec in plan.specs):
        vocabulary, n_terms = _shared_vocabulary(rows, plan.specs, {} if known is None else known)
    elif plan.specs:
        vocabulary = lexical.fit_vocabulary(rows, plan.specs)
        n_terms = vocabulary.count()
    stats = None
    if plan.style and plan.scaled:
        if f"_style_{plan.style}" in train.columns:
            rows = train.select(key, f"_style_{plan.style}")
        else:
            rows = lexical.by_document(rows, key)
        stats = cut_lineage(lexical.scaler(_style(rows, plan.style, [key]), STYLE[plan.style]))
    return FittedFeatures(plan, vocabulary, n_terms, stats)


def _sparse_udf(size: int):
    return F.udf(lambda ids, values: Vectors.sparse(size, ids, values), VectorUDT(), useArrow=True)


def term_cells(placed: DataFrame, fitted: FittedFeatures, keep: list[str]) -> DataFrame:
    """(keep, cells): per document the sorted (feature id, weight) pairs of all term blocks.

    Terms are looked up in the row's own task, so nothing is exploded, joined or sorted across rows.
    """
    specs = fitted.plan.specs
    known = placed.sparkSession.sparkContext.broadcast(lexical.known_terms(fitted.vocabulary, specs))
    made = [prepared(F.col("text"), spec).alias(f"_made{b}") for b, spec in enumerate(specs)]
    kind = pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())]))

    def weigh(part: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for block, spec in enumerate(specs):
            terms, ids, idf = known.value[block]
            row, at, _, w = gram_arrays.weights(part.column(len(keep) + block), spec, terms, idf)
            found.append((row, ids[at], w))
        row, ids, w = (np.concatenate(x) for x in zip(*found))
        order = np.argsort((row << 32) + ids)
        pairs = pa.StructArray.from_arrays([pa.array(ids[order], pa.int32()), pa.array(w[order])], names=["i", "v"])
        ends = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(ends), pairs).cast(kind)
        return pa.RecordBatch.from_arrays([*part.columns[: len(keep)], cells], names=[*keep, "_cells"])

    def run(batches):
        for batch in batches:
            for piece in gram_arrays.pieces(batch, [len(keep) + b for b in range(len(specs))]):
                yield weigh(piece)

    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in keep)
    return placed.select(*keep, *made).mapInArrow(run, f"{schema}, _cells array<struct<i:int,v:double>>")


def _placed_style(docs: DataFrame, fitted: FittedFeatures, keep: list[str]) -> DataFrame:
    """``keep``, the text where terms are read, and the stylometric columns, scaled if the plan says so."""
    names = fitted.style_names
    if names and not fitted.plan.specs and f"_style_{fitted.plan.style}" in docs.columns:
        placed = docs
    else:
        placed = lexical.by_document(docs.select(*keep, "text", *style_columns(docs)))
    if not names:
        return placed
    style = _style(placed, fitted.plan.style, [*keep, "text"] if fitted.plan.specs else keep)
    return lexical.scale(style, fitted.stats, names) if fitted.stats is not None else style


def feature_cells(docs: DataFrame, fitted: FittedFeatures, keep: list[str]) -> DataFrame:
    """``keep`` columns, which must include the document id, plus ``_cells``: sorted (feature id, value) pairs."""
    placed, names = _placed_style(docs, fitted, keep), fitted.style_names
    dense = F.array(*[F.struct(F.lit(fitted.n_terms + i).alias("i"), F.col(n).alias("v")) for i, n in enumerate(names)])
    if not fitted.plan.specs:
        return placed.select(*keep, dense.alias("_cells"))
    if not names:
        return term_cells(placed, fitted, keep)
    cells = term_cells(placed.select(*keep, "text", dense.alias("_dense")), fitted, [*keep, "_dense"])
    return cells.select(*keep, F.concat("_cells", "_dense").alias("_cells"))


def style_values(docs: DataFrame, fitted: FittedFeatures, keep: list[str]) -> DataFrame:
    """``keep`` columns, which must include the document id, plus ``values``, the stylometry as an array."""
    return _placed_style(docs, fitted, keep).select(*keep, F.array(*fitted.style_names).alias("values"))


def assemble(docs: DataFrame, fitted: FittedFeatures, keep: list[str]) -> DataFrame:
    """``keep`` columns, which must include the document id, plus ``features``."""
    if not fitted.plan.specs:
        return _placed_style(docs, fitted, keep).select(*keep, array_to_vector(F.array(*fitted.style_names)).alias("features"))
    vector = _sparse_udf(fitted.size)(F.col("_cells.i"), F.col("_cells.v"))
    return feature_cells(docs, fitted, keep).select(*keep, vector.alias("features"))


def embedding_style_vectors(df: DataFrame, train: DataFrame, keep: list[str], style: str = "v1") -> DataFrame:
    """Standardised embeddings followed by standardised stylometry; rows have ``embedding`` and ``text``.

    Stylometry that ``with_style`` has stored is read, not computed again.
    """
    names = STYLE[style]
    stats = cut_lineage(lexical.scaler(_style(train, style, ["doc_id"]), names))
    scaled = lexical.scale_embeddings(df, lexical.embedding_stats(train), [*keep, "text", *style_columns(df)])
    features = lexical.scale(_style(scaled, style, [*keep, "embedding"]), stats, names)
    return features.select(*keep, array_to_vector(F.concat("embedding", F.array(*names))).alias("features"))


def embedding_vectors(df: DataFrame, train: DataFrame, keep: list[str]) -> DataFrame:
    """Standardised precomputed embeddings; the statistics come from the training rows."""
    scaled = lexical.scale_embeddings(df, lexical.embedding_stats(train), keep)
    return scaled.select(*keep, array_to_vector("embedding").alias("features"))
