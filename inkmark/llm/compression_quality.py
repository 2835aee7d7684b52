"""Quality by compression: texts like the good ones compress better with a dictionary built from good text.

Two zstandard dictionaries are trained, from good and from bad labelled text. Every text is cut into chunks, each chunk is
compressed with both, and the normalised difference of the summed sizes, (bad - good) / (bad + good), goes through a
calibration fitted on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import crc_mod, labelled_sample, map_batches, row_hash, table, texts_of

# Bounds of the training data: labelled documents, and chunks per class of about CHUNK bytes.
SAMPLE_DOCS = 6000
SAMPLE_CHUNKS = 6000
CHUNK = 768
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
CUT = 0.7
SEED = 7


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


_READY: dict[tuple[int, int], tuple] = {}


def _compressors(model: CompressionModel) -> tuple:
    """The worker's compressors for a model's dictionaries."""
    key = (hash(model.good), hash(model.bad))
    if key not in _READY:
        _READY.clear()
        _READY[key] = tuple(
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in (model.good, model.bad)
        )
    return _READY[key]


def chunks(text: bytes) -> list[bytes]:
    """The whole text in pieces of CHUNK bytes; an empty text has none."""
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def differences(texts: list[bytes], model: CompressionModel) -> np.ndarray:
    """Normalised difference of the compressed sizes per text; 0 for empty texts."""
    good, bad = _compressors(model)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        g = b = 0
        for part in chunks(text):
            g += len(good.compress(part))
            b += len(bad.compress(part))
        out[i] = (b - g) / max(b + g, 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic fit by Newton steps, lightly regularised."""
    scale = float(x.std()) or 1.0
    data = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(2), data.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chunks: int = SAMPLE_CHUNKS) -> CompressionModel | None:
    """Dictionaries and calibration from at most ``sample_docs`` labelled documents; None unless both classes occur.

    Half of the sample gives chunks for the dictionaries, at most ``sample_chunks`` per class by the hash of the chunk,
    from any place of a text; the other half gives the calibration.
    """
    rows = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), sample_docs, SEED)
    rows = rows.select("quality", "text", (row_hash("doc_id", seed=SEED + 1) < 0.5).alias("learn")).filter("quality IS NOT NULL")

    def cut(batch):
        parts = [(q, c) for q, t, use in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()) if use for c in chunks(t)]
        return {"quality": [q for q, _ in parts], "chunk": [c for _, c in parts]}

    # copies of a chunk count once, so a much copied text cannot fill a class
    pool = map_batches(rows, cut, "quality int, chunk binary").distinct()
    texts = {}
    for quality in (0, 1):
        own = pool.filter(F.col("quality") == quality).orderBy(F.xxhash64("chunk"), "chunk").limit(sample_chunks)
        texts[quality] = [bytes(r.chunk) for r in own.select("chunk").collect()]
    if not texts[0] or not texts[1]:
        return None
    model = CompressionModel(_dictionary(texts[1]), _dictionary(texts[0]), 1.0, 0.0)

    def measure(batch):
        return {"quality": batch.column(0), "x": differences(texts_of(batch.column(1)), model)}

    held = map_batches(rows.filter("NOT learn").select("quality", "text"), measure, "quality int, x double")
    points = sorted(tuple(r) for r in held.collect())
    if points:
        quality, x = (np.array(c, dtype=np.float64) for c in zip(*points))
        model.slope, model.offset = _logistic(x, quality)
    return model


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def score_quality(df: DataFrame, model: CompressionModel | None, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per input row: id, score (chance of label 1), predicted (1 if score >= ``cut``).

    A null or empty text has difference 0 and gets the calibrated score of that. Without a model every score is 0.5.
    Null ids and repeated rows stay, other columns are ignored. No shuffle.
    """

    def score(batch):
        texts = texts_of(batch.column(1))
        if model is None:
            scores = np.full(len(texts), 0.5)
        else:
            scores = 1 / (1 + np.exp(-np.clip(model.slope * differences(texts, model) + model.offset, -30, 30)))
        return {id_col: batch.column(0), "score": scores, "predicted": (scores >= cut).astype(np.int32)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), score, f"{id_col} {kind}, score double, predicted int")


def op7_quality_score(spark, sf_dir):
    """Score of every whole document; labels of the held-out fold are never read into the model."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    held_out = (crc_mod("doc_id", 4) == 2).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", "predicted")
