"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its byte 3- and 4-grams (hashed into buckets, ASCII in lower case); a
softmax over it gives the languages. Embeddings and weights are trained by stochastic gradient descent in numpy. As the
softmax is linear in the mean, scoring needs only the product of both: one row of class scores per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import Block, blocks, bounded_sample, crc_mod, map_batches, table
from inkmark.llm.hashing import lowered

# Bound of the sample, and sizes of the model.
SAMPLE_DOCS = 2000
BUCKETS = 1 << 15  # numbers of two bytes
WIDTH = 16
EPOCHS = 8
RATE = 0.5
# Share of right predictions that may be rejected.
LOST_RIGHT = 0.01
SEED = 9
PIECE = 1 << 19


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the 3- and 4-grams that start at each byte of ``data`` but the last three; one column per length."""
    b = lowered(data).astype(np.uint32)
    three = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16
    four = three | b[3:] << 24
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.stack([three * np.uint32(2654435761) >> shift, (four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519) >> shift], axis=1)


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " + text + b"   ", dtype=np.uint8)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    cut: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    count = np.zeros(BUCKETS, dtype=np.int64)
    data = _padded(text)
    for low in range(0, len(data) - 3, PIECE):
        count += np.bincount(grams(data[low : low + PIECE + 3]).ravel(), minlength=BUCKETS)
    bucket = np.flatnonzero(count)
    return bucket, count[bucket] / count.sum()


def _train(profiles: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class scores per bucket and bias, by gradient descent over documents in random order."""
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, classes)), np.zeros(classes)
    total = EPOCHS * len(profiles)
    for step, i in enumerate(np.concatenate([rng.permutation(len(profiles)) for _ in range(EPOCHS)])):
        bucket, share = profiles[i]
        vector = share @ embed[bucket]
        logits = vector @ weights + bias
        error = _softmax(logits[None])[0]
        error[target[i]] -= 1
        rate = RATE * (1 - step / total)
        back = weights @ error
        weights -= rate * np.outer(vector, error)
        bias -= rate * 0.1 * error
        # every gram of the text moves by the mean's gradient, as its share of the text would make steps vanish
        embed[bucket] -= rate * back * np.minimum(1.0, share * 50)[:, None]
    return (embed @ weights).astype(np.float32), bias


def fit_language(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """A model from at most ``sample_docs`` rows of (doc_id, text, lang) with a language; None if there are none.

    Three quarters of the sample train; the rest calibrates the temperature and the rejection cut. Tasks send hashed
    profiles, not texts.
    """
    rows = bounded_sample(docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL"), sample_docs, ["doc_id", "text"], SEED)

    def profile(batch):
        pairs = [_profile(t) for b in blocks(batch.column(2)) for t in b.texts]
        bucket = [p[0].astype("<u2").tobytes() for p in pairs]
        return {"doc_id": batch.column(0), "lang": batch.column(1), "bucket": bucket, "share": [p[1].astype("<f4").tobytes() for p in pairs]}

    # six bytes per distinct bucket of a text: at most 200 kB a row, some 20 kB on average
    sample = map_batches(rows.select("doc_id", "lang", "text"), profile, "doc_id bigint, lang string, bucket binary, share binary")
    data = sorted((r.doc_id or 0, r.lang, bytes(r.bucket), bytes(r.share)) for r in sample.toLocalIterator())
    if not data:
        return None
    languages = sorted({d[1] for d in data})
    target = np.array([languages.index(d[1]) for d in data])
    profiles = [(np.frombuffer(d[2], dtype="<u2"), np.frombuffer(d[3], dtype="<f4")) for d in data]
    held = np.arange(len(data)) % 4 == 3
    scores, bias = _train([p for p, h in zip(profiles, held) if not h], target[~held], len(languages))
    model = LanguageModel(languages, scores, bias, 1.0, 0.0)
    if held.any():
        logits = np.array([s @ scores[b] + bias for (b, s), h in zip(profiles, held) if h])
        truth = target[held]
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 10, 40), key=loss))
        best = _softmax(logits / model.temperature)
        right = best.argmax(axis=1) == truth
        if right.any():
            model.cut = float(np.quantile(best.max(axis=1)[right], LOST_RIGHT))
    return model


def chances(block: Block, model: LanguageModel) -> np.ndarray:
    """Probabilities per text of a block; long texts are summed in pieces."""
    out = np.zeros((len(block.texts), len(model.languages)))
    for i in np.flatnonzero(block.sizes > PIECE):
        data = _padded(block.texts[i])
        for low in range(0, len(data) - 3, PIECE):
            out[i] += model.scores[grams(data[low : low + PIECE + 3])].sum(axis=(0, 1), dtype=np.float64)
    short = np.flatnonzero(block.sizes <= PIECE)
    for part in np.array_split(short, max(1, int(block.sizes[short].sum()) // PIECE)) if len(short) else []:
        joined = np.frombuffer(b"".join(b" " + block.texts[i] + b"   " for i in part), dtype=np.uint8)
        per_gram = model.scores[grams(joined)].sum(axis=1, dtype=np.float64)
        sizes = block.sizes[part] + 4
        first = np.cumsum(sizes) - sizes
        # every second sum is of the grams that cross into the next text, and is dropped
        bounds = np.stack([first, first + sizes - 3], axis=1).ravel()
        out[part] = np.add.reduceat(np.vstack([per_gram, np.zeros((4, per_gram.shape[1]))]), bounds, axis=0)[0::2]
    logits = out / (2 * (block.sizes + 1))[:, None] + model.bias
    return _softmax(logits / model.temperature)


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, accepted.

    A null text or one without a letter is ``und`` with score 0; otherwise the likeliest language with its calibrated
    probability, and ``accepted`` tells whether that reaches the rejection cut. Without a model all are ``und``. Null ids
    and repeated rows stay, other columns are ignored. No shuffle.
    """

    def guess(batch):
        letters = np.array(batch.column(2).to_pylist(), dtype=bool)
        if model is None:
            return {id_col: batch.column(0), "lang_pred": ["und"] * len(letters), "score": np.zeros(len(letters)), "accepted": ~letters & False}
        best = np.concatenate([chances(b, model) for b in blocks(batch.column(1))])
        names = [model.languages[i] if has else "und" for i, has in zip(best.argmax(axis=1).tolist(), letters)]
        score = np.where(letters, best.max(axis=1), 0.0)
        return {id_col: batch.column(0), "lang_pred": names, "score": score, "accepted": letters & (score >= model.cut)}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return map_batches(rows, guess, f"{id_col} {kind}, lang_pred string, score double, accepted boolean")


def op9_language(spark, sf_dir):
    """Language of every whole document; the held-out fold is not learned from."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(crc_mod("doc_id", 3) != 1))
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "accepted")
