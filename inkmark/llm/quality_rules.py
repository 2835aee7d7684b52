"""Quality rules: statistics per text, hard limits, and an isolation forest on the statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import Block, blocks, bounded_sample, map_batches, stored, table
from inkmark.llm.hashing import combine, is_space, span_hashes, words_of
from inkmark.llm.isolation import IsolationForest

# Rows per tree and trees, share of the good calibration rows that may be lost, and the hard limits.
TREE_ROWS = 256
TREES = 100
LOST_GOOD = 0.005
RARE = 0.02
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SEED = 8
# Steps in which feature values and scores are counted, and the bound of the former.
VALUE_STEP = 1 / 256
LARGEST = 64.0
SCORE_STEP = 1 / 65536

_KINDS = {
    "symbols": b"#*$%&|<>",
    "marks": b"!?;:.,",
    "digits": b"0123456789",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
}
_WEIGHTS = {name: np.isin(np.arange(256), list(chars)) for name, chars in _KINDS.items()}
_CONTENT = np.array([not is_space(b) and b & 0xC0 != 0x80 for b in range(256)])
_SPACES = b" \t\n\r\x0b\x0c"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(hashes: np.ndarray) -> int:
    """Words in windows whose hash occurs twice or more."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(hashes, twice)
    edge = np.zeros(len(hashes) + WINDOW + 1, dtype=np.int64)
    edge[: len(hashes)] += hit
    edge[WINDOW : WINDOW + len(hashes)] -= hit
    return int(np.count_nonzero(np.cumsum(edge)))


def statistics(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract, and the features of the forest, one row per text."""
    starts, ends = words_of(block.data)
    bounds = block.counts(starts)
    words = np.diff(bounds)
    windows = combine(span_hashes(block.data, starts, ends), WINDOW)
    repeated = np.array(
        [_repeated(windows[a : b - WINDOW + 1]) if b - a > WINDOW else 0 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
        dtype=np.int64,
    )
    lines = [[line for line in text.split(b"\n") if line.strip(_SPACES)] for text in block.texts]
    n_lines = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    copies = n_lines - np.fromiter((len(set(x)) for x in lines), dtype=np.int64, count=len(lines))
    kinds = {name: block.sums(weight[block.data]) for name, weight in _WEIGHTS.items()}
    chars = block.sums(_CONTENT[block.data])
    counts = dict(zip(STATISTICS, (words, chars, kinds["symbols"], copies, repeated)))
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    letters = np.maximum(kinds["upper"] + kinds["lower"], 1)
    shares = (
        kinds["symbols"] / per_char,
        kinds["marks"] / per_char,
        kinds["digits"] / per_char,
        kinds["upper"] / letters,
        copies / np.maximum(n_lines, 1),
        repeated / per_word,
    )
    # shares on a log scale, so that random cuts fall between small values too
    return counts, np.stack([chars / per_word, *(np.log(x + 0.01) for x in shares)], axis=1)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def _separation(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Per feature, how far the ranks of good and bad rows lie apart, from their counts per step: 0.02 (not at all) to 1."""
    below = good.cumsum(axis=1) - good / 2
    area = (below * bad).sum(axis=1) / np.maximum(good.sum(axis=1) * bad.sum(axis=1), 1)
    return np.where(bad.sum(axis=1) > 0, np.maximum(0.02, abs(2 * area - 1)), 1.0)


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, learn, features) of all labelled documents that pass the hard limits; texts do not move.

    Every second document, by its id, is one to learn from.
    """

    def measure(batch):
        parts = [statistics(b) for b in blocks(batch.column(1))]
        failed = np.concatenate([base_failed(c) for c, _ in parts])
        return {"doc_id": batch.column(0), "failed": failed, "features": list(np.concatenate([f for _, f in parts]))}

    measured = map_batches(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), measure, "doc_id bigint, failed boolean, features array<double>")
    marked = labels.filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = measured.filter("NOT failed").join(marked, "doc_id")
    return rows.select("doc_id", "good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("learn"), "features")


def fit_rules(docs: DataFrame, labels: DataFrame, lost_good: float = LOST_GOOD):
    """(forest, threshold) from all labelled documents, or None with few good rows.

    The forest learns from half of the good rows that pass the hard limits, with so few bad rows among them
    (``RARE``) that these stay anomalies yet stretch the ranges which the random splits cut. Splits draw a feature the
    more often the better it tells labelled good from bad rows, squared. Each tree takes its random splits from
    ``TREE_ROWS`` rows of its own, which is the method; the odds of the features, the masses of the leaves and the threshold
    are counted over all rows. The threshold is the lowest score that loses no more than ``lost_good`` of the other good
    rows. The driver gets the trees' rows, and counts per step or leaf, whose number is bounded.
    """
    rows = stored(labelled_features(docs, labels), "labelled")
    total = {(r.good, r.learn): r.n for r in rows.groupBy("good", "learn").agg(F.count(F.lit(1)).alias("n")).collect()}
    goods, bads = total.get((True, True), 0), total.get((False, True), 0) + total.get((False, False), 0)
    if goods < 2 or total.get((True, False), 0) < 2:
        return None
    learned = rows.filter("learn OR NOT good")
    step = F.floor(F.least("value", F.lit(LARGEST)) / VALUE_STEP)
    values = learned.select("good", F.posexplode("features").alias("feature", "value")).groupBy("good", "feature", step.alias("step"))
    values = values.agg(F.count(F.lit(1)).alias("n")).collect()
    low = min(v.step for v in values)
    counts = np.zeros((2, 1 + max(v.feature for v in values), 1 + max(v.step for v in values) - low))
    for v in values:
        counts[int(v.good), v.feature, v.step - low] = v.n
    weights = _separation(counts[1], counts[0]) ** 2

    def drawn(condition: str, number: int) -> np.ndarray:
        picked = bounded_sample(rows.filter(condition), number, ["doc_id", "features"], SEED).select("features").collect()
        return np.array([r.features for r in picked]).reshape(-1, counts.shape[1])

    pool = drawn("good AND learn", TREES * TREE_ROWS)
    rare = int(RARE * len(pool))
    pool = np.concatenate([pool, drawn("NOT good", rare)]) if rare and bads else pool
    forest = IsolationForest(pool, TREES, TREE_ROWS, SEED, weights)

    def fall(batch):
        data, good = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = {"tree": [], "cell": [], "n": []}
        for tree, leaf in enumerate(forest.leaves(data)):
            cell, n = np.unique(2 * leaf + good, return_counts=True)
            for name, value in (("tree", np.full(len(cell), tree)), ("cell", cell), ("n", n)):
                out[name].append(value)
        return {name: np.concatenate(value) for name, value in out.items()}

    fallen = map_batches(learned.select("good", "features"), fall, "tree int, cell int, n bigint")
    masses = [np.zeros(len(tree[0])) for tree in forest.trees]
    share = min(1.0, RARE * goods / max(bads, 1))
    for r in fallen.groupBy("tree", "cell").agg(F.sum("n").alias("n")).collect():
        masses[r.tree][r.cell // 2] += r.n * (1.0 if r.cell % 2 else share)
    forest.weigh(masses)

    def judge(batch):
        step, n = np.unique(np.ceil(forest.scores(_matrix(batch.column(0))) / SCORE_STEP), return_counts=True)
        return {"step": step.astype(np.int64), "n": n}

    judged = map_batches(rows.filter("good AND NOT learn").select("features"), judge, "step bigint, n bigint")
    steps = sorted((r.step, r.n) for r in judged.groupBy("step").agg(F.sum("n").alias("n")).collect())
    passed = np.cumsum([n for _, n in steps])
    return forest, steps[int(np.argmax(passed >= (1 - lost_good) * passed[-1]))][0] * SCORE_STEP


def _matrix(features) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    return features.flatten().to_numpy().reshape(len(features), -1)


def apply_rules(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns named in ``keep``, the counts, ``anomaly``, ``base_failed`` and ``kept``.

    A null text has no words and fails the hard limits. Null ids and repeated rows stay; columns that are not named are
    ignored. Without a model the hard limits decide alone. No shuffle.
    """
    extra = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def judge(batch):
        parts = [statistics(b) for b in blocks(batch.column(1))]
        counts = {name: np.concatenate([c[name] for c, _ in parts]) for name in STATISTICS}
        failed = base_failed(counts)
        if model is None:
            scores, usual = np.zeros(len(failed)), np.ones(len(failed), dtype=bool)
        else:
            scores = model[0].scores(np.concatenate([f for _, f in parts]))
            usual = scores <= model[1]
        passed = {c: batch.column(2 + i) for i, c in enumerate(keep)}
        return {id_col: batch.column(0), **passed, **counts, "anomaly": scores, "base_failed": failed, "kept": usual & ~failed}

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join(
        filter(None, [f"{id_col} {kind}", extra, *(f"{c} bigint" for c in STATISTICS), "anomaly double, base_failed boolean, kept boolean"])
    )
    return map_batches(df.select(id_col, text_col, *keep), judge, schema)


def op8_quality_rules(spark, sf_dir):
    """Rule statistics and verdict of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
