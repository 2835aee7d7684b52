import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkmark.llm import compression_quality as cq
from inkmark.llm import language as lg
from inkmark.llm import quality_rules as qr
from inkmark.llm.boosting import BoostedTrees, cautious_threshold
from inkmark.llm.isolation import IsolationForest
from tests.llm.cases import odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def rule_counts(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check_rules(rows, texts):
    for r in rows:
        want = rule_counts(texts[r.doc_id])
        assert tuple(r[c] for c in qr.STATISTICS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed
        assert not (failed and r.kept)


def test_op8_counts_and_verdicts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = qr.op8_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_rules(rows, texts)


def test_forest_rejects_bad_and_keeps_good_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    # even ids teach, odd ids test
    model = qr.fit_rules(docs, labels.filter("doc_id % 2 = 0"))
    rows = qr.apply_rules(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.6


def test_rules_of_odd_rows(spark):
    rows = odd_rows(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for model in (None, qr.fit_rules(docs, labels)):
        got = sorted((str(r.doc_id), *(r[c] for c in qr.STATISTICS)) for r in qr.apply_rules(rows, model).collect())
        assert got == sorted((str(r.doc_id), *rule_counts(r.text)) for r in rows.select("doc_id", "text").collect())
    assert qr.apply_rules(rows.limit(0), None).collect() == []
    assert qr.fit_rules(docs, labels.limit(0)) is None
    assert qr.fit_rules(docs.limit(0), labels) is None


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 1, (500, 3)), [[8, 8, 8], [-9, 0, 9]]])
    scores = IsolationForest(rows).scores(rows)
    assert set(np.argsort(-scores)[:2]) == {500, 501}
    assert np.ptp(IsolationForest(np.ones((5, 2))).scores(np.ones((3, 2)))) == 0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    rows = rng.uniform(-1, 1, (4000, 4))
    target = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.2)).astype(float)
    chances = BoostedTrees(rows[:2000], target[:2000]).chances(rows[2000:])
    assert ((chances > 0.5) == target[2000:]).mean() > 0.95
    cut = cautious_threshold(chances, target[2000:], 0.99)
    assert target[2000:][chances >= cut].mean() >= 0.99
    assert cautious_threshold(np.ones(3), np.zeros(3), 0.9) == 2.0


def area(good, bad):
    good, bad = np.array(good), np.array(bad)
    return (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()


def test_op7_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = cq.op7_quality_score(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert area([s for q, s, _ in held if q == 1], [s for q, s, _ in held if q == 0]) > 0.9
    assert np.mean([p for q, _, p in held if q == 1]) > 0.98
    assert np.mean([p for q, _, p in held if q == 0]) < 0.25


def test_scores_of_odd_rows(spark):
    rows = odd_rows(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = cq.fit_quality(docs, labels)
    got = cq.score_quality(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (2, 3)}
    assert len(empty) == 1
    assert {r.score for r in cq.score_quality(rows, None).collect()} == {0.5}
    assert cq.fit_quality(docs, labels.filter("quality = 1")) is None
    assert cq.score_quality(rows.limit(0), model).collect() == []


def test_op9_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    rows = lg.op9_language(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99
    assert np.mean([r.accepted for r in held]) > 0.97


def test_language_of_odd_rows(spark):
    rows = odd_rows(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lg.fit_language(docs)
    got = sorted(((r.doc_id, r.lang_pred, r.score, r.accepted) for r in lg.identify(rows, model).collect()), key=str)
    assert len(got) == rows.count()
    und = [r for r in got if r[0] in (2, 3, 4, 9)]
    assert all(r[1:] == ("und", 0.0, False) for r in und)
    assert all(r[1] in model.languages for r in got if r[0] in (1, 5, 7, 8))
    assert {r.lang_pred for r in lg.identify(rows, None).collect()} == {"und"}
    assert lg.fit_language(docs.filter("lang IS NULL")) is None
    assert lg.identify(rows.limit(0), model).collect() == []


@pytest.mark.parametrize("piece", [64, 1 << 19])
def test_language_scores_are_plain_means(monkeypatch, piece):
    from inkmark.llm.arrow import Block

    monkeypatch.setattr(lg, "PIECE", piece)
    rng = np.random.default_rng(2)
    model = lg.LanguageModel(["a", "b"], rng.normal(size=(lg.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]), 0.7, 0.0)
    texts = [b"", b"abc", b"The quick brown fox", b"jumps over " * 30]
    want = []
    for t in texts:
        bucket, share = lg._profile(t)
        want.append(lg._softmax(((share @ model.scores[bucket] + model.bias) / 0.7)[None])[0])
    assert np.allclose(lg.chances(Block(texts, 0), model), want, atol=1e-5)
