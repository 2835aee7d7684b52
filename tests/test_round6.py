"""Whole results and growth: near-duplicates over pairs of blocks, forests grown per tree, fits over compact blocks."""

import numpy as np
import pytest

from inkmark.operators import near_duplicates as nd
from inkmark.operators import vector_blocks as vb
from tests.test_operators import brute_force_partners, family_texts

FINDERS = (nd.earliest_partners, nd.hyperplane_partners, nd.minhash_partners)


@pytest.mark.parametrize("find", FINDERS)
def test_every_near_duplicate_has_its_earliest_partner(spark, find):
    texts = family_texts()
    expected = brute_force_partners(texts)
    got = {r["id"]: r["partner"] for r in find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == expected and len(got) > 60


@pytest.mark.parametrize("find", FINDERS)
def test_minhash_keeps_pairs_that_share_few_terms(spark, find):
    # one long word many times over gives the vectors their direction; the many other words differ
    heavy = " ".join(["incomprehensibilities"] * 400)
    texts = {i: heavy + " " + " ".join(f"{chr(97 + i)}{j:03d}x" for j in range(60)) for i in range(4)}
    got = {r["id"]: r["partner"] for r in find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0} == brute_force_partners(texts)


@pytest.mark.parametrize("find", FINDERS)
def test_rows_without_id_or_text_and_shared_ids(spark, find):
    word = "the quick brown fox jumps over the lazy dog "
    rows = [(None, word * 3), (None, word * 3), (1, None), (2, ""), (3, word * 3), (3, word * 3 + "end"), (4, word * 3 + "ends"), (4, "zebra"), (5, "a")]
    got = sorted((r["id"], r["partner"]) for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(4, 3)]
    assert find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_more_shared_terms_than_tasks_look_up(spark, monkeypatch):
    monkeypatch.setattr(nd, "LOOKUP_TERMS", 0)
    texts = family_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: r["partner"] for r in nd.earliest_partners(docs).collect()} == brute_force_partners(texts)


def test_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 300, 200)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    terms = np.concatenate([np.sort(rng.choice(9000, n, replace=False)) for n in sizes]).astype(np.int32)
    weights = rng.random(len(terms))
    weights /= np.sqrt(np.add.reduceat(weights * weights, starts[:-1]))[np.repeat(np.arange(200), sizes)]
    v = vb.Vectors(np.arange(200), starts, terms, weights).profiled()
    dense = np.zeros((200, 9000))
    dense[np.repeat(np.arange(200), sizes), terms] = weights
    assert (v.fine @ v.fine.T >= dense @ dense.T - vb.ROUNDING).all() and (v.coarse @ v.coarse.T >= v.fine @ v.fine.T - vb.ROUNDING).all()


def _xor(n=600):
    rng = np.random.default_rng(1)
    values = np.round(rng.random((n, 4)), 3)
    return values, ((values[:, 0] > 0.5) ^ (values[:, 2] > 0.5)).astype(int)


def test_tree_learns_what_it_drew():
    from inkmark.models import forest

    values, label = _xor()
    x = forest._binned(values, [np.linspace(0, 1, 33)[1:-1]] * 4)
    tree, gained = forest.grow(x, label, np.ones(len(x)), 30, [42, 0])
    drawn = np.random.default_rng([42, 0]).poisson(1.0, len(x)) > 0
    # a leaf stays mixed only where none of the drawn features parts it
    assert ((forest.votes(tree, x)[drawn] > 0.5) == label[drawn]).mean() > 0.95 and gained[[0, 2]].sum() > 0.6
    stump, _ = forest.grow(x, label, np.ones(len(x)), 0, [42, 0])
    assert len(set(forest.votes(stump, x))) == 1


def test_forest_lives_in_tables(spark, tmp_path):
    from inkmark.models.forest import Forest

    values, label = _xor()
    rows = [(i, v.tolist(), int(y), 1.0) for i, (v, y) in enumerate(zip(values, label))] + [(0, values[0].tolist(), int(label[0]), 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, values array<double>, label int, class_weight double")
    model = Forest.fit(frame.repartition(5), 4, 20, 30, 7)
    # the driver held every tree of the model before; now a tree is a row of a table, grown in its own task
    assert model.trees.count() == 20 and not hasattr(model, "featureImportances")
    scored = {(r["doc_id"], r["label"]): (r["score"], r["prediction"]) for r in model.score(frame, ["doc_id", "label"]).collect()}
    assert sum(p == y for (_, y), (_, p) in scored.items()) > 0.95 * len(label)
    importance = model.importances()
    assert importance.sum() == pytest.approx(1.0) and importance[[0, 2]].min() > importance[[1, 3]].max()
    # the same trees however the rows are dealt, and after reloading
    again = Forest.fit(frame.coalesce(1), 4, 20, 30, 7)
    again.save(str(tmp_path / "f"))
    loaded = Forest.load(spark, str(tmp_path / "f"))
    assert {(r["doc_id"], r["label"]): (r["score"], r["prediction"]) for r in loaded.score(frame, ["doc_id", "label"]).collect()} == {
        k: (pytest.approx(s), p) for k, (s, p) in scored.items()
    }


def test_few_values_are_bins_of_their_own(spark):
    from inkmark.models import forest

    rows = [([float(i % 3), 0.5, float(i)],) for i in range(500)] + [([7.0, 0.5, 3.0],)]
    cuts = forest._cuts(spark.createDataFrame(rows, "values array<double>").repartition(3), 3)
    assert cuts[0].tolist() == [0.0, 1.0, 2.0] and cuts[1].tolist() == [] and 28 <= len(cuts[2]) <= 31


def _cells(spark, n=300, width=9):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((n, width)) < 0.5, np.float32(rng.normal(size=(n, width))), 0.0)
    label = (dense[:, 0] - dense[:, 1] + rng.normal(size=n) > 0).astype(int)
    rows = [(int(y), 0.5 + int(y), [(j, float(v)) for j, v in enumerate(r) if v]) for r, y in zip(dense, label)]
    schema = "label int, class_weight double, _cells array<struct<i:int,v:double>>"
    return spark.createDataFrame(rows, schema).repartition(4), dense, label


def test_logistic_blocks_reach_the_optimum(spark):
    from pyspark.sql import functions as F

    from inkmark.models.margins import Blocks, fit_blocks

    frame, dense, label = _cells(spark)
    x, weight, w = np.column_stack((dense, np.ones(len(dense)))), 0.5 + label, np.zeros(10)
    penalty = np.append(np.ones(9), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(np.diag(penalty) + (x * (weight * p * (1 - p))[:, None]).T @ x, x.T @ (weight * (p - label)) + penalty * w)
    blocks = Blocks(frame.withColumn("_fold", F.lit(0)), 9)
    assert 0 < blocks.bytes < 60_000
    # a job per step, and all steps inside one task
    for alone in (0, 1 << 20):
        (machine,) = fit_blocks(blocks, tolerance=1e-13, logistic=True, alone=alone)
        assert np.append(machine.weights, machine.bias) == pytest.approx(w, abs=1e-4)


def test_small_fits_run_no_job_per_step(spark, monkeypatch):
    from inkmark.models import margins

    frame, _, _ = _cells(spark)
    monkeypatch.setattr(margins.Blocks, "total", lambda *a: pytest.fail("a job per step"))
    assert len(margins.fit_squared_hinge(frame.selectExpr("*", "0 AS _fold"), 9)) == 1


def test_rows_without_cells_have_the_bias_as_margin():
    from inkmark.models.margins import _margins

    found = _margins(np.array([0, 2, 0, 1, 0]), np.array([1, 2, 1], np.int32), np.array([1.0, 2.0, 3.0]), np.array([[0.0, 5.0, 7.0]]), np.array([0.5]))
    assert found.ravel().tolist() == [0.5, 19.5, 0.5, 15.5, 0.5]
    assert _margins(np.zeros(2, int), np.zeros(0, int), np.zeros(0), np.ones((1, 3)), np.array([0.5])).ravel().tolist() == [0.5, 0.5]


def test_logistic_detector_roundtrip(spark, tmp_path):
    from inkmark.models import training as t

    docs = spark.createDataFrame([(i, f"{'alpha beta' if i % 2 else 'gamma delta'} word{i % 5}", i % 2) for i in range(40)], "doc_id bigint, text string, label int")
    detector = t.train(t.CURRENT[0], docs)
    scored = {r.doc_id: (r.score, r.prediction) for r in detector.score(docs, ["doc_id"]).collect()}
    assert all(p == i % 2 and 0 < s < 1 and (s > 0.5) == p for i, (s, p) in scored.items())
    t.save_detector(detector, str(tmp_path / "l"))
    again = t.load_detector(spark, t.CURRENT[0], str(tmp_path / "l")).score(docs, ["doc_id"])
    assert {r.doc_id: (r.score, r.prediction) for r in again.collect()} == scored
