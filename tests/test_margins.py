"""Squared-hinge machines: optimum, shared passes, shared vocabularies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmark.models import margins
from inkmark.models import training as t
from inkmark.operators import lexical


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(200):
        label = int(i % 3 == 0)
        ids = sorted(rng.choice(12, 4, replace=False).tolist())
        data.append((i, label, 0.75 if label else 1.5, i % 3 if i % 7 else 1, [(j, float(rng.normal() + label * (j < 6))) for j in ids]))
    schema = "doc_id bigint, label int, class_weight double, _fold int, _cells array<struct<i:int,v:double>>"
    return spark.createDataFrame(data + [(200, 1, 1.0, 0, [])], schema).repartition(5).cache()


def dense(rows):
    x, y, weight, fold = np.zeros((201, 13)), np.zeros(201), np.zeros(201), np.zeros(201)
    for r in rows.collect():
        for c in r["_cells"]:
            x[r.doc_id, c.i] = np.float32(c.v)
        y[r.doc_id], weight[r.doc_id], fold[r.doc_id] = 2 * r.label - 1, r.class_weight, r["_fold"]
    x[:, 12] = 1
    return x, y, weight, fold


def optimum(x, y, weight):
    w = np.zeros(x.shape[1])
    for _ in range(100):
        short = 1 - y * (x @ w)
        used = weight * (short > 0)
        hessian = np.eye(len(w)) + 2 * (x * used[:, None]).T @ x
        w = w - np.linalg.solve(hessian, w - 2 * x.T @ (used * y * short))
    return w


def test_machines_reach_the_optimum_of_their_rows(rows):
    fitted = margins.fit_squared_hinge(rows, 12, 201, (0, 1, 2), tolerance=1e-12)
    x, y, weight, fold = dense(rows)
    for k, machine in enumerate(fitted):
        expected = optimum(x, y, np.where(fold == k, 0.0, weight))
        assert np.append(machine.weights, machine.bias) == pytest.approx(expected, abs=1e-4)
    scored = {r.doc_id: r.margins for r in margins.add_margins(rows, fitted, ["doc_id"]).collect()}
    assert len(scored) == 201
    for k, machine in enumerate(fitted):
        assert [scored[i][k] for i in range(201)] == pytest.approx((x[:, :12] @ machine.weights + machine.bias).tolist(), abs=1e-5)


def test_folds_share_the_passes_of_one_machine(rows, monkeypatch):
    counts = []
    direction = margins._direction
    monkeypatch.setattr(margins, "_direction", lambda *a: counts.append(1) or direction(*a))
    margins.fit_squared_hinge(rows, 12, 201, (0, 1, 2))
    assert len(counts) < 100


def test_recipes_with_equal_terms_share_one_vocabulary(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"shared words and more{i % 3} words", i % 2) for i in range(12)], "doc_id bigint, text string, label int")
    fits = []
    fit = lexical.fit_vocabulary
    monkeypatch.setattr(lexical, "fit_vocabulary", lambda d, specs, **k: fits.append(specs) or fit(d, specs, **k))
    known = {}
    features = [t.fit_features(docs, r.plan(), known=known) for r in (t.EARLIER[0], t.EARLIER[2], t.EARLIER[4])]
    assert len(fits) == 2
    apart = fit(docs, t.EARLIER[4].plan().specs)
    columns = ["block", "term", "df", "cf", "idf", "term_id"]
    assert sorted(map(tuple, features[2].vocabulary.select(columns).collect())) == sorted(map(tuple, apart.select(columns).collect()))
    assert features[2].n_terms == apart.count() and features[0].vocabulary.filter(F.col("block") != 0).count() == 0


def test_forest_keeps_its_nodes_and_stays_the_same(spark):
    from pyspark.ml.functions import array_to_vector

    data = [(i % 2, 1.0, [float(i % 17), float((i * 7) % 23), float(i % 2) + (i % 5) / 4]) for i in range(300)]
    rows = spark.createDataFrame(data, "label int, class_weight double, f array<double>").select("label", "class_weight", array_to_vector("f").alias("features")).cache()
    forest = t._forest(t.Recipe("forest", t.CURRENT[2].plan, "forest", trees=8))
    assert forest.getCacheNodeIds()
    kept, walked = forest.fit(rows), forest.copy().setCacheNodeIds(False).fit(rows)
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_embedding_vectors_read_stored_stylometry(spark):
    from inkmark.models.vectors import FeaturePlan, embedding_style_vectors, with_style

    rows = [(i, f"a text of {i} words, or so{'!' * (i % 3)}", [float(i), float(i % 4)]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, embedding array<double>")
    kept = with_style(docs, [FeaturePlan(style="v1")])
    plain, again = (
        {r.doc_id: r.features.toArray() for r in embedding_style_vectors(d, d, ["doc_id"]).collect()} for d in (docs, kept.withColumn("text", F.lit("other")))
    )
    assert plain.keys() == again.keys() and all(abs(plain[k] - again[k]).max() < 1e-9 for k in plain)
