"""Detectors learn a planted signal and nothing from shuffled labels."""

import random

import pytest

from inkmark.models import training as t
from inkmark.operators import metrics, splits
from inkmark.session import cut_lineage


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    common = [f"w{i:02d}x" for i in range(40)]
    rows = []
    for i in range(120):
        label = i % 2
        words = rng.choices(common, k=25) + rng.choices(["moreover", "delve", "tapestry"] if label else ["dunno", "gonna", "yeah"], k=4)
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ("." if label else "!!"), label))
    return cut_lineage(splits.split_stratified(spark.createDataFrame(rows, "doc_id long, text string, label int")))


def f1(recipe, planted):
    train, test = planted.filter("split = 'train'"), planted.filter("split = 'test'")
    return metrics.evaluate(t.train(recipe, train).score(test, ["doc_id", "label"]), []).first()["f1"]


@pytest.mark.parametrize("recipe", [t.CURRENT[0], t.CURRENT[1], t.EARLIER[2], t.EARLIER[4]], ids=lambda r: r.name)
def test_detectors_learn(planted, recipe):
    assert f1(recipe, planted) > 0.9


def test_forest_learns(planted):
    assert f1(t.Recipe("forest", t.CURRENT[2].plan, "forest", trees=10, max_depth=5), planted) > 0.9


def test_epochs_lower_the_loss(planted):
    from pyspark.sql import functions as F

    rows = planted.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    history = t.train_epochs(rows, epochs=3).orderBy("epoch").collect()
    assert [r["epoch"] for r in history] == [1, 2, 3]
    assert history[2]["train_loss"] < history[0]["train_loss"] and history[2]["val_f1"] > 0.9


def test_calibrated_roundtrip(spark, planted, tmp_path):
    train, test = planted.filter("split = 'train'"), planted.filter("split = 'test'")
    detector = t.train(t.EARLIER[2], train)
    t.save_detector(detector, str(tmp_path / "d"))
    loaded = t.load_detector(spark, t.EARLIER[2], str(tmp_path / "d"))
    left = {r["doc_id"]: r["score"] for r in detector.score(test, ["doc_id", "label"]).collect()}
    right = {r["doc_id"]: r["score"] for r in loaded.score(test, ["doc_id", "label"]).collect()}
    assert left == pytest.approx(right)
