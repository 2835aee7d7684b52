import numpy as np
from pyspark.ml.linalg import Vectors

from inkmark.models.training import fit_sigmoid
from inkmark.sources.tables import read_table, read_tables


def test_sigmoid_equals_a_plain_fit_of_smoothed_targets(spark):
    rng = np.random.default_rng(7)
    label = (rng.random(300) < 0.3).astype(int)
    x = rng.normal(size=300) + label
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / (300 - label.sum() + 2))
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        hess = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, [((target - p) * x).sum(), (target - p).sum()])
    rows = [(float(y), Vectors.dense([float(v)])) for y, v in zip(label, x)]
    slope, intercept = fit_sigmoid(spark.createDataFrame(rows, ["label", "features"]))
    assert abs(slope - a) < 1e-6 and abs(intercept - b) < 1e-6


def test_source_file_where_the_root_occurs_twice_in_a_path(spark, tmp_path):
    root = tmp_path / "data"
    paths = [str(root / name / str(root).strip("/") / "f.parquet") for name in ("one", "two")]
    for i, path in enumerate(paths):
        spark.range(i, i + 1).write.parquet(path)
    found = {r.id: r.source_file for r in read_tables(spark, paths, str(root)).collect()}
    assert found == {i: p[len(str(root)) + 1 :] for i, p in enumerate(paths)}


def test_a_large_csv_is_split_where_fields_hold_no_line_ends(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,text\n" + "".join(f"{i},some words here\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        whole = read_table(spark, str(path), "id bigint, text string")
        split = read_table(spark, str(path), "id bigint, text string", multi_line=False)
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 3
        assert split.count() == whole.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
