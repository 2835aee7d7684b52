"""Invariants, edge cases and skewed inputs of the operators."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from inkmark.functions import stylometry
from inkmark.models.transformer import StylometricFeatures
from inkmark.operators import audits, columns, dedup, metrics, splits
from inkmark.operators.near_duplicates import earliest_partners, hyperplane_partners, minhash_partners
from inkmark.sources import tables
from inkmark.streaming import jobs
from tests.test_functions import word_boundary_grams


def labelled(spark, n=1000, ai_every=3):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % ai_every == 0, 1).otherwise(0).alias("label"),
        F.concat(F.lit("g"), F.col("id") % 37).alias("grp"), F.lit("x").alias("text"),
    )


def sides(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_split_sizes(spark):
    rows = labelled(spark)
    assert sides(splits.split_stratified(rows)) == {"train": 800, "test": 200}
    assert sides(splits.split_three_way(rows)) == {"train": 700, "val": 150, "test": 150}
    # sizes published for 6,406 rows
    assert sides(splits.split_three_way(labelled(spark, 6406))) == {"train": 4484, "val": 961, "test": 961}


def test_grouped_split_keeps_groups_together(spark):
    split = splits.split_grouped(labelled(spark), "grp")
    assert split.groupBy("grp").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    groups = {r["split"]: r["g"] for r in split.groupBy("split").agg(F.count_distinct("grp").alias("g")).collect()}
    assert groups == {"test": 8, "val": 6, "train": 23}


def test_grouped_split_with_one_hot_group(spark):
    hot = labelled(spark).withColumn("grp", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("grp")))
    assert splits.split_grouped(hot, "grp").count() == 1000


def test_split_needs_groups(spark):
    with pytest.raises(Exception, match="three groups"):
        splits.split_grouped(labelled(spark).withColumn("grp", F.lit("one")), "grp").count()


def test_balanced_sample_needs_both_classes(spark):
    with pytest.raises(Exception, match="both classes"):
        splits.sample_balanced(labelled(spark).filter("label = 0"), 10, 10).count()


def test_disjoint_holdout_has_no_overlap(spark):
    rows = labelled(spark).select(
        "doc_id", "label", F.lit("d").alias("domain"), F.when(F.col("label") == 1, "m").otherwise("human").alias("model")
    )
    rows = rows.withColumn("model", F.when(F.col("label") == 1, F.concat("model", F.col("doc_id") % 2)).otherwise("human"))
    held = splits.split_generator_holdout(rows, min_rows=20)
    assert held.groupBy("holdout", "doc_id").count().filter("count > 1").count() == 0
    reference = splits.split_generator_holdout(rows, min_rows=20, mode="reference")
    assert reference.groupBy("holdout", "doc_id").count().filter("count > 1").count() > 0


@pytest.mark.parametrize("digits", [1, 2, 12])
def test_auc_equals_spark_evaluator(spark, digits):
    rng = random.Random(digits)
    rows = [(rng.randint(0, 1), round(rng.random(), digits)) for _ in range(3000)]
    scored = spark.createDataFrame(rows, "label int, score double")
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    expected = evaluator.evaluate(scored.withColumn("label", F.col("label").cast("double")))
    for buckets in (2, 256):
        assert metrics.roc_auc(scored, [], buckets).first()["roc_auc"] == pytest.approx(expected, abs=1e-6)


def test_metric_edge_cases(spark):
    rows = [("one class", 1, 1, 0.9), ("one class", 1, 0, 0.1), ("tied", 0, 0, 0.5), ("tied", 1, 0, 0.5)]
    scored = spark.createDataFrame(rows, "g string, label int, prediction int, score double")
    got = {r["g"]: r for r in metrics.evaluate(scored, ["g"]).collect()}
    assert got["one class"]["roc_auc"] is None and got["one class"]["recall"] == 0.5
    assert got["tied"]["roc_auc"] == 0.5 and got["tied"]["precision"] == 0.0 and got["tied"]["f1"] == 0.0


def test_class_weights_sum_to_n(spark):
    from inkmark.operators.lexical import class_weights

    assert sum(r["n"] * r["weight"] for r in class_weights(labelled(spark)).collect()) == pytest.approx(1000, abs=1e-2)


def test_vocabulary_uses_training_rows_only(spark):
    from inkmark.functions.ngrams import WORD_MAXDF
    from inkmark.operators.lexical import fit_vocabulary

    rows = spark.createDataFrame(
        [(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "delta epsilon"), (5, "delta epsilon")], "doc_id long, text string"
    )
    vocabulary = fit_vocabulary(rows.filter("doc_id <= 3"), [WORD_MAXDF])
    assert {r["term"] for r in vocabulary.collect()} == {"alpha", "beta", "alpha beta"}


def test_conflicts_and_copies_with_a_hot_text(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "Hot Text").otherwise(F.concat(F.lit("text "), F.col("id") % 1000)).alias("text"),
        F.when(F.col("id") == 7, 1).otherwise(0).alias("label"),
    )
    clean = dedup.clean_strict(rows, "doc_id")
    got = {r["content_norm"]: r["doc_id"] for r in clean.collect()}
    expected = {}
    by_key = {}
    for i in range(3000):
        by_key.setdefault("hot text" if i % 3 == 0 else f"text {i % 1000}", []).append(i)
    for key, ids in by_key.items():
        if not (7 in ids and len(ids) > 1):
            expected[key] = min(ids)
    assert got == expected


def brute_force_partners(texts, threshold=0.9):
    grams = {i: Counter(word_boundary_grams(t, 4, 5)) for i, t in texts.items()}
    df = Counter(g for c in grams.values() for g in c)
    unit = {}
    for i, counts in grams.items():
        w = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {g: x / norm for g, x in w.items()}
    out = {}
    for b in sorted(texts):
        for a in sorted(texts):
            if a >= b:
                break
            if sum(x * unit[b].get(g, 0.0) for g, x in unit[a].items()) >= threshold:
                out[b] = a
                break
    return out


def family_texts():
    """A family of edited copies that holds a third of the rows, chains of drifting copies, and others."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(150)]
    texts = {}
    base = rng.choices(words, k=60)
    drift = rng.choices(words, k=60)
    for i in range(150):
        if i % 3 == 0:
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(60)] = rng.choice(words)
        elif i % 3 == 1:
            drift[rng.randrange(60)] = rng.choice(words)
            copy = list(drift)
        else:
            copy = rng.choices(words, k=60)
        texts[i] = " ".join(copy)
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = family_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_force_partners(texts)
    got = {r["id"]: r["partner"] for r in earliest_partners(docs).collect()}
    assert got == expected and len(got) > 60
    found = {r["id"]: r["partner"] for r in hyperplane_partners(docs).collect()}
    assert sum(found.get(i) == p for i, p in expected.items()) >= 0.95 * len(expected) and set(found) <= set(expected)
    approximate = {r["id"] for r in minhash_partners(docs).collect()}
    assert approximate <= set(expected) and len(approximate) > len(expected) // 2


def test_quarantine_rejects_the_whole_source(spark):
    rows = [("a", 1), ("a", None), ("b", 0), ("b", 1)]
    feed = spark.createDataFrame(rows, "source_file string, label int")
    kept, rejected = columns.quarantine_sources(feed)
    assert {r["source_file"] for r in kept.collect()} == {"b"}
    assert [r["source_file"] for r in rejected.collect()] == ["a"]


def test_leaky_columns_are_refused():
    with pytest.raises(ValueError, match="must not reach features"):
        columns.check_features_safe(["doc_id", "text", "generator"])


def test_leakage_report_flags_planted_column(spark):
    meta = labelled(spark).select("doc_id", "label", F.when(F.col("label") == 1, "m").otherwise("none").alias("ai_model"), "grp")
    report = {r["column_name"]: r for r in audits.metadata_leakage(meta, "label").collect()}
    assert report["ai_model"]["risk"] == "high" and report["grp"]["risk"] == "low" and "doc_id" not in report


def test_json_array_and_first_table(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x\ny", "label": 1}, {"text": "z", "label": 0}]))
    assert tables.read_table(spark, str(tmp_path / "b.json")).count() == 2
    assert tables.find_first_table(spark, str(tmp_path)).endswith("b.json")
    (tmp_path / "c.csv").write_text('text,label\n"two\nlines, ""quoted""",1\n')
    assert tables.find_first_table(spark, str(tmp_path)).endswith("c.csv")
    assert tables.read_table(spark, str(tmp_path / "c.csv")).first()["text"] == 'two\nlines, "quoted"'
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, str(tmp_path / "d.xml"))
    with pytest.raises(ValueError, match="misses"):
        tables.require_clean_contract(tables.read_table(spark, str(tmp_path / "c.csv")))


def test_stream_equals_batch(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = jobs.file_stream(spark, sf_dir, "documents.parquet", docs.schema)
    counts = jobs.scratch_run(jobs.stream_label_counts(stream, ["lang"]), "test-counts", complete=True)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, docs.groupBy("lang").count().collect()))


def test_transformer_roundtrip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One two. Two!")], "doc_id long, text string")
    StylometricFeatures().write().overwrite().save(str(tmp_path / "t"))
    row = StylometricFeatures.load(str(tmp_path / "t")).transform(docs).first()
    assert row["word_count"] == 3.0 and set(stylometry.V2_FEATURES) <= set(row.asDict())
