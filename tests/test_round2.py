"""NULL groups, odd paths, rejected feeds, prefix sums on two levels, epochs and restarts of streams."""

import pytest
from pyspark.sql import functions as F

from inkmark.models import training
from inkmark.operators import columns, dedup, metrics, splits
from inkmark.operators.joins import join_null_safe
from inkmark.session import broadcast_checked, scratch_path
from inkmark.sources import sinks, tables
from inkmark.sources.bindings import turn_id
from inkmark.streaming import jobs


def test_null_keys_join(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, y int")
    assert sorted(join_null_safe(left, right, ["k"]).collect(), key=str) == sorted([(1, "a", 10), (None, "b", 20)], key=str)
    assert join_null_safe(left, right.filter("k = 1"), ["k"], "left_anti").collect() == [(None, "b")]


def test_quota_keeps_rows_without_generator(spark):
    rows = [(i, i % 2, None if i % 3 else "d", None if i % 2 else "human") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, domain string, model string")
    assert splits.sample_nested_quota(df, 100, 100, 100, 100).count() == 25
    assert splits.sample_nested_quota(df, 5, 100, 100, 100).filter("label = 1").count() == 5


def test_domain_holdout_counts_rows_without_domain(spark):
    rows = [(i, i // 3 % 2, [None, "a", "b"][i % 3]) for i in range(90)]
    out = splits.split_domain_holdout(spark.createDataFrame(rows, "doc_id bigint, label int, domain string"), 10)
    sizes = {r["holdout"]: r["n"] for r in out.groupBy("holdout").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"unknown": 90, "a": 90, "b": 90}


def test_auc_of_a_null_group_and_on_two_levels(spark, monkeypatch):
    rows = [(None if i % 2 else "g", i % 5 % 2, float((i * 37) % 101)) for i in range(400)]
    scored = spark.createDataFrame(rows, "g string, label int, score double").withColumn("prediction", F.lit(1))
    once = {r["g"]: r["roc_auc"] for r in metrics.evaluate(scored, ["g"]).collect()}
    assert set(once) == {None, "g"} and None not in once.values()
    monkeypatch.setattr(metrics, "LARGE", 10)
    assert {r["g"]: r["roc_auc"] for r in metrics.roc_auc(scored, ["g"], buckets=4).collect()} == once


@pytest.mark.parametrize("name", ["plain", "with space", "a+b", "ü%20x"])
def test_source_file_of_odd_folders(spark, name):
    root = f"{scratch_path(spark, 'odd')}/{name}"
    rows = spark.createDataFrame([("x", 1), ("y", 0)], "text string, label int")
    sinks.write_table(rows, f"{root}/in side/a+1.parquet", "parquet")
    sinks.write_table(rows, f"{root}/b.jsonl", "jsonl")
    read = tables.read_tables(spark, tables.discover_tables(spark, root), root, "text string, label int")
    assert {r["source_file"] for r in read.select("source_file").distinct().collect()} == {"in side/a+1.parquet", "b.jsonl"}


def test_a_feed_without_known_labels_is_an_error(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "source_file string, label int")
    with pytest.raises(ValueError, match="every source"):
        columns.quarantine_sources(df)
    kept, rejected = columns.quarantine_sources(df.unionByName(spark.createDataFrame([("c", 1)], df.schema)))
    assert [r["source_file"] for r in kept.collect()] == ["c"] and rejected.count() == 2


def test_turn_ids_do_not_clash(spark):
    df = spark.createDataFrame([(1, 5), (0, 999_999), (2, 0)], "conv_id bigint, turn bigint")
    assert [r[0] for r in df.select(turn_id()).collect()] == [1_000_005, 999_999, 2_000_000]
    with pytest.raises(Exception, match="six digits"):
        spark.createDataFrame([(1, 1_000_000)], "conv_id bigint, turn bigint").select(turn_id()).collect()


def test_defaults_fill_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id bigint, domain string")
    got = columns.with_defaults(df, {"domain": "unknown", "attack": "none"}).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "unknown", "none"), (2, "x", "none")]


def test_dedup_plans_shuffle_no_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "doc_id bigint, text string")
    out = dedup.dedup_text(df, ["doc_id"])
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan


def test_broadcast_is_checked_by_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_checked(wide)) and not hinted(broadcast_checked(wide, max_bytes=5000))
    assert not hinted(broadcast_checked(wide, max_rows=5))


def test_folds_hold_every_class(spark):
    rows = [(i, 1 if i < 3 else 0) for i in range(40)]
    folded = training._stratified_folds(spark.createDataFrame(rows, "doc_id bigint, label int"), "doc_id").collect()
    assert all({r["label"] for r in folded if r["_fold"] == f} == {0, 1} for f in range(training.FOLDS))


def test_epochs_lower_the_loss_and_the_best_is_found(spark):
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} word{i % 7} common", i % 2, "val" if i % 5 == 0 else "train") for i in range(80)]
    history = training.train_epochs(spark.createDataFrame(rows, "doc_id bigint, text string, label int, split string"), epochs=5)
    losses = [r["train_loss"] for r in history.orderBy("epoch").collect()]
    assert len(losses) == 5 and losses == sorted(losses, reverse=True)
    assert training.best_epoch(history).collect()[0]["val_f1"] == 1.0


def test_a_stream_continues_after_a_restart(spark):
    folder, path = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "a"), (2, "a")], schema).coalesce(1).write.parquet(folder)
    run = lambda: jobs.run_to_table(jobs.stream_dedup(jobs.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)), path)
    assert run().count() == 1
    spark.createDataFrame([(3, "a"), (4, "b")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert sorted(r["text"] for r in run().collect()) == ["a", "b"]
