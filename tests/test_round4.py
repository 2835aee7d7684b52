"""Tables written as folders, feeds without a clean source."""

import duckdb
import pytest
from pyspark.sql import functions as F

from inkmark.plans.registry import all_oracles, all_queries
from inkmark.session import scratch_path
from inkmark.streaming import jobs
from tests.compare import differences


@pytest.fixture(scope="module")
def folders(spark, sf_dir):
    """(folder, connection): tables written as folders of part files; every source of the documents holds an unknown label."""
    root, con = scratch_path(spark, "folders"), duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            rows = rows.unionByName(rows.withColumn("doc_id", F.col("doc_id") * 97 + 970_005))
        rows.repartition(3).write.parquet(f"{root}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root.removeprefix('file:')}/{name}.parquet/*.parquet')")
    return root, con


@pytest.mark.parametrize("name", ["feed_strict", "filter_file_quarantine", "filter_file_quarantine_rejected"])
def test_a_feed_without_a_clean_source_is_empty(spark, folders, name):
    root, con = folders
    assert differences(all_queries()[name](spark, root), con, all_oracles()[name]) is None


@pytest.mark.parametrize("name", ["stream_score", "stream_dedup", "stream_label_counts"])
def test_streams_read_tables_that_are_folders(spark, folders, name):
    root, con = folders
    assert differences(all_queries()[name](spark, root), con, all_oracles()[name]) is None


def test_a_stream_without_files_counts_nothing(spark, sf_dir):
    stream = jobs.file_stream(spark, sf_dir, "nothing.parquet", spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    assert jobs.scratch_run(jobs.stream_label_counts(stream, ["lang"]), "empty", complete=True).count() == 0


def test_stored_stylometry_equals_stylometry_of_the_text(spark, sf_dir):
    from inkmark.models.vectors import FeaturePlan, assemble, fit_features, with_style
    from inkmark.functions import ngrams

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).cache()
    for plan in (FeaturePlan(style="v1"), FeaturePlan([ngrams.WORD_MAXDF], style="v2")):
        kept = with_style(docs, [plan])
        # a text changed after storing shows that the features are read, not computed again
        changed = kept if plan.specs else kept.withColumn("text", F.lit("other"))
        plain, again = (
            {r.doc_id: r.features.toArray() for r in assemble(rows, fit_features(rows, plan), ["doc_id"]).collect()} for rows in (docs, changed)
        )
        assert plain.keys() == again.keys() and all(abs(plain[k] - again[k]).max() < 1e-9 for k in plain)


def test_term_cells_equal_the_joined_weights(spark):
    from inkmark.functions import ngrams
    from inkmark.models.vectors import FeaturePlan, fit_features, term_cells
    from inkmark.operators.lexical import weigh

    texts = ["the cat sat on the mat", "the cat ate", "", None, "a dog sat on a mat mat", "unknown!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plan = FeaturePlan([ngrams.TermSpec(max_features=8), ngrams.TermSpec(analyzer="char_wb", min_n=3, max_n=4, max_features=20)])
    fitted = fit_features(docs, plan)
    expected = {(r.doc_id, r.term_id): r.w for r in weigh(docs, fitted.vocabulary, plan.specs).collect()}
    rows = term_cells(docs, fitted, ["doc_id"]).collect()
    got = {(r.doc_id, c.i): c.v for r in rows for c in r["_cells"]}
    assert len(rows) == 6 and got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert all([c.i for c in r["_cells"]] == sorted(c.i for c in r["_cells"]) for r in rows)


def test_stylometry_makes_no_string_per_character(spark):
    from inkmark.functions import stylometry

    docs = spark.createDataFrame([(1, "A word, a word. 12 words!")], "doc_id bigint, text string")
    for add, tokenisations in ((stylometry.add_v1_features, 3), (stylometry.add_v2_features, 2)):
        plan = add(docs, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= tokenisations


def test_near_duplicates_with_joined_frequencies(spark, sf_dir, monkeypatch):
    from inkmark.operators import near_duplicates as nd

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).cache()
    looked_up, joined = (
        {r.doc_id: (r.terms, r.levels, r.last, [round(w, 12) for w in r.weights]) for r in nd.packed(docs, lookup=n).collect()} for n in (10**6, 0)
    )
    assert looked_up == joined and len(joined) > 70
