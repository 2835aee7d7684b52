"""Growth of time and disk: patterns run once, terms are counted in their row's task, fits hold compact blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkmark.functions import gram_arrays, ngrams
from inkmark.operators import dedup, lexical


def test_arabic_dedup_runs_each_pattern_once(spark):
    texts = ["إلى  هنا", "الي هنا", "اليَ هنا ", " الي هنا", "َ", "  ", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    clean = dedup.clean_arabic(docs.repartition(3), ["doc_id"])
    assert sorted(map(tuple, clean.collect())) == [(0, "الي هنا"), (7, "x")]
    # stored once; before, the anti-joins and their lists each ran the patterns anew
    assert "regexp_replace" not in clean._jdf.queryExecution().optimizedPlan().toString()


TEXTS = ["the cat sat on the mat", "The  Cat ate", "", None, "a dog  sat on a mat mat", "unknown!", "x", "日本語 日本", "naïve cat\tcat", "ab \x00ab", " "]


def _specs():
    words = [ngrams.TermSpec(min_df=1, stop_words=s, min_n=a, max_n=b) for s, a, b in ((False, 1, 2), (True, 1, 3), (False, 2, 2))]
    return words + [ngrams.TermSpec(analyzer=k, min_df=1, min_n=a, max_n=5) for k in ("char", "char_wb") for a in (3, 4)]


@pytest.mark.parametrize("spec", _specs())
@pytest.mark.parametrize("room", [1 << 62, 40])
def test_packed_terms_are_those_of_the_strings(spark, monkeypatch, spec, room):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    expected = sorted((r.doc_id, t) for r in ngrams.add_terms(docs, "text", spec).collect() for t in r.terms)
    made = docs.select(ngrams.prepared(F.col("text"), spec).alias("made")).toArrow().column(0).combine_chunks()
    packed = gram_arrays._packed
    monkeypatch.setattr(gram_arrays, "_packed", lambda codes, n, size, _: packed(codes, n, size, min(room, _)))
    got = []
    for column in (made.slice(0, 4), made.slice(4)):
        first = 0 if not got and len(column) == 4 else 4
        for terms, place, row, tf in gram_arrays.counted(column, spec):
            got += [(first + int(i), terms[int(p)].as_py()) for p, i, n in zip(place, row, tf) for _ in range(n)]
    assert sorted(got) == expected


def test_characters_beyond_16_bits_are_one_symbol(spark):
    docs = spark.createDataFrame([(1, "a😀bc"), (2, "a😀bc")], "doc_id bigint, text string")
    terms = {r.term for r in lexical.fit_vocabulary(docs, [ngrams.CHAR]).collect()}
    assert terms == {"a😀b", "😀bc", "a😀bc"}


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(1, "cat dog"), (1, "cat"), (2, "cat dog"), (3, "bird"), (None, "cat"), (None, "cat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spec = ngrams.TermSpec(min_df=1, max_n=1, sublinear=False)
    vocabulary = lexical.fit_vocabulary(docs, [spec])
    assert {(r.term, r.df, r.cf) for r in vocabulary.collect()} == {("cat", 3, 5), ("dog", 2, 2), ("bird", 1, 1)}
    assert {(r.doc_id, r.term, r.tf) for r in lexical.weigh(docs, vocabulary, [spec]).collect()} == {
        (1, "cat", 2), (1, "dog", 1), (2, "cat", 1), (2, "dog", 1), (3, "bird", 1), (None, "cat", 2)
    }


def test_terms_are_not_exploded(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    weights = lexical.weigh(docs, lexical.fit_vocabulary(docs, [ngrams.CHAR]), [ngrams.CHAR])
    assert "Generate" not in weights._jdf.queryExecution().executedPlan().toString()


def test_blocks_hold_a_cell_in_eight_bytes(spark):
    from inkmark.models.margins import Blocks, Margin

    cells = [[(j * 97 % 70000, 0.5 + j) for j in range(i)] for i in (0, 300, 2000)]
    rows = spark.createDataFrame(
        [(i, i % 2, 1.0, i % 3, sorted(c)) for i, c in enumerate(cells)], "doc_id bigint, label int, class_weight double, _fold int, _cells array<struct<i:int,v:double>>"
    ).coalesce(1)
    blocks = Blocks(rows, 70_000)
    assert blocks.sizes == [1, 1, 1] and sum(map(len, blocks.held.collect())) < 8 * 2300 + 1500
    weights = np.arange(70_000) / 7.0
    got = {r["_fold"]: r.margins[0] for r in blocks.margins([Margin(weights, 2.0)]).collect()}
    assert got == pytest.approx({i: 2.0 + sum(weights[k] * v for k, v in c) for i, c in enumerate(cells)})


def test_freed_memory_goes_back_after_each_batch(monkeypatch, spark):
    import inspect

    from inkmark.llm import arrow

    run = {}
    frame = spark.range(1)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, function, schema: run.update(f=function))
    arrow.map_batches(frame, lambda batch: {"id": batch.column(0)}, "id bigint")
    calls = []
    monkeypatch.setattr(arrow, "give_back", lambda: calls.append(1))
    assert inspect.isgeneratorfunction(run["f"])
    assert sum(b.num_rows for b in run["f"](pa.RecordBatch.from_arrays([pa.array([i])], names=["id"]) for i in range(3))) == 3
    assert len(calls) == 3
