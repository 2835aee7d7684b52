import re

import corpus_pipeline
from inkmark.llm.arrow import stored
from inkmark.llm.packing import CAPACITIES
from inkmark.llm.tokens import public_path
from tests.llm.cases import odd_rows
from tests.llm.test_near_duplicates import brute as components
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_text_models import rule_counts

SF_DIR = "/root/testdata/sf0.01"


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF_DIR), name.replace(" ", "-")))
    assert all(s.columns == docs.columns for s in steps[:-1])
    before, ruled, single, clean, redacted = map(texts_of, steps[:-1])

    allowed = {d for d, t in before.items() if (c := rule_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert set(ruled) <= allowed and len(ruled) > 0.9 * len(allowed)
    assert set(single) == {d for d, _, _, kept in components(list(ruled.items())) if kept}
    plain = lambda text: " ".join(re.findall(r"\w+", text.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, t in single.items() if not any(i in plain(t) for i in items)}
    assert set(redacted) == set(clean)
    assert all(redacted[d] == t for d, t in clean.items() if not base_spans(t))
    assert not any(base_spans(t) for t in redacted.values())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    lengths = [(d, len(library.encode(t, add_special_tokens=False).ids) + 1) for d, t in redacted.items()]
    got, want = check(steps[-1].collect(), lengths, CAPACITIES)
    assert got == want


def test_odd_rows_pass_every_stage(spark):
    rows = odd_rows(spark).selectExpr("*", "CAST(NULL AS string) AS lang", "'s' AS source", "1L AS n_chars")
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() <= docs.count()
        # long documents are cut, but every document has one first piece
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).filter("piece = 0").count() == docs.count()


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_text(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(30)) for w in ("red", "blue", "green", "grey"))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [(None, one), (None, two), (None, two), (None, f"Hear this: {item}"), (1, three), (2, three), (2, four), (2, f"{four} more"), (None, three.upper()), (3, one)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "CAST(NULL AS string) AS lang", "'s' AS source", "1L AS n_chars")
    single = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    got = [(r.doc_id, r.text) for r in single.collect()]
    # the last text and the one it extends are one component of one id: one of them stays, the same on every run
    assert sum(t.startswith(four) for _, t in got) == 1
    assert sorted((t, d) for d, t in got if not t.startswith(four)) == sorted([(one, 3), (two, None), (f"Hear this: {item}", None), (three, 1)])
    clean = corpus_pipeline.decontamination(spark, single, SF_DIR)
    assert {r.text for r in clean.collect()} == {t for _, t in got} - {f"Hear this: {item}"}
