import re

from inkmark.llm import decontamination as dc
from inkmark.llm.decontamination import contaminated, op10_decontamination
from tests.llm.cases import odd_rows

ITEM = "A train leaves Boston at 60 km per hour and reaches Denver after 12 hours of travel while Anna waits"


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, text string").selectExpr("*", "1 AS window", "2 AS position", "3 AS slots", "4 AS doc", "5 AS item")


def found(df):
    return {(r.doc_id, r.item_id): r.kind for r in df.collect()}


def test_slots_must_be_filled_consistently(spark):
    items = frame(spark, [(1, ITEM), (2, "If Tom has 5 apples and Tom eats 5 apples then how many apples does Tom keep"), (3, None), (4, ""), (5, "too short"), (6, "only five words are here")], "item_id")
    docs = frame(spark, [
        (10, ITEM), (11, f"Intro words here. {ITEM.upper()}!! More words follow."),
        (12, "so, a train leaves Paris at 75 miles per hour and reaches Rome after 9 days of travel while Bob waits."),
        (13, "A ship leaves port at 60 km per hour"), (14, "say: If Ann has 7 apples and Ann eats 7 apples, then how many apples does Ann keep?"),
        (15, "say: If Ann has 7 apples and Bob eats 9 apples, then how many apples does Eve keep?"),
        (16, None), (17, ""), (None, ITEM), (18, "Look: ONLY five, words are (here)"), (19, "say too short"),
    ], "doc_id")
    got = found(contaminated(docs, items))
    # in capitals there are no names to see, so only the windows without a name are found
    assert got.pop((11, 1), None) in (None, "exact", "reparameterised")
    assert got == {(10, 1): "exact", (12, 1): "reparameterised", (14, 2): "reparameterised", (None, 1): "exact", (18, 6): "exact"}
    assert contaminated(docs.limit(0), items).collect() == []
    assert contaminated(docs, items.limit(0)).collect() == []


def test_without_sent_windows(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = found(contaminated(docs, items))
    monkeypatch.setattr(dc, "SENT_WINDOWS", 10)
    assert found(contaminated(docs, items)) == want


def test_odd_rows(spark):
    rows = odd_rows(spark)
    items = spark.createDataFrame([(1, "The cat sat on the mat."), (1, "The cat sat on the mat."), (2, "a b c d e f g")], "item_id bigint, text string")
    assert set(found(contaminated(rows, items))) == {(1, 1), (None, 2)}


def test_op10_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    plain = lambda text: " ".join(re.findall(r"\w+", (text or "").lower()))
    docs, items = ([(r[0], plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    want = {(d, i) for d, text in docs for i, item in items if item in text}
    got = {(r.doc_id, r.item_id) for r in op10_decontamination(spark, sf_dir).collect()}
    assert want and got == want


def test_literal_copies_of_items_full_of_slots(spark):
    texts = ["Compute 12 34 56 78 90 11 22 33 44 now", "Every Word Of This Item Stands In Title Case So All Are Names"]
    items = frame(spark, list(enumerate(texts)), "item_id")
    docs = frame(spark, [(i, f"Some words before. {t}. Some words after.") for i, t in enumerate(texts)] + [(9, "Compute 1 2 3 4 5 6 7 8 9 now")], "doc_id")
    assert found(contaminated(docs, items)) == {(0, 0): "exact", (1, 1): "exact"}


def test_copies_without_case_or_punctuation(spark):
    text = "Maria buys six green apples in Boston. Later her friend Tom sells two of them. Nobody knows why. Still Anna keeps 3 kg at home. Who has most?"
    items = frame(spark, [(1, text)], "item_id")
    copies = [text.lower(), text.upper(), text.title(), re.sub(r"[^\w\s]", "", text), re.sub(r"[^\w\s]", "", text).title()]
    docs = frame(spark, [(i, f"Words before this. {c} Words after it.") for i, c in enumerate(copies)], "doc_id")
    got = contaminated(docs, items).collect()
    assert {(r.doc_id, r.kind, r.n_hit, r.n_windows) for r in got} == {(i, "exact", 21, 21) for i in range(len(copies))}


def test_copies_of_the_benchmark_without_case_or_punctuation(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    forms = (str.lower, str.upper, str.title, lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", t))
    rows = [(i * 10 + k, f"Words before this. {form(t)}") for i, t in items for k, form in enumerate(forms)]
    got = found(contaminated(frame(spark, rows, "doc_id"), frame(spark, items, "item_id")))
    assert {(i * 10 + k, i) for i, _ in items for k in range(len(forms))} <= set(got)
