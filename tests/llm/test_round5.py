import numpy as np
import pytest
from tokenizers import Tokenizer

from inkmark.llm import quality_rules as qr
from inkmark.llm.arrow import Block
from inkmark.llm.pii import fit_pii, training_counts, training_rows
from inkmark.llm.token_counts import VOCABULARY
from inkmark.llm.tokens import Encoder, public_path

PATH = public_path(VOCABULARY)


def test_a_word_is_encoded_once_whatever_its_case_and_signs():
    model = Encoder(PATH)
    model.counts(Block(["Étrange, étrange. ÉTRANGE! (étrange) étrange###".encode()], 0))
    assert sum("étrange".encode() in w for w in model.known) == 1


@pytest.mark.parametrize(
    "text",
    [
        "x<|endoftext|>y, <|endoftext|>. <|EndOfText|> <|startoftext|>",
        "o'reilly's I'LL don't. ''s",
        "H̱ ẖ, Å. Å, A,̊ ≠ ≮ K İ ΣΑΣ, ẞ ß",
        "×a÷ b×, µ² ÿ. Ÿ À-Þ",
        "a1b2, 3.14 % 漢字, \x85a\xa0b. \x00c,",
        ",a.b;c",
    ],
)
def test_cuts_between_letters_and_signs_keep_the_ids(text):
    model, library = Encoder(PATH), Tokenizer.from_file(PATH)
    ids, sizes = model.ids(Block([text.encode(), b"", text.encode()], 0))
    wanted = library.encode(text, add_special_tokens=False).ids
    assert sizes.tolist() == [len(wanted), 0, len(wanted)]
    assert np.array_equal(ids, wanted * 2)


def test_pii_learns_from_every_document_and_alike_in_the_driver_and_on_spark(spark):
    plain = [(i, f"call +49 30 1234{i % 97:03d} or write a.b{i % 7}@mail.example.org today, see 10.0.{i % 200}.7") for i in range(6000)]
    strange = [(i, f"order 00{i} 4111 1111 1111 1111 x") for i in range(6000, 6040)]
    docs = spark.createDataFrame(plain + strange, "doc_id long, text string").repartition(4)
    seen = sum(r["n"] for r in training_counts(docs).collect())
    assert seen == sum(len(training_rows(t)) for _, t in plain + strange)
    few, many = fit_pii(docs), fit_pii(docs, driver_rows=0)
    assert few.thresholds == many.thresholds and few.trees.base == many.trees.base
    assert all(np.array_equal(a, b) for one, two in zip(few.trees.trees, many.trees.trees) for a, b in zip(one, two))


def test_quality_rules_learn_from_every_labelled_document(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    docs = docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000000000 AS doc_id", "text"))
    labels = labels.select("doc_id", "quality").unionByName(labels.selectExpr("doc_id + 1000000000 AS doc_id", "quality"))
    known = docs.join(labels, "doc_id").filter("length(text) > 400 AND quality = 1").count()
    rows = qr.labelled_features(docs, labels).filter("good").count()
    assert 0.8 * known < rows and rows > 6000
    forest, threshold = qr.fit_rules(docs, labels)
    again = qr.fit_rules(docs.repartition(5), labels.repartition(3))
    assert again[1] == threshold
    assert all(np.array_equal(a, b) for one, two in zip(forest.trees, again[0].trees) for a, b in zip(one, two))
