import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkmark.llm import perfect_hash
from inkmark.llm.arrow import Block
from inkmark.llm.hashing import U, mix, span_hashes, word_hashes, words_of
from inkmark.llm.token_counts import VOCABULARY, count_tokens, op4_token_counts
from inkmark.llm.token_store import lookup, op1_token_ids, read_rows, write_store
from inkmark.llm.tokens import Encoder, public_path
from inkmark.session import scratch_path
from tests.llm.cases import odd_rows

PATH = public_path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4), st.sampled_from(["", "<|endoftext|>", "don't ", "é ́", " ", "123 4 "]))
def test_word_wise_ids_equal_the_library(texts, more):
    library = Tokenizer.from_file(PATH)
    texts = [(t + more + t).encode("utf-8", "ignore").decode() for t in texts] or [more]
    model = Encoder(PATH)
    block = Block([t.encode() for t in texts], 0)
    ids, sizes = model.ids(block)
    assert model.by_word
    assert [ids[e - s : e].tolist() for s, e in zip(sizes, np.cumsum(sizes))] == [ids_of(library, t) for t in texts]
    assert model.counts(block).tolist() == sizes.tolist()


def test_whole_text_tokenizers():
    texts = ["Hello  world", "", "a b\nc"]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        model = Encoder(public_path(name))
        assert not model.by_word
        counts = model.counts(Block([t.encode() for t in texts], 0))
        assert counts[1] == 0 and counts[0] > 1 and counts[2] > 2


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr("inkmark.llm.tokens.KNOWN_WORDS", 10)
    model = Encoder(PATH)
    for i in range(5):
        text = " ".join(f"w{j}" for j in range(i * 7, i * 7 + 9))
        assert model.counts(Block([text.encode()], 0)).tolist() == [len(ids_of(library, text))]
        assert len(model.known) <= 10


def test_word_hashes():
    data = b"one two  one\tTWO\n"
    h = word_hashes(data)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    long = b"ab cd " * 2_000_000
    array = np.frombuffer(long, dtype=np.uint8)
    assert len(np.unique(span_hashes(array, *words_of(array)))) == 2
    assert len(np.unique(mix(np.arange(1000, dtype=U)))) == 1000


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.random.default_rng(n).choice(1 << 60, n, replace=False).astype(U)
        function = perfect_hash.build(keys)
        assert sorted(perfect_hash.slots(function, keys).tolist()) == list(range(n))


def test_counts_of_odd_rows(spark, library):
    rows = odd_rows(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(rows, PATH).collect())
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(i := ids_of(library, r.text)), len(i) > 2048)
        for r in rows.select("doc_id", "text").collect()
    )
    assert got == want
    assert count_tokens(rows.limit(0), PATH).collect() == []


def test_op4_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == len(ids_of(library, texts[r.doc_id]))


def test_op1_round_trip(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op1_token_ids(spark, sf_dir).collect()}
    start = 0
    for d in docs:
        ids = [*ids_of(library, d.text), 1]
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert not got


def test_store_of_odd_rows(spark, library):
    rows, path = odd_rows(spark), scratch_path(spark, "store")
    write_store(rows, path, PATH, shard_bytes=1000, part_keys=2)
    keys = rows.select("doc_id").distinct().unionByName(spark.createDataFrame([(99,), (-1,)], "doc_id bigint"))
    got = sorted((r.key is None, r.key or 0, np.frombuffer(r.ids, dtype="<u2").tolist()) for r in read_rows(spark, path, lookup(spark, path, keys)).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, [*ids_of(library, r.text), 1]) for r in rows.select("doc_id", "text").collect())
    assert got == want  # absent keys are not found, repeated and null keys give all their rows
    empty = scratch_path(spark, "store")
    write_store(rows.limit(0), empty, PATH)
    assert read_rows(spark, empty, lookup(spark, empty, keys)).collect() == []


def thue_morse(size):
    """Two words that polynomial hashes modulo a power of two cannot tell apart."""
    text, other = "a", str.maketrans("ab", "ba")
    while len(text) < size:
        text += text.translate(other)
    return text, text.translate(other)


def test_structured_words_keep_their_ids():
    from tokenizers import Tokenizer

    from inkmark.llm.arrow import Block
    from inkmark.llm.tokens import Encoder, public_path

    path = public_path("word_bpe_49k.json")
    texts = [*thue_morse(1024), *thue_morse(4096)]
    library = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    ids, sizes = Encoder(path).ids(Block([t.encode() for t in texts], 0))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library
    array = np.frombuffer(" ".join(texts).encode(), dtype=np.uint8)
    assert len(set(span_hashes(array, *words_of(array)).tolist())) == 4


def test_patterns_that_keep_white_space_are_not_taken_word_by_word():
    from inkmark.llm.tokens import _matches_space

    assert _matches_space(r" ?[^\s\p{L}\p{N}]+| ?\p{L}+")
    assert not _matches_space(r"'s|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
