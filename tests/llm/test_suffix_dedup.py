import hashlib
import random
from collections import Counter

import pytest

from inkmark.llm import suffix_dedup
from inkmark.llm.suffix_dedup import multikey_sort, op11_repeats, remove_repeats
from tests.llm.cases import odd_rows


def brute(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        kept, removed, spans, end = [], 0, 0, -1
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                if i > end:
                    spans += 1
                    kept.append(t[max(end, 0) : i])
                end = i + length
        kept.append(t[max(end, 0) :])
        rest = b"".join(kept)
        out.append((doc, len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def family(seed, letters="abcdé "):
    """Texts that share passages of all lengths around the limit, in different surroundings."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [some(n) for n in (18, 19, 20, 21, 25, 30, 39, 40, 41, 60, 200)]
    rows = []
    for i in range(60):
        text = "".join(some(rng.randrange(0, 25)) + rng.choice(passages)[rng.randrange(0, 4) :] for _ in range(rng.randrange(1, 6)))
        rows.append((i, text))
    return rows + [(100, rows[3][1]), (101, "z" * 90), (102, "z" * 45), (103, "xy" * 50), (104, ""), (None, None), (3, rows[5][1])]


@pytest.mark.parametrize("seed,length,bucket", [(1, 20, 1 << 20), (2, 20, 300), (3, 8, 200), (4, 33, 2000)])
def test_families(spark, monkeypatch, seed, length, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 90 if seed % 2 else 1 << 20)
    rows = family(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(remove_repeats(df, length=length)) == brute(rows, length)


def test_one_passage_in_many_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = some(70)
    rows = [(i, some(30) + passage[: 70 - i % 3] + some(30)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(remove_repeats(df, length=40)) == brute(rows, 40)


@pytest.mark.parametrize("made", [40])
def test_more_buckets_than_asked_for(spark, monkeypatch, made):
    rows = family(7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    plain = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *columns: plain(self, made, *columns))
    assert result(remove_repeats(df, length=20)) == brute(rows, 20)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    plain = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    got = remove_repeats(rows, with_text=True)
    assert result(got) == brute(plain)
    for r in got.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert remove_repeats(rows.limit(0)).collect() == []


def test_multikey_sort():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    order, shared = multikey_sort(strings, 30)
    got = [strings[i].ljust(32, b"\0") for i in order]
    assert got == sorted(got)
    for a, b, n in zip(order, order[1:], shared[1:]):
        x, y = strings[a], strings[b]
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_op11_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op11_repeats(spark, sf_dir)) == brute(docs)
