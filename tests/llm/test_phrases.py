import re
from collections import Counter, defaultdict

from inkmark.llm import phrases
from inkmark.llm.phrases import collocations
from tests.llm.cases import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=10, top=2000, percent=50):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and p in (q[:2], q[1:]) for q, b in found.items() if set(p) <= set(q)):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_sample(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(phrases, "HEAVY_PARTS", 20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    df = docs.union(docs.selectExpr("upper(text)", "CAST(NULL AS STRING)")).repartition(5)
    assert result(collocations(df, top=150)) == brute([tuple(r) for r in df.collect()], top=150)


def test_long_counts_and_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 40)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 1 << 6)
    rows = [("new york city. New  York\tcity, new york new york; a b a b a b\nc", "en")] * 7 + [("x y z x y z. é à é à", None)] * 11 + [("new york", "en")] * 9
    df = spark.createDataFrame([(t, x, "k") for t, x in rows], "text string, lang string, phrase string").repartition(4)
    assert result(collocations(df)) == brute(rows)
    assert result(collocations(df, support=3, top=2)) == brute(rows, support=3, top=2)


def test_odd_rows(spark):
    rows = odd_rows(spark).selectExpr("*", "CASE WHEN doc_id = 6 THEN NULL ELSE 'en' END AS lang")
    assert result(collocations(rows)) == brute([tuple(r) for r in rows.select("text", "lang").collect()])
    assert collocations(rows.limit(0)).collect() == []


def test_an_exact_score_beyond_64_bits(spark):
    a, left, right = 9_000_000_001, 9_000_000_007, 9_000_000_011
    row = spark.sql(f"SELECT CAST(CAST(1000000 AS DECIMAL(7,0)) * (CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) div "
                    f"(CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0))) AS BIGINT)").first()
    assert row[0] == 1000000 * a * a // (left * right)
