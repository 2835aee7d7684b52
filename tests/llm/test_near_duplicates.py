import random
import re
from collections import Counter, defaultdict

import pytest

from inkmark.llm import sketch_dedup
from inkmark.llm.components import connected
from inkmark.llm.sketch_dedup import near_duplicates, op6_near_duplicates
from tests.llm.cases import odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for s in own:
            holders[s].append(i)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = min(ids[find(i)], default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def families(seed, sizes, groups, copies, most):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(40)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        if g % 3 == 0:
            base[3:3] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(most)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009 * 1000 + len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,sizes,most", [(1, (4, 9, 30), 3), (2, (60, 150, 230), 6), (3, (240, 262, 280, 300), 9), (4, (600, 1500), 20)])
def test_random_families(spark, seed, sizes, most):
    rows = families(seed, sizes, 6, 12, most)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_one_large_family(spark, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "GROWTH", 3)
    rows = families(5, (150,), 1, 250, 7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    assert result(near_duplicates(rows)) == brute([tuple(r) for r in rows.select("doc_id", "text").collect()])
    assert near_duplicates(rows.limit(0)).collect() == []


def test_ids_with_several_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (3, None), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    roots = {r.node: r.root for r in connected(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_op6_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op6_near_duplicates(spark, sf_dir)) == brute(docs)
