import random
from collections import defaultdict

import pytest

from inkmark.llm.packing import CAPACITIES, _best_fit, cost, fitted, op5_packing, outcomes, pack, pack_group
from inkmark.llm.token_counts import op4_token_counts


def check(rows, lengths, capacities):
    """Every token has one place, bins are filled without gaps and as small as permitted."""
    bins, copies = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_tokens, r.bin_capacity))
        copies[r.doc_id, r.copy].append((r.start, r.n_tokens))
    for parts in bins.values():
        end = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == end
            end += n
        assert {(t, c) for _, _, t, c in parts} == {(end, fitted(end, capacities))}
    found = []
    for (doc, _), parts in copies.items():
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        found.append((doc, end))
    return sorted(found, key=str), sorted(((d, n) for d, n in lengths if n), key=str)


@pytest.mark.parametrize("groups", [(1 << 22, 100_000), (3000, 7)])
def test_every_token_has_one_place(spark, groups):
    lengths = [(i, (i * i * 37) % 1900) for i in range(300)] + [(7, 55)] * 5 + [(None, 12), (None, 12), (1, None), (2, 0), (3, 20_001)]
    df = spark.createDataFrame(lengths, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 AS copy", "2 AS piece", "3 AS `group`")
    # a null and a 5 of one id are different rows: equal (id, copy) pairs may stem from different lengths, so ids are made unique here
    unique = df.selectExpr("coalesce(doc_id, -1) * 100000 + coalesce(n_tokens, 0) AS doc_id", "n_tokens")
    rows = pack(unique, (256, 1024, 2048), *groups).collect()
    want = [(r.doc_id, r.n_tokens) for r in unique.collect()]
    got, expected = check(rows, want, (256, 1024, 2048))
    assert got == expected


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5), (None, 3)], "doc_id bigint, n_tokens bigint").selectExpr("*", "1 AS copy", "2 AS piece", "3 AS `group`", "4 AS length")
    rows = pack(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.bin_tokens) for r in rows) == [(0, 3, 8), (1, 5, 8)]
    assert pack(df.limit(0)).collect() == []


def price(bins, capacities=CAPACITIES):
    return sum(cost(fitted(b, capacities)) for b in bins)


def plain_best_fit(lengths, capacities, least):
    """The same rule by looking at every open bin, and at every piece to come where the outlook chooses."""
    bins, placed, chosen = [], [], {}
    for k, n in enumerate(lengths):
        open_bins = [(c - t, i) for i, (c, t) in enumerate(bins) if c - t >= n]
        if open_bins:
            i = min(open_bins)[1]
        else:
            if least is None and n not in chosen:
                offers = []
                for c in (c for c in capacities if c >= n):
                    total = n
                    for m in lengths[k + 1 :]:
                        total += m if total + m <= c else 0
                    offers.append((cost(fitted(total, capacities)) / total, c))
                chosen[n] = min(offers)[1]
            bins.append([chosen[n] if least is None else min(c for c in capacities if c >= max(n, least)), 0])
            i = len(bins) - 1
        bins[i][1] += n
        placed.append(i)
    return placed, [t for _, t in bins]


def test_best_fit_equals_the_plain_rule():
    lengths = sorted(((i * 7919) % 900 + 1 for i in range(400)), reverse=True)
    for least in (None, 256, 512, 1024):
        assert _best_fit(lengths, (256, 512, 1024), least) == plain_best_fit(lengths, (256, 512, 1024), least)


def cheapest(lengths, capacities):
    """The least cost of all ways to put a few pieces into bins."""
    best = float("inf")

    def place(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, price(bins, capacities))
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacities[-1]:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_small_groups_cost_little_more_than_the_best_packing():
    rng = random.Random(3)
    ratios = []
    for _ in range(60):
        lengths = sorted((rng.randrange(20, rng.choice((400, 1100, 2000))) for _ in range(7)), reverse=True)
        ratios.append(price(pack_group(lengths, (512, 1024, 2048))[1], (512, 1024, 2048)) / cheapest(lengths, (512, 1024, 2048)))
    assert max(ratios) < 1.3 and sum(ratios) / len(ratios) < 1.05


def test_sizes_are_chosen_jointly():
    # one piece per bin of 512 would leave two fifths of it empty
    assert price(pack_group([300] * 1000, CAPACITIES)[1]) / 300_000 < 1.25
    # no fixed least size is the best for every mix, and the outcomes differ
    for lengths in ([300] * 1000, [700] * 300, sorted(((i * 104729) % 3000 + 1 for i in range(500)), reverse=True)):
        prices = [price(bins) for _, bins in outcomes(lengths, CAPACITIES)]
        assert len(set(prices)) > 2 and price(pack_group(lengths, CAPACITIES)[1]) == min(prices)


def test_op5_places_all_documents(spark, sf_dir):
    lengths = [(r.doc_id, r.n_tokens + 1) for r in op4_token_counts(spark, sf_dir).collect()]
    got, expected = check(op5_packing(spark, sf_dir).collect(), lengths, CAPACITIES)
    assert got == expected
