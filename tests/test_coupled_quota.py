import hashlib
import random
from collections import Counter

import pytest

from inkmark.operators.quota import SEED
from inkmark.operators.splits import sample_coupled_quota


def scan(rows, per_model, per_domain, human, ai):
    """The rule row by row, in hash order."""
    full, taken = Counter(), set()
    for doc, label, domain, model in sorted(rows, key=lambda r: hashlib.md5(f"{SEED}|{r[0]}".encode()).hexdigest()):
        own = [(("d", label, domain or "unknown"), per_domain), (("l", label), ai if label == 1 else human)]
        own += [(("m", model or ""), per_model)] if label == 1 else []
        if all(full[name] < cap for name, cap in own):
            taken.add(doc)
            full.update(name for name, _ in own)
    return taken


@pytest.mark.parametrize("seed,caps", [(1, (9, 14, 40, 60)), (2, (3, 50, 10, 20)), (3, (30, 7, 25, 25)), (4, (0, 5, 5, 5)), (5, (500, 500, 500, 500))])
def test_coupled_counters_equal_the_scan(spark, seed, caps):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        label = int(rng.random() < 0.6)
        model = rng.choice(["g1", "g1", "g1", "g2", "g3", "g4", None]) if label else "human"
        rows.append((i, label, rng.choice(["a", "a", "b", "c", "d", None]), model))
    df = spark.createDataFrame(rows, "doc_id bigint, label int, domain string, model string").repartition(4)
    assert {r.doc_id for r in sample_coupled_quota(df, *caps).collect()} == scan(rows, *caps)
