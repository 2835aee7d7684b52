"""Near-duplicates by bottom-k sketches of word shingles, with exact verification.

1. Every text becomes its set of 5-word shingle hashes. Equal sets are one class; only classes go on.
2. One hash function orders the shingles; a class keeps its whole set up to ``WHOLE`` shingles and the ``K`` smallest
   beyond (the bottom-k sketch). Inverted lists of the retained values generate overlaps. Two classes that reach the
   similarity share so many retained values that their rarest ones must meet (prefix filter over the retained values,
   ordered by frequency): only those are listed, and values held by one class never.
3. A list is not expanded into pairs. The member that shares most of its values meets the others first, links join
   components, and what is in one component is not compared again; then the next members, more at a time, until every
   list is done. Each pair in different components that could reach the similarity is thus examined, in the list of
   the first value that both have, and where that value stands in both bounds what they can share.
4. The union sketch of a pair estimates the similarity; pairs that are clearly below are left out, all others are
   verified on their full sets.

The sketch bounds leave out a pair of long texts at the threshold with a chance of about 3e-7 (``SIGMAS``); for texts
of up to ``WHOLE`` shingles they are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.llm.arrow import Block, blocks, map_batches, stored, table
from inkmark.llm.components import connected
from inkmark.llm.hashing import U, combine, lowered, shingle_set, span_hashes, words_of

WORDS = 5
PERCENT = 85
K = 128
WHOLE = 256
SIGMAS = 5.0
# Members of a list that have met the others after a round: this many times more in each round.
GROWTH = 32
# Bound of the table of id residues that keeps texts without candidates out of the shuffle.
RESIDUES = 1 << 20


def _sets(block: Block) -> list[np.ndarray]:
    """The shingle set of each text."""
    data = lowered(block.data)
    starts, ends = words_of(data)
    bounds = block.counts(starts).tolist()
    words = span_hashes(data, starts, ends)
    windows = combine(words, WORDS)
    return [
        np.unique(windows[a : b - WORDS + 1]) if b - a >= WORDS else shingle_set(words[a:b], WORDS)
        for a, b in zip(bounds, bounds[1:])
    ]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    # with the highest bit flipped, signed order is the order of the hashes
    values = (np.concatenate([np.zeros(0, dtype=U), *arrays]) ^ U(1 << 63)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def set_key(values: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def shingle_prints(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """doc_id, key (128 bits of the whole set), n_shingles and the retained values of every text, and the row's own key."""

    def measure(batch):
        sets = [s for b in blocks(batch.column(1)) for s in _sets(b)]
        return {
            "doc_id": batch.column(0),
            "key": [set_key(s) for s in sets],
            "n_shingles": [len(s) for s in sets],
            "sketch": _lists([s if len(s) <= WHOLE else s[:K] for s in sets]),
            "row_key": batch.column(2),
        }

    row = F.col(row_col) if row_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.cast("binary").alias("row_key"))
    return map_batches(rows, measure, "doc_id bigint, key binary, n_shingles bigint, sketch array<bigint>, row_key binary")


def _overlap_needed(n: Column, m: Column) -> Column:
    """Shingles that sets of these sizes share at least if they reach the similarity."""
    return F.ceil(F.lit(PERCENT) * (n + m) / F.lit(100 + PERCENT) - F.lit(1e-9))


def _sketch_overlap_needed(n: Column, m: Column) -> Column:
    """Values that their sketches share at least, but for a chance of SIGMAS standard deviations."""
    share = F.lit(float(PERCENT)) * (n + m) / F.lit(100.0 + PERCENT) / F.greatest(n, m)
    return F.lit(float(K)) * share - F.lit(SIGMAS) * F.sqrt(F.lit(float(K)) * share * F.greatest(F.lit(0.0), 1 - share))


_LEAST_SKETCH = int(np.floor(K * PERCENT / 100 - SIGMAS * np.sqrt(K * PERCENT / 100 * (1 - PERCENT / 100))))


def _postings(classes: DataFrame) -> DataFrame:
    """(value, node, n, sketched, size, place, head, turn): the lists.

    ``place`` is where the value stands among the ``size`` values of the class by rising frequency, ``head`` are the
    class's listed values in that order, ``turn`` is the order in which the members of a list meet the others. Classes of
    up to WHOLE shingles are compared by whole sets; those that may meet a larger one (or are larger) by sketches, under
    other values, so the two kinds never mix.
    """
    n = F.col("n")
    whole = classes.filter(n <= WHOLE).select("node", "n", F.lit(False).alias("sketched"), F.explode("sketch").alias("value"))
    sketched = classes.filter(n > WHOLE * PERCENT // 100).select(
        "node", "n", F.lit(True).alias("sketched"), F.explode(F.slice("sketch", 1, K)).alias("value")
    )
    values = whole.unionByName(sketched.withColumn("value", F.xxhash64("value")))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    size = F.when(F.col("sketched"), F.lit(K)).otherwise(n)
    listed = F.when(F.col("sketched"), F.lit(K - _LEAST_SKETCH + 1)).otherwise(n - F.ceil(n * PERCENT / 100 - 1e-9) + 1)
    # at most WHOLE values per class; values that no one shares come first in its order and are not listed
    own = values.join(shared, "value").groupBy("node", "n", "sketched").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("own"))
    own = own.withColumn("size", size).withColumn("alone", F.col("size") - F.size("own"))
    own = own.withColumn("head", F.slice(F.col("own.value"), F.lit(1), F.greatest(F.lit(0), listed - F.col("alone")).cast("int")))
    rows = own.select("node", "n", "sketched", "size", "alone", "head", F.posexplode("head").alias("at", "value"))
    rows = rows.withColumn("place", F.col("alone") + F.col("at") + 1)
    # the window ranks narrow rows of one list; Spark spills it if need be
    turn = F.row_number().over(Window.partitionBy("value").orderBy("alone", "n", "node"))
    return rows.select("value", "node", "n", "sketched", "size", "place", "head", turn.alias("turn"))


def _could_link() -> Column:
    """Pair condition on the rows a and b of one list, cheap tests first."""
    n, m = F.col("a.n"), F.col("b.n")
    need = F.when(F.col("a.sketched"), _sketch_overlap_needed(n, m)).otherwise(_overlap_needed(n, m))
    left = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) + 1
    return (
        (F.col("a.value") == F.col("b.value"))
        & (F.col("a.component") != F.col("b.component"))
        & (F.col("a.turn") < F.col("b.turn"))
        & (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT)
        & (~F.col("a.sketched") | (F.greatest(n, m) > WHOLE))
        & (left >= need)
        & (F.get(F.array_intersect("a.head", "b.head"), F.lit(0)) == F.col("a.value"))
    )


def _with_values(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, their sizes and values; a class has one row in ``sets``, so a much used one can be split."""
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("values").alias(f"values_{side}"))
        pairs = pairs.join(own, side)
    return pairs


def _similar() -> Column:
    """The values are whole sets, and these reach the similarity."""
    both = F.size(F.array_intersect("values_a", "values_b"))
    return both * 100 >= (F.col("n_a") + F.col("n_b") - both) * PERCENT


def _likely() -> Column:
    """The K smallest values of the union, a random sample of it, do not rule the similarity out."""
    bottom = F.slice(F.array_sort(F.array_union("values_a", "values_b")), 1, K)
    share = F.size(F.array_intersect(F.array_intersect(bottom, F.col("values_a")), F.col("values_b"))) / F.size(bottom)
    slack = SIGMAS * F.sqrt(F.lit(PERCENT / 100 * (1 - PERCENT / 100)) / F.size(bottom))
    return share >= F.lit(PERCENT / 100) - slack


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer than five words is one shingle; one
    without words, or null, has none and is linked with nothing. Rows with equal sets (so also repeated rows) are linked;
    rows that share an id but not the set are linked as far as their sets are. A row without id belongs to the component of
    its set, whose id is the smallest that is not null. Other columns are ignored; an empty table gives an empty result.
    """
    prints, classes = _placed(df, id_col, text_col)
    least = classes.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    ids = classes.join(least, "component").select("key", "component_id")
    rows = prints.select("doc_id", "key", "n_shingles").join(ids, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def kept_rows(df: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key): the rows that stay, named by ``row_col``, a key of the whole row.

    Of each component that is one row of the set whose smallest id is the smallest, with that id; a row without id only where
    all are. Of sets with the same smallest id that with the smallest key stands for the component, of rows with one id and one
    set that with the smallest row key. The empty set is linked with nothing and stays once with every id that has it.
    """
    prints, classes = _placed(df, id_col, text_col, row_col)
    first = F.min(F.struct(F.col("first_doc").isNull().alias("missing"), "first_doc", "key")).alias("first")
    kept = classes.groupBy("component").agg(first).select("first.key", F.col("first.first_doc").alias("doc_id"))
    kept = kept.unionByName(prints.filter("n_shingles = 0").select("key", "doc_id").distinct())
    mark = F.concat("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("mark")
    rows = prints.groupBy(mark).agg(F.min("row_key").alias("row_key"))
    return rows.join(kept.select(mark), "mark", "left_semi").select("row_key")


def _placed(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The prints of the rows, and (key, first_doc, component) of their sets other than the empty one."""
    prints = stored(shingle_prints(df, id_col, text_col, row_col), "prints")
    classes = prints.filter("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lists = stored(_postings(classes), "lists")
    nodes = stored(lists.select("node").distinct().join(classes.select("node", "key", "first_doc"), "node"), "nodes")
    sets = stored(_full_sets(nodes, df, id_col, text_col), "sets")
    components = stored(nodes.select("node", F.col("node").alias("component")), "components")

    done, now = 0, 1
    while True:
        placed = lists.filter(F.col("turn") > done).join(components, "node")
        mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        lists = stored(placed.join(mixed.select("value"), "value", "left_semi"), "open")
        if lists.isEmpty():
            break
        chosen = lists.filter(F.col("turn") <= now)
        pairs = chosen.alias("a").join(lists.alias("b"), _could_link()).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        # sets of up to WHOLE shingles are complete here, so their pairs need no second look
        retained = sets.select("node", "n", F.when(F.col("n") <= WHOLE, F.col("values")).otherwise(F.slice("values", 1, K)).alias("values"))
        complete = F.greatest("n_a", "n_b") <= WHOLE
        judged = _with_values(pairs, retained).filter(F.when(complete, _similar()).otherwise(_likely()))
        likely = stored(judged.select("a", "b", complete.alias("complete")), "likely")
        links = likely.filter("complete").select("a", "b")
        large = likely.filter("NOT complete").select("a", "b")
        if not large.isEmpty():
            links = links.unionByName(_with_values(large, sets).filter(_similar()).select("a", "b"))
        links = stored(links, "links")
        if not links.isEmpty():
            of = lambda side, name: components.select(F.col("node").alias(side), F.col("component").alias(name))
            roots = connected(links.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v"))
            renamed = components.join(roots.withColumnRenamed("node", "component"), "component", "left")
            components = stored(renamed.select("node", F.coalesce("root", "component").alias("component")), "components")
        lists = lists.drop("component")
        done, now = now, now * GROWTH

    placed = classes.select("key", "node", "first_doc").join(components, "node", "left")
    return prints, placed.select("key", "first_doc", F.coalesce("component", "node").alias("component"))


def _full_sets(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n, values): the whole set of every listed class, in rising order, from one of its texts."""
    texts = df.select(F.col(id_col).cast("long").alias("first_doc"), F.col(text_col).alias("text"))
    wanted = nodes.select("node", "key", F.col("first_doc").alias("wanted"))
    # most texts are not wanted and stay out of the shuffle; this table has at most RESIDUES rows, whatever the input
    residue = lambda c: F.pmod(F.xxhash64(c), F.lit(RESIDUES)).alias("residue")
    residues = wanted.select(residue("wanted")).distinct()
    texts = texts.withColumn("residue", residue("first_doc")).join(F.broadcast(residues), "residue", "left_semi")
    rows = texts.join(wanted, F.col("first_doc").eqNullSafe(F.col("wanted"))).select("node", "key", "text")

    def measure(batch):
        sets = [s for b in blocks(batch.column(2)) for s in _sets(b)]
        keys = batch.column(1).to_pylist()
        right = [set_key(s) == k for s, k in zip(sets, keys)]
        sets = [s for s, r in zip(sets, right) if r]
        node = batch.column(0).filter(pa.array(right, type=pa.bool_()))
        return {"node": node, "n": [len(s) for s in sets], "values": _lists(sets)}

    found = map_batches(rows, measure, "node bigint, n bigint, values array<bigint>")
    # ids that occur with several texts, or rows that are repeated, give a class more than once
    return found.dropDuplicates(["node"])


def op6_near_duplicates(spark, sf_dir):
    """Components of near-duplicates of all whole documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, min(other) = n.doc_id AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id
GROUP BY n.doc_id, n.n"""
