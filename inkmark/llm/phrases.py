"""Phrase collocations by SON partitioning: local mining at lowered support, union, exact counting of all candidates.

1. Documents fall into ``SHARDS`` shards by hash. A task adds up the word windows of its part of a shard under 40-bit
   fingerprints, cut into buckets; a (language, shard, bucket) is mined whole, at the support lowered in proportion to the
   shard's share of the language's words. A phrase that reaches the support reaches it, so lowered, in some shard.
2. The union of the locally frequent fingerprints is a bit map of fixed size. It may pass phrases that are not frequent
   (two fingerprints with one bit), never the reverse.
3. All windows that pass are counted exactly, as text, over all documents; then the support decides.

Fingerprints and bit map only choose what is counted, so no result rests on them. A shard is mined by many tasks; the
number of shards stays small because a lowered support of one would prune nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.llm.arrow import stored, table
from inkmark.llm.bitmaps import bitmap, is_set
from inkmark.llm.hashing import U, distinct_spans, lowered, mix, string_hashes

SUPPORT, MOST_WORDS, TOP, PERCENT = 10, 3, 2000, 50
SHARDS = 4
# Bits of the map of candidates.
BITS = 1 << 27
# Bytes of fingerprints in a bucket, about, and bounds of their number.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16
# Words that a task holds before it hands on what it has counted.
FLUSH_WORDS = 3_000_000
# Most frequent phrases that are sent to every task when the parts of candidates are looked up.
HEAVY_PARTS = 50_000

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_FINGERPRINT = 40


class Windows:
    """Words of the texts of one language and shard, numbered, and where a window of two or three of them lies in one piece."""

    def __init__(self, texts: list[bytes], lang: str):
        data = lowered(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _GAP[data], [True])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
        piece = breaks[starts]
        self.joined = piece[1:] == piece[:-1]
        self.numbers, self.words = distinct_spans(data, starts, ends)
        self.numbers = self.numbers.astype(np.int64)
        self.hashes = mix(string_hashes(self.words) ^ string_hashes([lang.encode()])[0]) if self.words else np.zeros(0, dtype=U)

    def fingerprints(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For windows of 2, 3 words: their first words' places and fingerprints."""
        own = self.hashes[self.numbers]
        value, ok = own, np.ones(len(own), dtype=bool)
        for size in range(2, MOST_WORDS + 1):
            n = max(len(own) - size + 1, 0)
            value = mix(value[:n] * U(0x9E3779B97F4A7C15) + own[size - 1 :])
            ok = ok[:n] & self.joined[size - 2 :]
            at = np.flatnonzero(ok)
            yield at, value[at] >> U(64 - _FINGERPRINT)


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple[tuple, list[bytes]]]]:
    """(lang, shard, ...) -> texts, in parts of a bounded size."""
    part: dict[tuple, list[bytes]] = {}
    size = 0
    for batch in batches:
        for text, *key in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            part.setdefault(tuple(key), []).append(text)
            size += len(text)
            if size >= words * 6:
                yield list(part.items())
                part, size = {}, 0
    if part:
        yield list(part.items())


def _packed(values: np.ndarray) -> bytes:
    """40-bit numbers in five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _rows(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(text.cast("binary").alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, shard, n): a task hands on what it counted in parts of a bounded size."""

    def run(batches):
        for part in _texts(batches, FLUSH_WORDS):
            for (lang, shard), texts in part:
                w = Windows(texts, lang)
                n = np.bincount(w.numbers, minlength=len(w.words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(w.words, pa.binary()).cast(pa.string()), pa.array([shard] * len(n), pa.int32()), pa.array(n)],
                    names=["lang", "phrase", "shard", "n"],
                )

    return rows.mapInArrow(run, "lang string, phrase string, shard int, n bigint")


def _local_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """(lang, shard, bucket, once, often, times): fingerprints that a part holds once, others, and how often it holds these."""

    def run(batches):
        for part in _texts(batches, FLUSH_WORDS):
            for (lang, shard), texts in part:
                prints = np.concatenate([v for _, v in Windows(texts, lang).fingerprints()])
                prints, n = np.unique(prints, return_counts=True)
                bucket = (prints * U(buckets)) >> U(_FINGERPRINT)
                bounds = np.searchsorted(bucket, np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    own, times = prints[bounds[b] : bounds[b + 1]], n[bounds[b] : bounds[b + 1]]
                    often = times > 1
                    out.append((lang, shard, b, _packed(own[~often]), _packed(own[often]), times[often].astype("<i4").tobytes()))
                if out:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "shard", "bucket", "once", "often", "times"])

    return rows.mapInArrow(run, "lang string, shard int, bucket int, once binary, often binary, times binary")


def _mined(local: DataFrame) -> DataFrame:
    """Fingerprints that reach the lowered support ``least`` within their shard."""

    def run(group: pa.Table) -> pa.Table:
        once = _unpacked(b"".join(group["once"].to_pylist()))
        often = _unpacked(b"".join(group["often"].to_pylist()))
        times = np.frombuffer(b"".join(group["times"].to_pylist()), dtype="<i4")
        prints = np.concatenate((once, often))
        order = np.argsort(prints)
        prints = prints[order]
        heads = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        total = np.add.reduceat(np.concatenate((np.ones(len(once), dtype=np.int64), times))[order], heads)
        return pa.table({"print": pa.array(prints[heads][total >= group["least"][0].as_py()].astype(np.int64))})

    return local.groupBy("lang", "shard", "bucket").applyInArrow(run, "print bigint")


def _candidate_counts(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, phrase, size, n) of the windows of two and three words that pass the bit map; added up within a part."""

    def run(batches):
        for part in _texts(batches, FLUSH_WORDS):
            by_lang: dict[str, list[bytes]] = {}
            for (lang, _), texts in part:
                by_lang.setdefault(lang, []).extend(texts)
            for lang, texts in by_lang.items():
                w = Windows(texts, lang)
                words = pa.array(w.words, pa.binary()).cast(pa.string())
                for size, (at, prints) in enumerate(w.fingerprints(), 2):
                    at = at[is_set(bits, prints)]
                    first = w.numbers[at]
                    for i in range(1, size):
                        key, inverse, n = np.unique(first * len(w.words) + w.numbers[at + i], return_inverse=True, return_counts=True)
                        if i < size - 1:
                            # a number per distinct beginning keeps the key within 64 bits
                            first, heads = inverse, key
                    ends = [key % max(len(w.words), 1)]
                    begin = key // max(len(w.words), 1)
                    if size == 3:
                        ends.insert(0, heads[begin] % max(len(w.words), 1))
                        begin = heads[begin] // max(len(w.words), 1)
                    phrase = pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in (begin, *ends)), " ")
                    for a in range(0, len(n), 50_000):
                        own = phrase.slice(a, 50_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(own), pa.string()), own, pa.array([size] * len(own), pa.int32()), pa.array(n[a : a + 50_000])],
                            names=["lang", "phrase", "size", "n"],
                        )

    return rows.mapInArrow(run, "lang string, phrase string, size int, n bigint")


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _looked_up(cuts: DataFrame, counts: DataFrame, heavy: DataFrame, part: str, name: str) -> DataFrame:
    """The count of a part of each candidate.

    The most frequent phrases, the only ones that many candidates share, are sent to every task; the others are joined.
    """
    top = heavy.select("lang", F.col("phrase").alias(part), F.col("f").alias("_top"))
    some = cuts.join(F.broadcast(top), ["lang", part], "left")
    rest = counts.join(heavy.select("lang", "phrase"), ["lang", "phrase"], "left_anti").select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    known = some.filter("_top IS NOT NULL").withColumnRenamed("_top", name)
    return known.unionByName(some.filter("_top IS NULL").drop("_top").join(rest, ["lang", part]))


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP, percent: int = PERCENT
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words per language.

    Texts are cut at ``.,;:!?`` and line ends and split at spaces and tabs, A-Z in lower case. ``a`` is the phrase's count, ``l``
    and ``r`` those of its two parts at the cut with the lowest score floor(10^6 a^2 / (l r)), the first of such cuts. Phrases
    inside a longer one with at least ``percent`` of their count are left out. Rows are ordered by score, count and phrase, so
    ties have one order. A null text is empty, a null language ``und``; repeated rows count each; other columns and ids are
    ignored; an empty table gives an empty result. Counts must stay below 10^15.
    """
    rows = _rows(df, text_col, lang_col)
    words = stored(_word_counts(rows).groupBy("lang", "phrase", "shard").agg(F.sum("n").alias("n")), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    share = words.groupBy("lang", "shard").agg(F.sum("n").alias("own")).join(total, "lang")
    # ceil(support * own / total) in whole numbers
    least = share.select("lang", "shard", F.expr(f"({support} * own + total - 1) div total").alias("least"))
    tokens = total.agg(F.sum("total")).first()[0] or 0
    buckets = max(16, min(MOST_BUCKETS, tokens * (MOST_WORDS - 1) * 5 // (SHARDS * BUCKET_BYTES)))
    mined = _mined(_local_windows(rows, buckets).join(F.broadcast(least), ["lang", "shard"]))
    bits = bitmap(mined.select(F.pmod("print", F.lit(BITS)).alias("residue")), "residue", BITS)
    counted = _candidate_counts(rows, bits).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    single = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    counts = stored(counted.unionByName(single.withColumn("size", F.lit(1))), "phrases")
    heavy = stored(counts.filter("size < 3").orderBy(F.desc("f"), "lang", "phrase").limit(HEAVY_PARTS), "heavy")

    found = counts.filter("size > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = found.select("lang", "phrase", "size", F.col("f").alias("a"), cut.alias("k"))
    cuts = cuts.withColumn("left", _part(F.lit(1), F.col("k"))).withColumn("right", _part(F.col("k") + 1, F.col("size")))
    cuts = _looked_up(_looked_up(cuts, counts, heavy, "left", "l"), counts, heavy, "right", "r")
    square = "CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))"
    cuts = cuts.withColumn("score", F.expr(f"{square} div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    longer = found.filter("size = 3").select(
        "lang", "f", F.explode(F.array(_part(F.lit(1), F.lit(2)), _part(F.lit(2), F.lit(3)))).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"most IS NULL OR 100 * most < {percent} * a"))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task ranks more than a bounded number of rows of each part
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    out = ranked.join(F.broadcast(total), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark, sf_dir):
    """Collocations of all whole documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w, (VALUES (1), (2), (3)) AS sizes(k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT c.lang, c.k, c.g, a, i, u.f AS l, v.f AS r, ((1000000::HUGEINT * a * a) // (u.f::HUGEINT * v.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f u ON u.lang = c.lang AND u.g = array_to_string(c.w[1:i], ' ') JOIN f v ON v.lang = c.lang AND v.g = array_to_string(c.w[i + 1:], ' ')),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
o AS (SELECT lang, g, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g
  FROM c WHERE k = 3) GROUP BY lang, g)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank, s.g AS phrase, a, l, r, n, score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.g = s.g WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000"""
