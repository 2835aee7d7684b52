"""Alignment of two tokenizers: groups of tokens with common byte ends, and corpus-wide counts of the linked id pairs.

1. Each text is cut where neither tokenizer can join characters (before runs of spaces), and each distinct piece is
   encoded and aligned once per worker.
2. An array gives for every A id the B id with the same bytes. A group of one A and one B token that this array expects
   needs no pair: its A id stands for it. Documents per A id are counted in vectors of the vocabulary's length.
3. Only the pairs of the other, irregular groups are shuffled and counted. The most frequent of them, a bounded number,
   are sent to the tasks together with the vectors; all rarer ones are joined, so no joined pair is a hot key.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import Block, blocks, map_batches, stored, table
from inkmark.llm.hashing import distinct_spans
from inkmark.llm.tokens import public_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bounds of a worker's memory of pieces; when it is full it starts anew.
KNOWN_PIECES, KNOWN_BYTES = 300_000, 32 << 20
# Pieces encoded together, as one text.
LINE_PIECES = 400
# Links of a group up to which they are written out before they are counted.
LARGE_GROUP = 1 << 12
# Most frequent irregular pairs that are sent to every task.
HEAVY_PAIRS = 1 << 17

SPACE = 32
# A text is never cut after white space, nor after a byte that may end a white space character or U+2581.
_OPEN = np.zeros(256, dtype=bool)
_OPEN[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def _byte_characters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Encodes pieces with both tokenizers and remembers how their tokens align."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = _byte_characters()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [special.get(i) or bytes(byte.get(c, 0) for c in t) for i, t in enumerate(names)]
        parts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(parts)]
        self.b_bytes = raw
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in of], dtype=np.int64) for of in (self.a_bytes, self.b_bytes))
        # control pieces never stand for text; a byte piece only where no other has its bytes
        usable = [i for i in range(len(raw)) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        same = {raw[i]: i for i in sorted(usable, key=lambda i: (not self.b.is_byte(i), -i))}
        self.same = np.array([same.get(t, -1) for t in self.a_bytes], dtype=np.int64)
        self.cuts = self._may_cut(a_path, parts)
        self._forget()

    @staticmethod
    def _may_cut(a_path: str, parts: list[str]) -> bool:
        """True where a cut before a run of spaces changes no ids: A splits words by pattern, B has no piece across a space."""
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        first = model.get("pre_tokenizer") or {}
        by_word = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        return bool(by_word and not model.get("normalizer") and not any("▁" in p.lstrip("▁") for p in parts))

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.numbers: dict[int, int] = {}  # pair -> its number in ``pairs``
        self.pairs = np.zeros(0, dtype=np.int64)
        self.held = 0
        self.texts: list[bytes] = []
        self.sizes = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, not valid
        self.pool = self.times = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces, many at a time as one text, and remember their groups and links."""
        lines: list[list[bytes]] = []
        line: list[bytes] = []
        for piece in new:
            if _OPEN[piece[-1]]:
                lines.append([piece])
            else:
                line.append(piece)
                if len(line) == LINE_PIECES:
                    lines.append(line)
                    line = []
        lines += [line] if line else []
        found = []
        for part in lines:
            one = self._aligned(part)
            # a line with a piece that cannot be given back is taken piece by piece
            found += [(part, one)] if one or len(part) == 1 else [([p], self._aligned([p])) for p in part]
        sizes, piece_of, codes, times = [self.sizes], [], [], []
        for part, one in found:
            first = len(self.texts)
            self.slots.update(zip(part, range(first, first + len(part))))
            self.held += sum(map(len, part))
            if one is None:
                self.texts += [b""] * len(part)
                sizes.append(np.array([[0, 0, 0, 0, 1]], dtype=np.int64))
                continue
            self.texts += one[0]
            sizes.append(one[1])
            piece_of.append(one[2] + first)
            codes.append(one[3])
            times.append(one[4])
        before = len(self.sizes)
        self.sizes = np.concatenate(sizes)
        none = [np.zeros(0, dtype=np.int64)]
        distinct, inverse = np.unique(np.concatenate(codes or none), return_inverse=True)
        old = len(self.numbers)
        numbers = np.array([self.numbers.setdefault(c, len(self.numbers)) for c in distinct.tolist()], dtype=np.int64)
        self.pairs = np.concatenate((self.pairs, distinct[numbers >= old]))
        key, times_of = _summed(np.concatenate(piece_of or none) * max(len(self.pairs), 1) + numbers[inverse], np.concatenate(times or none))
        piece, number = np.divmod(key, max(len(self.pairs), 1))
        per = np.bincount(piece - before, minlength=len(self.sizes) - before)
        self.pool, self.times = np.concatenate((self.pool, number)), np.concatenate((self.times, times_of))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(per)))

    def _aligned(self, line: list[bytes]):
        """Of the pieces of a line: texts of the groups, sizes, and the links (piece, pair, times); None if they cannot be aligned."""
        whole = b"".join(line)
        text = whole.decode("utf-8", "replace")
        ids = [self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)]
        if any(b"".join(map(of.__getitem__, i)) != whole for i, of in zip(ids, (self.a_bytes, self.b_bytes))):
            return None
        a, b = (np.array(i, dtype=np.int64) for i in ids)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common = np.intersect1d(ends_a, ends_b)
        pieces = np.cumsum([len(p) for p in line])
        if not np.isin(pieces, common).all():
            return None
        piece = np.searchsorted(pieces, common)
        stop_a, stop_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        n = n_a * n_b
        codes, of, times = [], [], []
        for g in np.flatnonzero(n > LARGE_GROUP).tolist():
            left, right = Counter(a[stop_a[g] - n_a[g] : stop_a[g]].tolist()), Counter(b[stop_b[g] - n_b[g] : stop_b[g]].tolist())
            links = {x << 32 | y: i * j for x, i in left.items() for y, j in right.items()}
            codes.append(np.array(list(links), dtype=np.int64))
            times.append(np.array(list(links.values()), dtype=np.int64))
            of.append(np.full(len(links), piece[g]))
        plain = np.where(n > LARGE_GROUP, 0, n)
        group = np.repeat(np.arange(len(n)), plain)
        step = np.arange(len(group)) - np.repeat(np.cumsum(plain) - plain, plain)
        left, right = np.divmod(step, n_b[group])
        codes.append(a[(stop_a - n_a)[group] + left] << 32 | b[(stop_b - n_b)[group] + right])
        times.append(np.ones(len(group), dtype=np.int64))
        of.append(piece[group])
        sums = np.zeros((len(common) + 1, 4), dtype=np.int64)
        np.cumsum(np.column_stack((n_a, n_b, np.ones_like(n), n)), axis=0, out=sums[1:])
        bounds = np.searchsorted(piece, np.arange(len(line) + 1))
        sizes = np.column_stack((sums[bounds[1:]] - sums[bounds[:-1]], np.zeros(len(line), dtype=np.int64)))
        said = pc.binary_join_element_wise(_joined(a, stop_a, ","), _joined(b, stop_b, ","), "|")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), said), ";").cast(pa.binary()).to_pylist()
        return texts, sizes, np.concatenate(of), np.concatenate(codes), np.concatenate(times)

    def block(self, block: Block) -> dict:
        """Columns of the block's texts."""
        spaced, starts, ends, bounds = _cut(block, self.cuts)
        numbers, strings = distinct_spans(spaced, starts, ends)
        new = [s for s in strings if s not in self.slots]
        if new and self.slots and (len(self.slots) + len(new) > KNOWN_PIECES or self.held > KNOWN_BYTES):
            self._forget()
            new = strings
        self._learn(new)
        slots = np.array([self.slots[s] for s in strings], dtype=np.int64)[numbers] if strings else np.zeros(0, dtype=np.int64)
        sums = np.zeros((len(slots) + 1, 5), dtype=np.int64)
        if len(slots):
            np.cumsum(self.sizes[slots], axis=0, out=sums[1:])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        valid = (total[:, 4] == 0) & (block.sizes > 0)
        total[~valid] = 0
        named = slots.tolist()
        digest = [
            hashlib.sha256(b";".join([self.texts[s] for s in named[x:y]])).hexdigest() if v else ""
            for x, y, v in zip(bounds[:-1].tolist(), bounds[1:].tolist(), valid.tolist())
        ]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        codes, times, offsets = self._links(text[valid[text]], slots[valid[text]], len(bounds) - 1)
        alike = self.same[codes >> 32] == (codes & 0xFFFFFFFF)
        before = np.concatenate(([0], np.cumsum(alike)))[offsets]
        column = lambda v, o, kind: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, kind))
        return {
            "n_a": total[:, 0], "n_b": total[:, 1], "n_groups": total[:, 2], "n_links": total[:, 3], "groups_sha256": digest,
            "ids": column(codes[alike] >> 32, before, pa.int32()), "id_times": column(times[alike], before, pa.int64()),
            "pairs": column(codes[~alike], offsets - before, pa.int64()), "pair_times": column(times[~alike], offsets - before, pa.int64()),
        }

    def _links(self, text: np.ndarray, slots: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs per text in rising order of text, how often each is linked, and the bounds of the texts."""
        if len(slots) == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(texts + 1, dtype=np.int64)
        both, repeats = np.unique(text * len(self.texts) + slots, return_counts=True)
        text, slots = np.divmod(both, len(self.texts))
        length = self.first[slots + 1] - self.first[slots]
        starts = np.cumsum(length) - length
        places = np.arange(int(length.sum())) + np.repeat(self.first[slots] - starts, length)
        key, times = _summed(np.repeat(text, length) * len(self.pairs) + self.pool[places], self.times[places] * np.repeat(repeats, length))
        text, number = np.divmod(key, len(self.pairs))
        return self.pairs[number], times, np.searchsorted(text, np.arange(texts + 1))


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of their times."""
    if len(key) == 0:
        return key, times
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[heads], np.add.reduceat(times[order], heads)


def _joined(ids: np.ndarray, stops: np.ndarray, sign: str) -> pa.Array:
    """The decimal ids of each group, joined."""
    offsets = pa.array(np.concatenate(([0], stops)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(ids).cast(pa.string())), sign)


def _cut(block: Block, cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each with a space before it, the bounds of their pieces, and the first piece of every text; empty texts have none."""
    data = np.frombuffer(b"".join(b" " + t for t in block.texts), dtype=np.uint8)
    begins = np.cumsum(block.sizes + 1) - block.sizes - 1
    head = np.zeros(len(data) + 1, dtype=bool)
    if cuts:
        head[1:-1] = (data[1:] == SPACE) & ~_OPEN[data[:-1]]
        # B gives no token for a space alone, so one that ends a text stays with the word before it
        head[begins + block.sizes] = False
    head[begins] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(data))
    empty = np.isin(starts, begins[block.sizes == 0])
    starts, ends = starts[~empty], ends[~empty]
    return data, starts, ends, np.searchsorted(starts, np.append(begins, len(data)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner; loaded once."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def encode_both(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct links of each row's text.

    ``ids`` (with ``id_times``) are the A ids of links that the identity array expects, ``pairs`` (with ``pair_times``) all
    other links as ``A id << 32 | B id``.
    """

    def run(batch):
        model = aligner(a_path, b_path)
        parts = [model.block(b) for b in blocks(batch.column(1))]
        joined = {name: [p[name] for p in parts] for name in parts[0]}
        whole = lambda v: pa.concat_arrays(v) if isinstance(v[0], pa.Array) else np.concatenate(v)
        return {"doc_id": batch.column(0)} | {name: whole(v) for name, v in joined.items()}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    return map_batches(rows, run, f"doc_id bigint, {sizes}, ids array<int>, id_times array<bigint>, pairs array<bigint>, pair_times array<bigint>")


def _id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """Documents per A id; a task adds its documents up in one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, dtype=np.int64)
    for row in counts.collect():  # at most one row per id of the vocabulary
        out[row.id] = row.n
    return out


def _heavy(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with the highest counts, by a cut of the counts that leaves at most ``most``; in order of the pairs."""
    level = F.floor(F.log2("n") * 8).cast("int")
    cut = None
    total = 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > most:
            break
        cut = row.level
    if cut is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rows = counts.filter(level >= cut).toArrow()
    pair, n = rows["pair"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(pair)
    return pair[order], n[order]


def _scores(lists: pa.ListArray, times: pa.ListArray, count: np.ndarray, best: np.ndarray, a_ids: np.ndarray) -> np.ndarray:
    """Per row: links whose count is their A id's best, and the sum of counts over links; a count of 0 is left out."""
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    n = times.flatten().to_numpy()
    sums = np.zeros((len(n) + 1, 2), dtype=np.int64)
    np.cumsum(np.column_stack((n * ((count == best[a_ids]) & (count > 0)), n * count)), axis=0, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def align(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", heavy_pairs: int = HEAVY_PAIRS
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty, or not given back byte by byte by both tokenizers (say with U+2581) have no tokens: zeros and
    an empty digest. A pair's count is the number of rows whose text links it; repeated rows and rows without id or with one
    id count each. Other columns are ignored, an empty table gives an empty result. Special strings are plain text.
    """
    encoded = stored(encode_both(df, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "encoded")
    size = len(aligner(a_path, b_path).a_bytes)
    ids = _id_counts(encoded, size)
    counts = encoded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "pairs")
    best = ids.copy()
    of_a = F.shiftright("pair", 32)
    for row in counts.groupBy(of_a.alias("id")).agg(F.max("n").alias("n")).collect():  # at most one row per id
        best[row.id] = max(best[row.id], row.n)
    heavy, heavy_n = _heavy(counts, heavy_pairs)

    def score(batch):
        column = dict(zip(batch.schema.names, batch.columns))
        a_ids = column["ids"].flatten().to_numpy()
        known = _scores(column["ids"], column["id_times"], ids[a_ids], best, a_ids)
        pairs = column["pairs"].flatten().to_numpy()
        at = np.minimum(np.searchsorted(heavy, pairs), max(len(heavy) - 1, 0))
        found = heavy[at] == pairs if len(heavy) else np.zeros(len(pairs), dtype=bool)
        count = np.where(found, heavy_n[at], 0) if len(heavy) else np.zeros(len(pairs), dtype=np.int64)
        known = known + _scores(column["pairs"], column["pair_times"], count, best, pairs >> 32)
        ends = np.concatenate(([0], np.cumsum(column["pairs"].value_lengths().to_numpy(zero_copy_only=False))))
        left = np.concatenate(([0], np.cumsum(~found)))[ends].astype(np.int32)
        n = column["pair_times"].flatten().to_numpy()
        rest = pa.StructArray.from_arrays([pa.array(pairs[~found]), pa.array(n[~found])], names=["pair", "times"])
        kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        more = {"n_best": known[:, 0], "count_sum": known[:, 1], "rare": pa.ListArray.from_arrays(pa.array(left), rest)}
        return {name: column[name] for name in kept} | more

    kept = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    scored = map_batches(encoded, score, f"{kept}, n_best bigint, count_sum bigint, rare array<struct<pair: bigint, times: bigint>>")
    tops = df.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best)], "id bigint, best bigint")
    judged = counts.join(F.broadcast(tops), of_a == F.col("id")).select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(judged, "pair")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"
    )


def op12_alignment(spark, sf_dir):
    """Alignment of every whole document."""
    return align(table(spark, sf_dir, "documents"), public_path(A_VOCABULARY), public_path(B_VOCABULARY))
