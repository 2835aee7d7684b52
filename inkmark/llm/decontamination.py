"""Benchmark decontamination by templates, which also finds questions with changed numbers, names or units.

Texts become tokens without punctuation in lower case; numbers, names (capitalised inside a sentence) and units after a
number become typed placeholders. Windows are joined by hash with the windows of the benchmark, both by their literal
tokens, which know neither case nor punctuation, and by these templates. Template matches on one diagonal (document
position minus item position) must fill the slots consistently: an item's value stands for one value in the document. A
document is contaminated by an item if literal matches and consistent diagonals cover enough of the item's windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import Block, blocks, map_batches, stored, table
from inkmark.llm.hashing import U, combine, is_space, span_hashes, words_of

WINDOW = 8
SHORTEST = 3
COVERAGE = 0.5
CONSISTENT = 0.8
# Benchmark windows up to this number (8 bytes each) are sent to the tasks; beyond it all windows take the shuffled join.
SENT_WINDOWS = 2_000_000

# Fixed list of units.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh watt watts volt volts"
).split()

_NUMBER, _NAME, _UNIT = (U(x) for x in (0x6E756D626572, 0x6E616D65, 0x756E6974))
# Keeps template hashes apart from literal ones.
_TEMPLATE = 1 << 32
_KEPT = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BLANK = np.array([is_space(b) for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_SMALL = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?:;"))


def _unit_hashes() -> np.ndarray:
    data = " ".join(UNITS).encode()
    array = np.frombuffer(data, dtype=np.uint8)
    return np.unique(span_hashes(array, *words_of(array)))


def _titled(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of a capital and a small letter: ASCII or Latin-1 capitals; other scripts have none. ``size`` is in bytes."""
    at = lambda i: data[np.minimum(i, len(data) - 1)]
    wide = (at(first) == 0xC3) & (at(first + 1) >= 0x80) & (at(first + 1) <= 0x9E)
    second = first + 1 + wide
    small = _SMALL[at(second)] & ~((at(second) == 0xC3) & (at(second + 1) < 0xA0))
    return (size > 1 + wide) & (_CAPITAL[at(first)] | wide) & small


def _small_letters(block: Block) -> np.ndarray:
    """The block's bytes in lower case, sharp s as ss, its upper case; the few texts whose length would change keep their other than ASCII letters."""

    def lower(text: bytes) -> bytes:
        small = text.decode("utf-8", "replace").lower().replace("ß", "ss").encode()
        return small if len(small) == len(text) else text.lower()

    return np.frombuffer(b"\n".join(map(lower, block.texts)) + b"\n", dtype=np.uint8)


class Tokens:
    """Tokens of a block: literal hash, template code (the hash, or a placeholder), and bounds per text."""

    def __init__(self, block: Block):
        data = block.data
        starts, ends = words_of(data)
        kept = _KEPT[data]
        total = np.concatenate(([0], np.cumsum(kept | _BLANK[data])))
        clean = _small_letters(block)[kept | _BLANK[data]]
        letters = np.concatenate(([0], np.cumsum(kept)))
        has = letters[ends] > letters[starts]
        # a word opens a sentence at the start of a text or line, or after a word that ends with a stop
        opens = np.ones(len(starts), dtype=bool)
        opens[1:] = _STOP[data[ends[:-1] - 1]]
        opens |= (starts == 0) | (data[np.maximum(starts, 1) - 1] == 10)
        starts, ends, opens = starts[has], ends[has], opens[has]
        title = _titled(data, np.flatnonzero(kept)[letters[starts]], letters[ends] - letters[starts]) if len(starts) else opens
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        number = digits[ends] > digits[starts]
        self.literal = span_hashes(clean, total[starts], total[ends])
        self.bounds = block.counts(starts)
        after = np.zeros(len(starts), dtype=bool)
        after[1:] = number[:-1]
        unit = after & ~number & np.isin(self.literal, _unit_hashes())
        name = title & ~opens & ~number & ~unit
        self.slot = number | unit | name
        self.code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, self.literal)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Literal and template hash of the window at each token, whether it lies in one text, and its number of slots."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=U), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        filled = np.concatenate(([0], np.cumsum(self.slot)))
        text = np.searchsorted(self.bounds, np.arange(len(self.code)), side="right")
        inside = text[:n] == text[size - 1 :]
        return combine(self.literal, size) ^ U(size), combine(self.code, size) ^ U(size + _TEMPLATE), inside, filled[size:] - filled[:n]


def _found(block: Block, sizes: tuple[int, ...], wanted: np.ndarray | None, whole: bool) -> list[tuple]:
    """(text number, position, window, slot values, literal, half) of the windows; ``whole`` keeps a size only for texts of it.

    Every window has a literal row, without slot values. One with slots, of which at least half is literal, has a template
    row too. ``half`` says whether at least half of the window is literal.
    """
    tokens = Tokens(block)
    lengths = np.diff(tokens.bounds)
    out = []
    for size in sizes:
        literal, template, inside, slots = tokens.windows(size)
        half = 2 * slots <= size
        for windows, usable, plain in ((literal, inside, True), (template, inside & half & (slots > 0), False)):
            at = np.flatnonzero(usable)
            if wanted is not None:
                at = at[np.isin(windows[at], wanted)]
            for i in at.tolist():
                text = int(np.searchsorted(tokens.bounds, i, side="right")) - 1
                if whole and size != min(WINDOW, lengths[text]):
                    continue
                filled = tokens.slot[i : i + size] & (not plain)
                values = [int(v) if s else None for v, s in zip(tokens.literal[i : i + size].view(np.int64), filled)]
                out.append((text, i - int(tokens.bounds[text]), int(windows[i].view(np.int64)), values, plain, bool(half[i])))
    return out


def _window_rows(df: DataFrame, id_col: str, text_col: str, name: str, sizes: tuple[int, ...], wanted, whole: bool) -> DataFrame:
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)
    fields = (name, "position", "window", "slots", "literal", "half")

    def find(batch):
        ids, rows = batch.column(0).to_pylist(), []
        for block in blocks(batch.column(1)):
            known = None if sent is None else sent.value
            rows += [(ids[block.first + t], *row) for t, *row in _found(block, sizes, known, whole)]
        columns = dict(zip(fields, list(zip(*rows)) or [[]] * len(fields)))
        return columns | {"slots": pa.array(columns["slots"], type=pa.list_(pa.int64()))}

    kind = "binary" if df.schema[id_col].dataType.simpleString() == "binary" else "bigint"
    rows = df.select(F.col(id_col).cast(kind), text_col)
    return map_batches(rows, find, f"{name} {kind}, position bigint, window bigint, slots array<bigint>, literal boolean, half boolean")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE, consistent: float = CONSISTENT,
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hit, coverage, kind) for every document that holds enough of an item.

    ``kind`` is ``exact`` if all slots are filled alike and ``reparameterised`` otherwise. An item shorter than a window
    is one window, below three tokens it is not searched for. Literal copies are found whatever their case and punctuation,
    and also where most of a window is slots. Changed numbers, names and units are found in windows that are at least half
    literal, names only where capitals show them; an item is held by enough of all its windows, or of these. Null or empty texts match nothing; rows that share an id
    are one document, rows without id likewise; ids are whole numbers or binary keys; repeated items count each under their ids. Other columns are ignored.
    Only matching windows leave the tasks; a window common to many documents meets few rows of the benchmark.
    """
    sizes = tuple(range(SHORTEST, WINDOW + 1))
    items = stored(_window_rows(benchmark, item_col, item_text_col, "item_id", sizes, None, whole=True), "item-windows")
    distinct = items.select("window").distinct()
    known = distinct.limit(SENT_WINDOWS + 1).collect()
    wanted = None if len(known) > SENT_WINDOWS else np.array(sorted(r.window for r in known), dtype=np.int64).view(U)
    used = tuple(sorted(r[0] for r in items.select(F.size("slots")).distinct().collect())) or (WINDOW,)
    hits = _window_rows(docs, id_col, text_col, "doc_id", used, wanted, whole=False)
    theirs = items.select("window", "item_id", F.col("position").alias("item_position"), F.col("slots").alias("item"), "half")
    pairs = hits.select("doc_id", "position", "window", "literal", F.col("slots").alias("doc")).join(theirs, "window").select(
        "doc_id", "item_id", "literal", F.struct(F.col("item_position").alias("at"), "half").alias("item_window"),
        (F.col("position") - F.col("item_position")).alias("diagonal"),
        F.expr("filter(arrays_zip(item, doc), p -> p.item IS NOT NULL)").alias("filled"),
    )
    # distinct values are at most the item's tokens, so these sets are small
    lines = pairs.groupBy("doc_id", "item_id", "diagonal", "literal").agg(
        F.collect_set("item_window").alias("hit"),
        F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"),
    )
    values = F.size(F.array_distinct(F.expr("transform(filled, p -> p.item)")))
    lines = lines.filter((F.size("filled") == 0) | (values >= F.lit(consistent) * F.size("filled")))
    equal = F.expr("forall(filled, p -> p.item <=> p.doc)")
    found = lines.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min(equal).alias("equal"))
    found = found.withColumn("all_hit", F.size("hit")).withColumn("half_hit", F.size(F.expr("filter(hit, h -> h.half)")))
    windows = items.filter("literal").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("half").alias("n_half"))
    # windows full of slots have no template: without them, an item counts as before; the larger of the two shares decides
    larger = F.coalesce(F.col("all_hit") * F.col("n_half") >= F.col("half_hit") * F.col("n_all"), F.lit(True))
    found = found.join(windows, "item_id").select(
        "doc_id", "item_id", F.when(larger, F.col("n_all")).otherwise(F.col("n_half")).alias("n_windows"),
        F.when(larger, F.col("all_hit")).otherwise(F.col("half_hit")).cast("long").alias("n_hit"), "equal",
    )
    share = F.col("n_hit") / F.col("n_windows")
    return found.filter(share >= coverage).select(
        "doc_id", "item_id", "n_windows", "n_hit", share.alias("coverage"), F.when(F.col("equal"), "exact").otherwise("reparameterised").alias("kind")
    )


def op10_decontamination(spark, sf_dir):
    """Documents that hold benchmark items, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
