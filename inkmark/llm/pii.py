"""Personal data: fixed base rules, and further spans from candidate generators judged by boosted trees.

Generators propose many, also overlapping, spans in loose formats (spelled-out at signs, unusual separators, missing
plus signs). Boosted trees score each from its format and context; a threshold per kind, calibrated on held-out rows,
selects those that are added to the base spans.

There are no marked spans to learn from, so all documents give training rows: base spans and their rewritings in other
formats are positive; candidates that no rule confirms, and spans whose check digit, number range or length was broken on
purpose, are negative. Equal rows are counted; where the distinct ones are many, the trees grow by Spark jobs over them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import map_batches, stored, table
from inkmark.llm.boosting import MARGIN, BoostedTrees, arrays, cautious_threshold, coded, quantile_cuts

KINDS = ("email", "ip", "card", "phone")
# Distinct training rows that the driver may hold (more are left to Spark), and the precision that thresholds must reach on held-out rows.
DRIVER_ROWS = 20_000
PRECISION = 0.99
# Feature values above this count as this when the bins are chosen.
LARGEST = 1000
CONTEXT = 24

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _small(part: str) -> bool:
    """A number of at most 255; leading zeros count for nothing."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[Span]:
    """Leftmost matches in linear time: the local part is all of the run before an at sign."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    return out


def _addresses(text: str) -> list[Span]:
    """Every four parts of a dotted run are a match; those with a part over 255 are dropped."""
    out = []
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((start, end, "ip"))
            start = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules, by start and kind."""
    out = _emails(text)
    if _DIGIT.search(text):
        out += _addresses(text)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _digits(m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Covered:
    """Parts of a text as disjoint stretches in order; whether a span meets one is found by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        before = bisect_left(self.starts, span[1])
        return before > 0 and self.ends[before - 1] > span[0]

    def add(self, span: Span) -> None:
        """Take in a span that meets none."""
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[1])


_AT = r"(?:\s?(?:\(at\)|\[at\])\s?|@)"
_DOT = r"(?:\s?(?:\(dot\)|\[dot\])\s?|\.)"
_LOOSE = {
    "email": re.compile(rf"[\w.%+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}})*", re.I),
    "ip": re.compile(r"[0-9]{1,4}(?:(?:\[\.\]|\(\.\)|[.:])[0-9]{1,4}){3}"),
    "card": re.compile(r"[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}"),
    "phone": re.compile(r"[+(]{0,2}[0-9][0-9\x20()./-]{6,22}[0-9]"),
}
_AT_SIGN = re.compile(r"@|\(at\)|\[at\]", re.I)
_NUMBERS = re.compile(r"[+(]{0,2}[0-9][0-9\x20()\[\]./:_-]{5,80}[0-9]")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap."""
    out = set()
    for m in _AT_SIGN.finditer(text):
        low = max(0, m.start() - 70)
        out |= {(low + c.start(), low + c.end(), "email") for c in _LOOSE["email"].finditer(text[low : m.end() + 200])}
    for m in _NUMBERS.finditer(text):
        for kind in ("ip", "card", "phone"):
            out |= {(m.start() + c.start(), m.start() + c.end(), kind) for c in _LOOSE[kind].finditer(m.group())}
    return sorted(out)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, end, kind = span
    inner = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(inner)
    groups = [len(g) for g in re.findall("[0-9]+", inner)]
    parts = re.findall("[0-9]+", inner)
    separators = re.findall(r"[^0-9A-Za-z]+", inner)
    left, right = before[-1:], after[:1]
    host = re.split(_AT, inner, maxsplit=1, flags=re.I)[-1]
    labels = re.split(_DOT, host, flags=re.I)
    return [
        *(float(kind == k) for k in KINDS),
        len(inner), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        len(set(separators)), len(separators), float("/" in inner), float(":" in inner), float("-" in inner), float("(" in inner),
        float(inner.startswith("+")), float(inner.startswith("00")), float(luhn(digits) if digits else False),
        float(all(map(_small, parts))), float(len(set(groups)) == 1),
        len(labels) if kind == "email" else 0, len(labels[-1]) if kind == "email" else 0,
        float(labels[-1].isalpha()) if kind == "email" else 0,
        float(left.isalpha()), float(right.isalpha()), float(left.isdigit()), float(right.isdigit()),
        float(left in "\"'=#/.-:" and left != ""), float(right in "\"'=#/-:%" and right != ""),
        sum(c.isdigit() for c in before) / CONTEXT, sum(c.isdigit() for c in after) / CONTEXT,
        float("=" in before), float(":" in before), len(re.split(r"\s", before)[-1]),
    ]


def _grouped(digits: str, joint: str) -> str:
    return joint.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def rewritings(inner: str, kind: str, turn: int) -> list[tuple[str, int]]:
    """Variants of a base span with their class: other formats of it (1), and broken ones (0)."""
    digits = _digits(inner)
    if kind == "email":
        name, _, host = inner.partition("@")
        return [
            (f"{name} (at) {host}", 1), (f"{name}[at]{host}", 1), (f"{name} (at) {host.replace('.', ' (dot) ')}", 1),
            (f"{name}@{host.split('.')[0]}", 0), (f"{name} (at) {host.split('.')[0]}", 0),
        ]
    if kind == "ip":
        first, _, rest = inner.partition(".")
        large = str(256 + turn % 700)
        return [
            (inner.replace(".", "[.]"), 1), (inner.replace(".", "(.)"), 1),
            (f"{large}.{rest}", 0), (f"{large}[.]{rest.replace('.', '[.]')}", 0), (inner.replace(".", ":"), 0),
        ]
    if kind == "card":
        broken = digits[:-1] + str((int(digits[-1]) + 1 + turn % 9) % 10)
        joint = "./_"[turn % 3]
        return [(_grouped(digits, joint), 1), (_grouped(digits, "  "), 1), (_grouped(broken, joint), 0), (_grouped(broken, " "), 0), (broken, 0)]
    plain = inner.lstrip("+")
    return [
        (f"00{plain}", 1), (f"(+{plain}", 1), (plain.replace(" ", "/"), 0),
        (digits[:4] + "-" + digits[4:6] + "-" + digits[6:8], 0), (digits[:8], 0), (digits[:5] + "/" + digits[5:8], 0),
    ]


def training_rows(text: str) -> list[tuple[int, list[float]]]:
    """(class, features) of a text's candidates and of rewritten base spans in their place."""
    base = base_spans(text)
    exact, covered = set(base), Covered(base)
    out = []
    for span in candidates(text):
        if span in exact:
            out.append((1, features(text, span)))
        elif not covered.meets(span):
            out.append((0, features(text, span)))
    for start, end, kind in base:
        inner = text[start:end]
        for variant, target in rewritings(inner, kind, zlib.crc32(inner.encode())):
            changed = text[max(0, start - 200) : start] + variant + text[end : end + 200]
            at = min(start, 200)
            out.append((target, features(changed, (at, at + len(variant), kind))))
    return out


@dataclass
class PiiModel:
    trees: BoostedTrees
    thresholds: dict[str, float]


def training_counts(docs: DataFrame) -> DataFrame:
    """(learn, target, features, n): the distinct training rows of all documents, how often they occur, and which are learned from."""
    texts = docs.select("text").filter(F.col("text").rlike("[0-9@]"))

    def measure(batch):
        rows = Counter((t, tuple(f)) for text in batch.column(0).to_pylist() for t, f in training_rows(text or ""))
        # the side follows the row itself, so it does not depend on partitions
        learn = [zlib.crc32(repr((t, list(f))).encode()) // 7 % 2 == 0 for t, f in rows]
        return {"learn": learn, "target": [t for t, _ in rows], "features": [list(f) for _, f in rows], "n": list(rows.values())}

    rows = map_batches(texts, measure, "learn boolean, target int, features array<double>, n bigint")
    return rows.groupBy("learn", "target", "features").agg(F.sum("n").alias("n"))


def fit_pii(docs: DataFrame, driver_rows: int = DRIVER_ROWS) -> PiiModel | None:
    """Trees and thresholds from the training rows of all documents; the result does not depend on ``driver_rows``.

    None where no document has a base span; the base rules then stand alone. The driver gets distinct feature rows if they
    are few, else counts of values, bins and margins, whose number is bounded.
    """
    rows = stored(training_counts(docs), "pii-rows")
    if rows.filter("target = 1").isEmpty():
        return None
    few = rows.limit(driver_rows + 1).count() <= driver_rows
    cell = F.least("value", F.lit(float(LARGEST)))
    values = rows.filter("learn").select("n", F.posexplode("features").alias("feature", "value")).groupBy("feature", cell.alias("value"))
    found: list[dict[float, int]] = [{} for _ in features("", (0, 0, KINDS[0]))]
    for v in values.agg(F.sum("n").alias("n")).collect():
        found[v.feature][v.value] = v.n
    cuts = [quantile_cuts(np.array(sorted(f)), np.array([f[v] for v in sorted(f)])) for f in found]

    def code(batch):
        data = np.array(batch.column(2).to_pylist()).reshape(-1, len(cuts))
        codes, kind = [c.tobytes() for c in coded(data, cuts)], data[:, : len(KINDS)].argmax(axis=1)
        return {"target": batch.column(1), "codes": codes, "n": batch.column(3), "learn": batch.column(0), "kind": kind}

    rows = map_batches(rows, code, "target int, codes binary, n bigint, learn boolean, kind int")
    rows = rows.groupBy("target", "codes", "learn", "kind").agg(F.sum("n").alias("n")).select("target", "codes", "n", "learn", "kind")
    if few:
        held = rows.toArrow().combine_chunks()
        learn = held.column("learn").to_numpy()
        codes, target, n = arrays(held, len(cuts))
        trees = BoostedTrees.of_codes(cuts, codes[learn], target[learn], n[learn])
        kind, margin = held.column("kind").to_numpy()[~learn], _steps(trees, codes[~learn])
        marks = list(zip(kind.tolist(), margin.tolist(), target[~learn].tolist(), n[~learn].tolist()))
    else:
        rows = stored(rows, "pii-codes")
        trees = BoostedTrees.of_table(cuts, rows.filter("learn").select("target", "codes", "n"))

        def judge(batch):
            return {"kind": batch.column(3), "margin": _steps(trees, arrays(batch, len(cuts))[0]), "target": batch.column(0), "n": batch.column(2)}

        judged = map_batches(rows.filter("NOT learn").select("target", "codes", "n", "kind"), judge, "kind int, margin int, target int, n bigint")
        marks = judged.groupBy("kind", "margin", "target").agg(F.sum("n").alias("n")).collect()
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = np.array([m[1:] for m in marks if m[0] == i], dtype=np.float64).reshape(-1, 3)
        chances = 1 / (1 + np.exp(-own[:, 0] / MARGIN))
        thresholds[kind] = max(0.5, cautious_threshold(chances, own[:, 1], PRECISION, own[:, 2]))
    return PiiModel(trees, thresholds)


def _steps(trees: BoostedTrees, codes: np.ndarray) -> np.ndarray:
    """Margins in whole steps, rounded down: a bounded number of them says where the thresholds lie."""
    return np.clip(np.floor(trees.code_margins(codes) * MARGIN), -32 * MARGIN, 32 * MARGIN).astype(np.int32)


def all_spans(text: str, model: PiiModel | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans). Added spans overlap no base span and each other not; likelier ones go first."""
    base = base_spans(text)
    if model is None:
        return base, base
    covered = Covered(base)
    free = [c for c in candidates(text) if not covered.meets(c)]
    if not free:
        return base, base
    chances = model.trees.chances(np.array([features(text, c) for c in free]))
    added: list[Span] = []
    for chance, span in sorted(zip(-chances, free)):
        if -chance >= model.thresholds[span[2]] and not covered.meets(span):
            covered.add(span)
            added.append(span)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, or union of overlapping spans, replaced by the kind of the first."""
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out.append(text[last:start] + f"<{kind.upper()}>")
        last = max(last, end)
    return "".join(out) + text[last:]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_pii(df: DataFrame, model: PiiModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns named in ``keep``, base counts, base_sha256, spans, and ``redacted``.

    Offsets are code points, ends exclusive. A null text has no spans and stays null. Null ids and repeated rows stay;
    columns that are not named are ignored. No shuffle.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def find(batch):
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "redacted": []}
        for text in batch.column(1).to_pylist():
            base, spans = all_spans(text or "", model)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(spans))
            out["redacted"].append(text if not spans else redact(text, spans))
        return {id_col: batch.column(0), **{c: batch.column(2 + i) for i, c in enumerate(keep)}, **out}

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    schema += ", n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, redacted string"
    return map_batches(df.select(id_col, text_col, *keep), find, schema)


def op3_pii(spark, sf_dir):
    """Personal data in every whole document."""
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit_pii(docs)).drop("redacted")
