import hashlib
from collections import Counter, defaultdict

import pytest

from inkmark.llm import alignment
from inkmark.llm.alignment import A_VOCABULARY, B_VOCABULARY, align, op12_alignment
from inkmark.llm.tokens import public_path
from tests.llm.cases import odd_rows

A, B = public_path(A_VOCABULARY), public_path(B_VOCABULARY)


def brute(rows):
    """Whole texts through both libraries, all links counted in dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    # one character per byte, read off what the library itself writes
    alphabet = {}
    for code in (*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x40)):
        written = "".join(t for t, _ in a_model.pre_tokenizer.pre_tokenize_str(chr(code)))
        alphabet.update(zip(written, chr(code).encode(), strict=True))
    links, sizes = [], []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            links.append(Counter())
            sizes.append((0, 0, 0, 0, ""))
            continue
        ends = [0, 0]
        at = []
        for side, parts in enumerate((a_bytes, b_bytes)):
            run, out = 0, []
            for p in parts:
                run += len(p)
                out.append(run)
            at.append(out)
        common = sorted(set(at[0]) & set(at[1]))
        groups, ends = [], [0, 0]
        for c in common:
            stop = [at[0].index(c, ends[0]) + 1, at[1].index(c, ends[1]) + 1]
            groups.append((a[ends[0] : stop[0]], b[ends[1] : stop[1]]))
            ends = stop
        own = Counter((x, y) for left, right in groups for x in left for y in right)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links.append(own)
        sizes.append((len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(said.encode()).hexdigest()))
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), own, (n_a, n_b, n_groups, n_links, digest) in zip(rows, links, sizes):
        n_best = sum(n for p, n in own.items() if count[p] == best[p[0]])
        out.append((doc, n_a, n_b, n_groups, n_links, n_best, sum(n * count[p] for p, n in own.items()), digest))
    return sorted(out, key=str)


def result(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


TEXTS = [
    "Unaffable cafés, naïve rôles.", "  two  spaces   three\t tab\n\nlines \n x", " leading", "trailing ", "trailing  ", " ",
    "a  b   c  d 　e", "under▁score here", "▁", "x▁ y", "日本語のテキスト です。", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "1234567890 12 3 456789", "don't we'll they've I'M", "emoji \U0001f600\U0001f601 é", "\r\n\r\n \x00 \x1c\x85", "aaaa" * 60 + " " + "ab" * 99,
    "a   ", "word" + " " * 40 + "word", "Same text here", "Same text here", "ending à", "ending à more", "x \n\nfoo  ",
]


@pytest.mark.parametrize("heavy", [0, 12, 1 << 17])
def test_texts(spark, heavy):
    rows = [*enumerate(TEXTS), (3, "Same text here"), (None, "two words"), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(align(df, A, B, heavy_pairs=heavy)) == brute(rows)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    plain = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    assert result(align(rows, A, B)) == brute(plain)
    assert align(rows.limit(0), A, B).collect() == []


def test_a_small_memory_of_pieces(monkeypatch):
    import numpy as np

    from inkmark.llm.arrow import Block

    texts = [t.encode() for t in TEXTS]
    whole = alignment.Aligner(A, B).block(Block(texts, 0))
    monkeypatch.setattr(alignment, "KNOWN_PIECES", 5)
    model = alignment.Aligner(A, B)
    for first in range(0, len(texts), 4):
        part = model.block(Block(texts[first : first + 4], 0))
        assert part["groups_sha256"] == whole["groups_sha256"][first : first + 4]
        assert np.array_equal(part["n_links"], whole["n_links"][first : first + 4])


def test_op12_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op12_alignment(spark, sf_dir)) == brute(docs)
