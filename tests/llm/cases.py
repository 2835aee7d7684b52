"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
CLASHING = "key shard part n node value window position slots n_tokens score lang_pred kept held_out group redacted _cell first text_hash"


def odd_rows(spark):
    rows = [
        (1, "The cat sat on the mat. The cat sat on the mat."),
        (1, "The cat sat on the mat. The cat sat on the mat."),
        (2, None),
        (3, ""),
        (None, "a b c d e f g"),
        (None, None),
        (4, " \t\n\x0b\x0c\r "),
        (5, LONG),
        (6, LONG),
        (7, "é ß <|endoftext|> 'S ́x   \U0001f600 naïve‍"),
        (8, "x" * 50_000),
        (9, "1" * 30_000 + "." + "2" * 30_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHING.split()))


def key_of(row):
    return (row[0] is None, row[0] or 0, str(row[1:]))
