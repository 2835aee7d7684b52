"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from inkmark.llm.arrow import blocks, map_batches, table
from inkmark.llm.tokens import encoder, public_path

# A document is over the limit above this number of ids.
LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"


def count_tokens(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    Texts go to the library in batches of about equal bytes, long texts split at white space where the tokenizer
    allows it. A null text counts as empty (0 bytes, 0 tokens). Null ids and repeated rows stay, other columns are
    ignored whatever their names, an empty table gives an empty result. No shuffle.
    """

    def count(batch):
        model = encoder(tokenizer)
        parts = [(b.sizes, model.counts(b)) for b in blocks(batch.column(1))]
        tokens = np.concatenate([t for _, t in parts])
        return {
            id_col: batch.column(0),
            "n_bytes": np.concatenate([s for s, _ in parts]),
            "n_tokens": tokens,
            "over_limit": tokens > limit,
        }

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(
        df.select(id_col, text_col), count, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def op4_token_counts(spark, sf_dir):
    """Token counts of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_path(VOCABULARY))
