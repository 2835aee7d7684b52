"""Registered queries of the subpackage."""

from __future__ import annotations

from inkmark.llm.alignment import op12_alignment
from inkmark.llm.compression_quality import op7_quality_score
from inkmark.llm.decontamination import op10_decontamination
from inkmark.llm.language import op9_language
from inkmark.llm.packing import op5_packing
from inkmark.llm.phrases import OP13_SQL, op13_collocations
from inkmark.llm.pii import op3_pii
from inkmark.llm.quality_rules import op8_quality_rules
from inkmark.llm.sketch_dedup import OP6_SQL, op6_near_duplicates
from inkmark.llm.suffix_dedup import op11_repeats
from inkmark.llm.token_counts import op4_token_counts
from inkmark.llm.token_store import op1_token_ids
from inkmark.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_score": op7_quality_score,
    "op8_quality_rules": op8_quality_rules,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_repeats": op11_repeats,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
}
#: The other queries fit models or use a tokenizer's library; tests hold them against brute force.
ORACLES = {
    "op2_warc": OP2_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op13_collocations": OP13_SQL,
}
