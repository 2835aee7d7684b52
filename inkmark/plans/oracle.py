"""Fragments of the DuckDB SQL that checks the registered queries."""

from __future__ import annotations

SPACE_CHARS = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

DOCS = """
docs AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS label, CAST(l.toxic AS INTEGER) AS toxic,
         d.lang AS domain, d.source AS grp, d.n_chars, 'docs' AS dataset_name
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

CONV = """
conv AS (
  SELECT conv_id * 1000000 + turn AS doc_id, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS label,
         conv_id AS prompt_group, 't' || CAST(turn % 2 AS VARCHAR) AS domain, 'conv' AS dataset_name
  FROM conversations WHERE role IN ('user', 'assistant'))"""

TURNS = """
turns AS (SELECT conv_id * 1000000 + turn AS doc_id, text FROM conversations)"""

EMB = """
emb AS (
  SELECT vec_id AS doc_id, embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label FROM embeddings)"""

GENERATED = """
gen AS (
  SELECT *, CASE WHEN label = 1 THEN 'g' || CAST(doc_id % 4 AS VARCHAR) ELSE 'human' END AS model,
         CASE WHEN label = 1 AND doc_id % 3 > 0 THEN 'a' || CAST(doc_id % 3 AS VARCHAR) ELSE 'none' END AS attack
  FROM docs)"""

CONFLICTS = """
conf AS (
  SELECT doc_id, text, label, toxic, domain, grp, n_chars, dataset_name FROM docs
  UNION ALL
  SELECT -doc_id - 1, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 1 - label, toxic, domain, grp, n_chars, dataset_name
  FROM docs WHERE doc_id % 7 = 0)"""


def marked(source: str) -> str:
    return f"""
marked AS (
  SELECT * REPLACE (CASE doc_id % 5 WHEN 0 THEN '# AI-generated ' || text WHEN 1 THEN '(ai generated) ' || text
                    WHEN 2 THEN text || ' // AI-GENERATED' ELSE text END AS text) FROM {source})"""


def squash(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE_CHARS}]+', ' ', 'g'))"


MARKER = (
    rf"(?i)\(?\bAI[- ]generated\b\)?|#[{SPACE_CHARS}]*AI[- ]generated|//[{SPACE_CHARS}]*AI[- ]generated"
)


def strip_markers(text: str) -> str:
    return squash(f"regexp_replace({text}, '{MARKER}', ' ', 'g')")


def dedup_key(text: str, alphabet: str = "ascii") -> str:
    letters = {"ascii": "a-z0-9_", "unicode": r"\p{L}\p{N}_"}[alphabet]
    drop = rf"""[^{letters}{{}}()\[\];:.,+\-*/=<>#''" ]+"""
    unmarked = f"regexp_replace(lower({text}), '{MARKER}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({unmarked}, '[{SPACE_CHARS}]+', ' ', 'g'), '{drop}', '', 'g'))"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
