"""Registered queries: columns, labels, text, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.functions import labels, text
from inkmark.operators import columns, dedup, reshape
from inkmark.operators.near_duplicates import earliest_partners, hyperplane_partners, minhash_partners, near_duplicate_report
from inkmark.plans import oracle as o
from inkmark.session import stored
from inkmark.sources.bindings import conv_labeled, docs_labeled, table, with_conflicts, with_generators, with_markers

QUERIES = {}
ORACLES = {}

# Label spellings that the queries deal out to the rows of the labelled tables.
SPELLINGS = (
    "0|1|0.0|1.0|human|HUMAN| ai |no|yes|not generated|not_generated|human-written|student|chatgpt|true|false|real|"
    "machine|llm|unknown|mostly human|synthetic|authentic"
).split("|")
STRICT_SPELLINGS = "0|1|human|HUMAN| ai |Student|chatgpt|synthetic|authentic|gpt|real|machine".split("|")


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def spelled_docs(spark, sf_dir, spellings=SPELLINGS, every_null=31):
    """doc_id with a raw label spelling; every ``every_null``-th id has none."""
    docs = table(spark, sf_dir, "documents")
    listed = F.array(*[F.lit(s) for s in spellings])
    raw = F.element_at(listed, (F.col("doc_id") % len(spellings)).cast("int") + 1)
    return docs.withColumn("raw_label", F.when(F.col("doc_id") % every_null != 0, raw))


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_in(values):
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def spelled_sql(spellings=SPELLINGS, every_null=31):
    return f"""
spelled AS (
  SELECT *, CASE WHEN doc_id % {every_null} <> 0 THEN {_sql_list(spellings)}[CAST(doc_id % {len(spellings)} AS INTEGER) + 1] END
           AS raw_label
  FROM documents)"""


def _key_sql(value):
    return rf"regexp_replace(lower(trim({value})), '^(\d+)\.0+$', '\1')"


def _encoder_sql(human, ai, otherwise, key=_key_sql("raw_label")):
    return f"CASE WHEN {key} IN {_sql_in(human)} THEN 0 WHEN {key} IN {_sql_in(ai)} THEN 1 ELSE {otherwise} END"


_KEY = f"coalesce({_key_sql('raw_label')}, '')"
PERMISSIVE_SQL = _encoder_sql(
    labels.PERMISSIVE_HUMAN, labels.PERMISSIVE_AI, f"CASE WHEN contains({_KEY}, 'human') THEN 0 ELSE 1 END", _KEY
)
PERMISSIVE_V0_SQL = _encoder_sql(
    labels.PERMISSIVE_V0_HUMAN, labels.PERMISSIVE_V0_AI, f"CASE WHEN contains({_KEY}, 'human') THEN 0 ELSE 1 END", _KEY
)
STRICT_SQL = _encoder_sql(labels.STRICT_HUMAN, labels.STRICT_AI, "NULL")


@query("label_permissive", f"{o.with_(spelled_sql())} SELECT doc_id, raw_label, {PERMISSIVE_SQL} AS label FROM spelled")
def label_permissive(spark, sf_dir):
    return spelled_docs(spark, sf_dir).select("doc_id", "raw_label", labels.permissive(F.col("raw_label")).alias("label"))


@query(
    "label_permissive_v0", f"{o.with_(spelled_sql())} SELECT doc_id, raw_label, {PERMISSIVE_V0_SQL} AS label FROM spelled"
)
def label_permissive_v0(spark, sf_dir):
    return spelled_docs(spark, sf_dir).select(
        "doc_id", "raw_label", labels.permissive_v0(F.col("raw_label")).alias("label")
    )


@query("label_strict", f"{o.with_(spelled_sql())} SELECT doc_id, raw_label, {STRICT_SQL} AS label FROM spelled")
def label_strict(spark, sf_dir):
    return spelled_docs(spark, sf_dir).select("doc_id", "raw_label", labels.strict(F.col("raw_label")).alias("label"))


@query(
    "label_legacy",
    f"{o.with_(o.CONV)} SELECT doc_id, CASE label WHEN 1 THEN ' AI ' ELSE 'Human' END AS raw_label, label FROM conv",
)
def label_legacy(spark, sf_dir):
    rows = conv_labeled(spark, sf_dir).withColumn("raw_label", F.when(F.col("label") == 1, " AI ").otherwise("Human"))
    return rows.select("doc_id", "raw_label", labels.legacy(F.col("raw_label")).alias("label"))


@query(
    "label_from_generator",
    f"""{o.with_(o.DOCS, o.GENERATED)}, raw AS (
  SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN upper(model) ELSE model END END AS model,
         CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN CASE label WHEN 1 THEN 'LLM' ELSE 'real' END END AS label_text,
         CASE WHEN doc_id % 3 = 0 THEN CASE label WHEN 1 THEN 'true' ELSE 'false' END END AS is_ai
  FROM gen)
SELECT doc_id, model, CASE WHEN model IS NOT NULL THEN CASE WHEN lower(model) = 'human' THEN 0 ELSE 1 END
       WHEN lower(coalesce(label_text, is_ai)) IN ('real', 'false') THEN 0 ELSE 1 END AS label FROM raw""",
)
def label_from_generator(spark, sf_dir):
    docs = with_generators(docs_labeled(spark, sf_dir))
    third, even = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    raw = docs.select(
        "doc_id",
        F.when(~third, F.when(even, F.upper("model")).otherwise(F.col("model"))).alias("model"),
        F.when(third & even, F.when(F.col("label") == 1, "LLM").otherwise("real")).alias("label"),
        F.when(third, F.when(F.col("label") == 1, "true").otherwise("false")).alias("is_ai"),
    )
    return raw.select("doc_id", "model", labels.from_generator(raw.columns).alias("label"))


@query(
    "label_challenge",
    f"{o.with_(spelled_sql())} SELECT doc_id, CASE WHEN lower(trim(raw_label)) = 'ai' THEN 1 ELSE 0 END AS label "
    "FROM spelled",
)
def label_challenge(spark, sf_dir):
    return spelled_docs(spark, sf_dir).select("doc_id", labels.challenge(F.col("raw_label")).alias("label"))


# --- columns -----------------------------------------------------------------------------


def _feeds(spark, sf_dir):
    """The same tables under the column names of different feeds."""
    docs = docs_labeled(spark, sf_dir)
    return {
        "general": (docs.select("doc_id", "text", "label"), "general"),
        "generator": (docs.select(F.col("text").alias("generation"), F.col("label").alias("model"), "domain"), "general"),
        "strict": (docs.select(F.col("text").alias("Answer"), F.col("label").alias("Is_Generated")), "strict"),
        "legacy": (docs.select("text", F.col("text").alias("content"), F.col("label").alias("class")), "legacy"),
        "unnamed": (docs.select("grp", F.col("text").alias("body"), "domain", "label"), "general"),
    }


@query(
    "detect_text_column",
    f"""{o.with_(o.DOCS)}, lengths AS (
  SELECT unnest(['grp', 'body', 'domain']) AS c, unnest([avg(length(grp)), avg(length(text)), avg(length(domain))]) AS m
  FROM docs)
SELECT * FROM (VALUES ('general', 'text', 'label'), ('generator', 'generation', 'model'),
                      ('strict', 'Answer', 'Is_Generated'), ('legacy', 'content', 'class')) v(feed, text_column, label_column)
UNION ALL SELECT 'unnamed', (SELECT arg_max(c, m) FROM lengths), 'label'""",
)
def detect_text_column(spark, sf_dir):
    """Resolved columns per feed; the unnamed feed is decided by the mean lengths of its columns."""
    rows = []
    for feed, (df, family) in _feeds(spark, sf_dir).items():
        if family == "general" and feed == "unnamed":
            continue
        rows.append((feed, columns.detect_text_column(df, family), columns.detect_label_column(df, family)))
    known = spark.createDataFrame(rows, "feed string, text_column string, label_column string")
    unnamed, family = _feeds(spark, sf_dir)["unnamed"]
    longest = columns.mean_text_lengths(unnamed).agg(F.max_by("column_name", "mean_length").alias("text_column"))
    return known.unionByName(
        longest.select(
            F.lit("unnamed").alias("feed"), "text_column", F.lit(columns.detect_label_column(unnamed)).alias("label_column")
        )
    )


@query(
    "domain_fill",
    f"{o.with_(o.DOCS)} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE domain END AS domain FROM docs",
)
def domain_fill(spark, sf_dir):
    docs = docs_labeled(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("domain")).alias("category")
    )
    return columns.fill_domain(docs).select("doc_id", "domain")


@query(
    "project_clean",
    f"""{o.with_(spelled_sql())} SELECT {o.squash('text')} AS text, {PERMISSIVE_SQL} AS label, 'docs' AS dataset_name, lang, source
FROM spelled WHERE raw_label IS NOT NULL AND text IS NOT NULL AND length({o.squash('text')}) > 0""",
)
def project_clean(spark, sf_dir):
    docs = spelled_docs(spark, sf_dir)
    return columns.clean_labelled(docs, "docs", label_col="raw_label", metadata=("lang", "source", "lang", "absent", "text"))


_GAPPY = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ' ' || chr(9) || chr(160) ELSE text END"


def _gappy(df):
    """Plant NULL and blank texts by id."""
    return df.withColumn("text", F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ' \\t\\u00A0' ELSE text END"))


@query(
    "filter_nonempty",
    f"""{o.with_(spelled_sql())}, gappy AS (SELECT * REPLACE ({_GAPPY} AS text) FROM spelled)
SELECT doc_id, {o.squash('text')} AS text FROM gappy
WHERE text IS NOT NULL AND raw_label IS NOT NULL AND length({o.squash('text')}) > 0""",
)
def filter_nonempty(spark, sf_dir):
    docs = columns.require_text_and_label(_gappy(spelled_docs(spark, sf_dir)), label="raw_label")
    return docs.select("doc_id", text.squash_spaces(F.col("text")).alias("text")).filter(F.length("text") > 0)


@query(
    "filter_english",
    "SELECT doc_id, lang FROM documents WHERE lower(lang) IN ('en', 'eng', 'english')",
)
def filter_english(spark, sf_dir):
    return columns.keep_english(table(spark, sf_dir, "documents").select("doc_id", "lang"))


@query(
    "filter_min_words",
    f"SELECT doc_id FROM documents WHERE length({o.squash('text')}) > 0 "
    f"AND len(string_split({o.squash('text')}, ' ')) >= 30",
)
def filter_min_words(spark, sf_dir):
    return columns.keep_min_words(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


_QUARANTINE = o.with_(
    spelled_sql(STRICT_SPELLINGS, 10**9),
    f""" feed AS (SELECT doc_id, source, CASE WHEN doc_id % 97 = 5 THEN NULL ELSE {STRICT_SQL} END AS label
             FROM spelled)""",
)


@query(
    "filter_file_quarantine",
    f"{_QUARANTINE} SELECT doc_id, source, label FROM feed WHERE source NOT IN (SELECT source FROM feed WHERE label IS NULL)",
)
def filter_file_quarantine(spark, sf_dir):
    docs = spelled_docs(spark, sf_dir, STRICT_SPELLINGS, 10**9)
    raw = F.when(F.col("doc_id") % 97 == 5, "no idea").otherwise(F.col("raw_label"))
    feed = docs.select("doc_id", "source", labels.strict(raw).alias("label"))
    return columns.quarantine_sources(feed, "source", need_one=False)[0].select("doc_id", "source", "label")


@query(
    "filter_file_quarantine_rejected",
    f"""{_QUARANTINE} SELECT source, count(*) FILTER (label IS NULL) AS unknown_labels, count(*) AS n_rows FROM feed
GROUP BY source HAVING count(*) FILTER (label IS NULL) > 0""",
)
def filter_file_quarantine_rejected(spark, sf_dir):
    docs = spelled_docs(spark, sf_dir, STRICT_SPELLINGS, 10**9)
    raw = F.when(F.col("doc_id") % 97 == 5, "no idea").otherwise(F.col("raw_label"))
    feed = docs.select("source", labels.strict(raw).alias("label"))
    return columns.quarantine_sources(feed, "source", need_one=False)[1]


@query("leakage_guard", f"{o.with_(o.DOCS, o.GENERATED)} SELECT doc_id, text FROM gen")
def leakage_guard(spark, sf_dir):
    return columns.feature_input(with_generators(docs_labeled(spark, sf_dir)))


# --- text ---------------------------------------------------------------------------------

# Uncommon white space planted into the texts, and Latin letters read as Arabic ones. Fixed values.
_ODD_SPACES = "replace(replace(text, '. ', '. ' || chr(160) || chr(9)), ' th', chr(8232) || chr(28) || ' th')"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_ARABIC = "ابتثجحخدذرزسشصضىعغفقكأإآيـ"
_MARKED_ARABIC = (
    f"replace(replace(translate(lower(text), '{_LATIN}', '{_ARABIC}'), 'ل', 'ل' || chr(1614)), 'ت', chr(1617) || 'ت')"
)


@query("text_whitespace", f"SELECT doc_id, {o.squash(_ODD_SPACES)} AS text FROM documents")
def text_whitespace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    odd = F.replace("text", F.lit(". "), F.lit(".  \t"))
    odd = F.replace(odd, F.lit(" th"), F.lit(" \x1c th"))
    return docs.select("doc_id", text.squash_spaces(odd).alias("text"))


def _arabic_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    script = F.translate(F.lower("text"), _LATIN, _ARABIC)
    script = F.replace(F.replace(script, F.lit("ل"), F.lit("لَ")), F.lit("ت"), F.lit("ّت"))
    return docs.select("doc_id", script.alias("text"))


def _arabic_sql(value):
    return o.squash(
        rf"translate(regexp_replace({value}, '[\x{{0617}}-\x{{061A}}\x{{064B}}-\x{{0652}}\x{{0640}}]', '', 'g'), 'إأآى', 'اااي')"
    )


@query("text_arabic_norm", f"SELECT doc_id, {_arabic_sql(_MARKED_ARABIC)} AS text FROM documents")
def text_arabic_norm(spark, sf_dir):
    """The documents, transliterated to vocalised Arabic script, then normalised."""
    return _arabic_docs(spark, sf_dir).select("doc_id", text.normalize_arabic(F.col("text")).alias("text"))


@query(
    "text_strip_marker",
    f"{o.with_(o.marked('documents'))} SELECT doc_id, {o.strip_markers('text')} AS text FROM marked",
)
def text_strip_marker(spark, sf_dir):
    docs = with_markers(table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text"))
    return docs.select("doc_id", text.strip_markers(F.col("text")).alias("text"))


@query(
    "text_dedup_key",
    f"{o.with_(o.marked('documents'))} SELECT doc_id, {o.dedup_key('text')} AS ascii_key, "
    f"{o.dedup_key('text', 'unicode')} AS unicode_key FROM marked",
)
def text_dedup_key(spark, sf_dir):
    docs = with_markers(table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text"))
    return docs.select(
        "doc_id",
        text.dedup_key(F.col("text")).alias("ascii_key"),
        text.dedup_key(F.col("text"), "unicode").alias("unicode_key"),
    )


_CONTACT_SQL = r"(?:https?://|www\.)[^ \t\r\n]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(
    "text_strip_contacts",
    f"SELECT doc_id, {o.squash(f'''regexp_replace(text, '{_CONTACT_SQL}', ' ', 'g')''')} AS text FROM documents",
)
def text_strip_contacts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return docs.select("doc_id", text.strip_contacts(F.col("text")).alias("text"))


# --- reshape ------------------------------------------------------------------------------

_WIDE = """
wide AS (
  SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS original_post,
         arg_min(text, turn) FILTER (role = 'assistant') AS assistant_generated_post,
         arg_max(text, turn) FILTER (role = 'assistant') AS last_generated_abstract,
         count(*) AS turns
  FROM conversations GROUP BY conv_id)"""


def _wide(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("original_post"),
        F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant_generated_post"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_generated_abstract"),
        F.count(F.lit(1)).alias("turns"),
    )


@query(
    "unpivot_wide",
    f"""{o.with_(_WIDE)}, long AS (
  SELECT conv_id, 0 AS ord, 'original_post' AS source_column, 0 AS label, 'human' AS generator, 'social_media' AS domain, original_post AS t FROM wide
  UNION ALL SELECT conv_id, 1, 'assistant_generated_post', 1, 'assistant', 'social_media', assistant_generated_post FROM wide
  UNION ALL SELECT conv_id, 2, 'last_generated_abstract', 1, 'last', 'academic_abstract', last_generated_abstract FROM wide),
clean AS (SELECT * EXCLUDE (t), {_arabic_sql('t')} AS text FROM long WHERE t IS NOT NULL)
SELECT conv_id, text, label, 'wide' AS dataset_name, domain, generator, source_column FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord, conv_id) AS rn FROM clean WHERE length(text) > 0) WHERE rn = 1""",
)
def unpivot_wide(spark, sf_dir):
    return reshape.wide_to_long(_wide(spark, sf_dir), ["conv_id"], "feed.parquet", "wide")


# --- dedup --------------------------------------------------------------------------------


def _first_sql(source, key, order, columns_):
    return (
        f"SELECT {columns_} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) "
        "WHERE rn = 1"
    )


@query(
    "dedup_exact",
    f"WITH t AS (SELECT doc_id, {o.squash('text')} AS text, source FROM documents) "
    + _first_sql("t", "text", "doc_id", "doc_id, text, source"),
)
def dedup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text", "source")
    return dedup.dedup_text(docs.withColumn("text", text.squash_spaces(F.col("text"))), ["doc_id"])


@query(
    "dedup_two_level",
    f"""WITH t AS (SELECT doc_id, {o.squash('text')} AS text, source FROM documents),
per_file AS ({_first_sql('t', 'source, text', 'doc_id', 'doc_id, text, source')})
"""
    + _first_sql("per_file", "text", "source, doc_id", "doc_id, text, source"),
)
def dedup_two_level(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text", "source")
    return dedup.dedup_two_level(docs.withColumn("text", text.squash_spaces(F.col("text"))), "source", "doc_id")


@query(
    "dedup_after_norm",
    f"""WITH t AS (SELECT doc_id, {o.squash(_MARKED_ARABIC)} AS text FROM documents),
one AS ({_first_sql('t', 'text', 'doc_id', 'doc_id, text')}),
two AS (SELECT doc_id, {_arabic_sql('text')} AS text FROM one)
"""
    + _first_sql("two", "text", "doc_id", "doc_id, text")
    + " AND length(text) > 0",
)
def dedup_after_norm(spark, sf_dir):
    return dedup.clean_arabic(_arabic_docs(spark, sf_dir), ["doc_id"])


@query(
    "dedup_conflicts",
    f"""{o.with_(o.DOCS, o.CONFLICTS)}, k AS (SELECT doc_id, label, domain, {o.dedup_key('text', 'unicode')} AS key FROM conf)
SELECT doc_id, label, domain FROM k WHERE key NOT IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT label) > 1)""",
)
def dedup_conflicts(spark, sf_dir):
    docs = with_conflicts(docs_labeled(spark, sf_dir, heavy=True))
    keyed = docs.withColumn("key", text.dedup_key(F.col("text"), "unicode")).select("doc_id", "label", "domain", "key")
    return dedup.drop_conflicts(keyed, F.col("key")).select("doc_id", "label", "domain")


_STRICT = (
    o.with_(
        o.DOCS,
        o.CONFLICTS,
        o.marked("conf"),
        f""" raw AS (SELECT * REPLACE ({_GAPPY} AS text) FROM marked),
work AS (SELECT doc_id, {o.strip_markers('text')} AS content, label AS label_binary, domain FROM raw WHERE text IS NOT NULL),
norm AS (SELECT *, {o.dedup_key('content')} AS content_norm FROM work WHERE length(content) > 0),
pure AS (SELECT * FROM norm WHERE content_norm NOT IN (
  SELECT content_norm FROM norm GROUP BY content_norm HAVING count(DISTINCT label_binary) > 1)),
clean AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY content_norm ORDER BY doc_id) AS rn FROM pure)
          WHERE rn = 1)""",
    )
)


def _strict_input(spark, sf_dir):
    docs = docs_labeled(spark, sf_dir, heavy=True).select("doc_id", "text", "label", "domain", "toxic", "grp", "n_chars", "dataset_name")
    return _gappy(with_markers(with_conflicts(docs)))


@query("clean_strict", f"{_STRICT} SELECT doc_id, content, label_binary, domain, content_norm FROM clean")
def clean_strict(spark, sf_dir):
    return dedup.clean_strict(_strict_input(spark, sf_dir), "doc_id")


@query(
    "audit_cleaning",
    f"""{_STRICT} SELECT
  (SELECT count(*) FROM raw) AS raw_rows,
  (SELECT count(*) FROM raw WHERE text IS NOT NULL) AS rows_after_required_not_null,
  (SELECT count(*) FROM raw WHERE contains(lower(text), 'ai-generated')) AS ai_marker_rows_before_cleaning,
  (SELECT count(*) FROM (SELECT content_norm FROM norm GROUP BY 1 HAVING count(DISTINCT label_binary) > 1))
    AS conflicting_normalized_texts,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM pure GROUP BY content_norm HAVING count(*) > 1))
    AS duplicate_normalized_rows_before_drop,
  (SELECT count(*) FROM clean) AS clean_rows,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS removed_rows_total,
  (SELECT '0=' || count(*) FILTER (label_binary = 0) || '; 1=' || count(*) FILTER (label_binary = 1) FROM clean)
    AS label_distribution_clean,
  (SELECT string_agg(domain || '=' || n, '; ' ORDER BY domain) FROM (SELECT domain, count(*) AS n FROM clean GROUP BY domain))
    AS domain_distribution_clean""",
)
def audit_cleaning(spark, sf_dir):
    return dedup.cleaning_audit(_strict_input(spark, sf_dir), "doc_id")


def distinct_docs(spark, sf_dir):
    """Documents without exact copies, with the label where one is known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = dedup.dedup_text(docs.withColumn("text", text.squash_spaces(F.col("text"))), ["doc_id"])
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return first.join(known, "doc_id", "left")


_WB45 = rf"""
distinct_docs AS (SELECT doc_id, text FROM (
  SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, {o.squash('text')} AS text FROM documents)) WHERE rn = 1),
padded AS (SELECT doc_id, ' ' || {o.squash('lower(text)')} || ' ' AS t FROM distinct_docs),
grams AS (
  SELECT doc_id, unnest(flatten([regexp_extract_all(t[k:], '(?s).{{4}}') FOR k IN range(1, 5)])) AS g FROM padded
  UNION ALL SELECT doc_id, unnest(flatten([regexp_extract_all(t[k:], '(?s).{{5}}') FOR k IN range(1, 6)])) FROM padded
  UNION ALL SELECT doc_id, ' ' || w || ' ' FROM (SELECT doc_id, unnest(string_split(trim(t), ' ')) AS w FROM padded) WHERE length(w) = 1),
inner_grams AS (SELECT doc_id, g FROM grams WHERE NOT contains(g[2:-2], ' ')),
tf AS (SELECT doc_id, g, count(*) AS tf FROM inner_grams GROUP BY doc_id, g),
df AS (SELECT g, count(*) AS df FROM tf GROUP BY g),
w AS (SELECT tf.doc_id, tf.g, tf * (ln((1.0 + (SELECT count(*) FROM distinct_docs)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df ON tf.g = df.g),
unit AS (SELECT doc_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS s FROM unit a JOIN unit b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING sum(a.w * b.w) >= 0.9 - 1e-9),
best AS (SELECT b, min(a) AS a, arg_min(s, a) AS s FROM pairs GROUP BY b)"""


@query(
    "near_dup_cosine",
    f"""{o.with_(_WB45)}
SELECT best.a AS left_id, best.b AS right_id, round(best.s, 6) AS similarity, CAST(ll.quality AS INTEGER) AS left_label,
       CAST(rl.quality AS INTEGER) AS right_label, ld.text[1:180] AS left_preview, rd.text[1:180] AS right_preview
FROM best JOIN distinct_docs ld ON ld.doc_id = best.a JOIN distinct_docs rd ON rd.doc_id = best.b
LEFT JOIN labels ll ON ll.doc_id = best.a LEFT JOIN labels rl ON rl.doc_id = best.b""",
)
def near_dup_cosine(spark, sf_dir):
    docs = stored(distinct_docs(spark, sf_dir), "near-dup-docs")
    return near_duplicate_report(docs, earliest_partners(docs))


@query("near_dup_hyperplane", ORACLES["near_dup_cosine"])
def near_dup_hyperplane(spark, sf_dir):
    """The approximate audit; a pair at the threshold is missed with a chance of one in a thousand."""
    docs = stored(distinct_docs(spark, sf_dir), "near-dup-docs")
    return near_duplicate_report(docs, hyperplane_partners(docs))


@query("near_dup_minhash")
def near_dup_minhash(spark, sf_dir):
    docs = stored(distinct_docs(spark, sf_dir), "near-dup-docs")
    return near_duplicate_report(docs, minhash_partners(docs))
