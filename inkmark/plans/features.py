"""Registered queries: stylometry, TF-IDF, scaling, feature assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.functions import ngrams, stylometry
from inkmark.operators import lexical, reshape
from inkmark.plans import oracle as o
from inkmark.plans.splitting import SPLIT_STRATIFIED_SQL
from inkmark.operators.splits import split_stratified
from inkmark.session import stored
from inkmark.sources.bindings import all_turns, docs_labeled, emb_labeled, table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# --- stylometry ---------------------------------------------------------------------------

_WORDS = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+')"
_NL = "' || chr(10) || '"
_DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}"
    r"\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"
)
_UPPER = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]"


def _class_count(pattern, t="text"):
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def _char_count(chars, t="text"):
    return f"(length({t}) - length(translate({t}, '{chars.replace(chr(39), chr(39) * 2)}', '')))"


def _div(a, b):
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END)"


def v2_sql(source, keep="doc_id"):
    """CTE ``v2`` with the fifteen current features, unrounded."""
    stops = ", ".join(f"'{w}'" for w in stylometry.EN_FUNCTION_WORDS + stylometry.AR_FUNCTION_WORDS)
    sentences = f"regexp_extract_all(text, '[^.!؟?{_NL}]+[.!؟?{_NL}]*')"
    e = {
        "word_count": "n",
        "char_count": "length(text)",
        "sentence_count": "ns",
        "avg_word_length": _div("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "n"),
        "avg_sentence_length": _div("nw", "ns"),
        "punctuation_count": _char_count(".,;:!?؟،"),
        "comma_count": _char_count(",،"),
        "period_count": _char_count("."),
        "question_count": _char_count("?؟"),
        "exclamation_count": _char_count("!"),
        "uppercase_ratio": _div(_class_count(_UPPER), _class_count(r"\p{L}")),
        "digit_ratio": _div(_class_count(_DIGIT), "length(text)"),
        "lexical_diversity": _div("len(list_distinct(lw))", "n"),
        "repetition_ratio": _div("n - len(list_distinct(lw))", "n"),
        "stopword_ratio": _div(f"len(list_filter(lw, lambda x: x IN ({stops})))", "n"),
    }
    columns = ",\n  ".join(f"CAST({x} AS DOUBLE) AS {name}" for name, x in e.items())
    return f"""
tok AS (SELECT *, {_WORDS.format(t='text')} AS w, {_WORDS.format(t='lower(text)')} AS lw,
        list_filter({sentences}, lambda s: regexp_matches(s, '[^{o.SPACE_CHARS}]')) AS sent FROM {source}),
tok2 AS (SELECT *, len(w) AS n, len(sent) AS ns,
         coalesce(list_sum(list_transform(sent, lambda s: len({_WORDS.format(t='s')}))), 0) AS nw FROM tok),
v2 AS (SELECT {keep}, {columns} FROM tok2)"""


def v1_sql(source, keep="doc_id"):
    """CTE ``v1`` with the twenty-eight earlier features, unrounded."""
    word = "[A-Za-z_][A-Za-z0-9_'']*"
    sentences = f"regexp_extract_all(text, '[^.!?{_NL}]+[.!?{_NL}]*')"
    lines = r"regexp_split_to_array(text, '\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]')"
    std = "coalesce(list_stddev_pop({}), 0.0)"
    e = {
        "char_count": "length(text)",
        "word_count": "n",
        "sentence_count": "len(sl)",
        "line_count": "len(ll)",
        "avg_word_length": _div("coalesce(list_sum(wl), 0)", "n"),
        "std_word_length": std.format("wl"),
        "avg_sentence_length": _div("coalesce(list_sum(sl), 0)", "len(sl)"),
        "std_sentence_length": std.format("sl"),
        "lexical_diversity": _div("len(list_distinct(lw))", "n"),
        "hapax_ratio": _div("len(list_filter(map_values(list_histogram(lw)), lambda c: c = 1))", "n"),
        "word_entropy": "CASE WHEN n = 0 THEN 0.0 ELSE -list_sum(list_transform(map_values(list_histogram(lw)), "
        "lambda c: (c / n) * log2(c / n))) END",
        "punctuation_ratio": _div(_char_count(".,;:!?"), "length(text)"),
        "comma_ratio": _div(_char_count(","), "length(text)"),
        "period_ratio": _div(_char_count("."), "length(text)"),
        "question_ratio": _div(_char_count("?"), "length(text)"),
        "exclamation_ratio": _div(_char_count("!"), "length(text)"),
        "digit_ratio": _div(_class_count(_DIGIT), "length(text)"),
        "uppercase_ratio": _div(_class_count(_UPPER), _class_count(r"\p{L}")),
        "whitespace_ratio": _div(_class_count(f"[{o.SPACE_CHARS}]"), "length(text)"),
        "quote_count": _char_count("\"'"),
        "semicolon_count": _char_count(";"),
        "brace_count": _char_count("{}[]()"),
        "operator_count": _char_count("=+-*/<>"),
        "repeated_word_ratio": _div("n - len(list_distinct(lw))", "n"),
        "repeated_bigram_ratio": _div("len(bi) - len(list_distinct(bi))", "len(bi)"),
        "repeated_trigram_ratio": _div("len(tri) - len(list_distinct(tri))", "len(tri)"),
        "avg_line_length": _div("list_sum(ll)", "len(ll)"),
        "max_line_length": "list_max(ll)",
    }
    columns = ",\n  ".join(f"CAST({x} AS DOUBLE) AS {name}" for name, x in e.items())
    return f"""
tok AS (SELECT *, regexp_extract_all(text, '{word}') AS w,
        list_transform(list_filter({sentences}, lambda s: regexp_matches(s, '[^{o.SPACE_CHARS}]')),
                       lambda s: len(regexp_extract_all(s, '{word}'))) AS sl,
        list_transform({lines}, lambda x: length(x)) AS ll0 FROM {source}),
tok2 AS (SELECT *, len(w) AS n, list_transform(w, lambda x: lower(x)) AS lw, list_transform(w, lambda x: length(x)) AS wl,
         CASE WHEN len(ll0) > 1 AND ll0[-1] = 0 THEN ll0[1:-2] ELSE ll0 END AS ll FROM tok),
tok3 AS (SELECT *, list_transform(list_zip(lw[1:greatest(n - 1, 0)], lw[2:]), lambda z: z[1] || ' ' || z[2]) AS bi,
         list_transform(list_zip(lw[1:greatest(n - 2, 0)], lw[2:greatest(n - 1, 0)], lw[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3]) AS tri
         FROM tok2),
v1 AS (SELECT {keep}, {columns} FROM tok3)"""


def _rounded(names, source, keep="doc_id"):
    return f"SELECT {keep}, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f" FROM {source}"


@query("stylo_v2", f"WITH {v2_sql('documents')} {_rounded(stylometry.V2_FEATURES, 'v2')}")
def stylo_v2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return stylometry.round_features(stylometry.add_v2_features(docs, keep=["doc_id"]), stylometry.V2_FEATURES)


@query("stylo_v1", f"WITH {v1_sql('documents')} {_rounded(stylometry.V1_FEATURES, 'v1')}")
def stylo_v1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return stylometry.round_features(stylometry.add_v1_features(docs, keep=["doc_id"]), stylometry.V1_FEATURES)


@query(
    "stylo_long",
    f"""{o.with_(o.TURNS)}, {v2_sql('turns')}
SELECT doc_id, feature, round(value, 6) AS value FROM (UNPIVOT v2 ON {', '.join(stylometry.V2_FEATURES)} INTO NAME feature VALUE value)""",
)
def stylo_long(spark, sf_dir):
    features = stylometry.add_v2_features(all_turns(spark, sf_dir, heavy=True), keep=["doc_id"])
    long = reshape.features_long(features, ["doc_id"], stylometry.V2_FEATURES)
    return long.withColumn("value", F.round("value", 6))


# --- TF-IDF -------------------------------------------------------------------------------


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


def terms_sql(source, spec, name, text="text"):
    """CTE ``<name>_terms`` (doc_id, term), one row per occurrence."""
    lowered = f"lower(coalesce({text}, ''))"
    if spec.analyzer == "word":
        tokens = rf"regexp_extract_all({lowered}, '[\p{{L}}\p{{N}}_]{{2,}}')"
        if spec.stop_words:
            tokens = f"list_filter({tokens}, lambda x: x NOT IN ({_list(ngrams.STOP_WORDS)}))"
        return f"""
{name}_tok AS (SELECT doc_id, {tokens} AS w FROM {source}),
{name}_terms AS (
  SELECT doc_id, unnest(w) AS term FROM {name}_tok
  UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w[1:greatest(len(w) - 1, 0)], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM {name}_tok)"""
    if spec.analyzer == "char":
        prepared, keep = f"regexp_replace({lowered}, '[{o.SPACE_CHARS}]{{2,}}', ' ', 'g')", ""
    else:
        prepared, keep = f"' ' || {o.squash(lowered)} || ' '", "WHERE NOT contains(term[2:-2], ' ')"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, unnest(flatten([regexp_extract_all(t[k:], '(?s).{{{n}}}') FOR k IN range(1, {n + 1})])) AS term FROM {name}_prep"
        for n in range(spec.min_n, spec.max_n + 1)
    )
    return f"""
{name}_prep AS (SELECT doc_id, {prepared} AS t FROM {source}),
{name}_terms AS (SELECT doc_id, term FROM ({parts}) {keep})"""


def vocabulary_sql(train, spec, name, text="text"):
    """CTE ``<name>_vocab`` (term, df, cf, idf) fitted on ``train``."""
    limit = f"ORDER BY cf DESC, term LIMIT {spec.max_features}" if spec.max_features else ""
    return f"""{terms_sql(train, spec, name, text)},
{name}_vocab AS (
  SELECT term, df, cf, ln((1.0 + (SELECT count(*) FROM {train})) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM {name}_terms GROUP BY term)
  WHERE df >= {spec.min_df} AND df <= CAST({spec.max_df} AS DOUBLE) * (SELECT count(*) FROM {train}) {limit})"""


def weights_sql(spec, name, terms=None):
    """CTE ``<name>_w`` (doc_id, term, tf, w)."""
    weight = "(ln(tf) + 1.0) * idf" if spec.sublinear else "tf * idf"
    return f"""
{name}_raw AS (SELECT doc_id, t.term, tf, {weight} AS w FROM (
  SELECT doc_id, term, count(*) AS tf FROM {terms or name + '_terms'} GROUP BY doc_id, term) t JOIN {name}_vocab v ON v.term = t.term),
{name}_w AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {name}_raw)"""


def _tfidf(docs, spec):
    vocabulary = lexical.fit_vocabulary(docs, [spec])
    weights = lexical.weigh(docs, vocabulary, [spec])
    return weights.select("doc_id", "term", "tf", F.round("w", 6).alias("w"))


def _tfidf_sql(source_cte, source, spec):
    head = f"WITH {source_cte}," if source_cte else "WITH"
    return f"""{head} {vocabulary_sql(source, spec, 'x')}, {weights_sql(spec, 'x')}
SELECT doc_id, term, tf, round(w, 6) AS w FROM x_w"""


@query("tfidf_word", _tfidf_sql("", "documents", ngrams.WORD_STOP))
def tfidf_word(spark, sf_dir):
    return _tfidf(table(spark, sf_dir, "documents"), ngrams.WORD_STOP)


@query("tfidf_char", _tfidf_sql(o.TURNS, "turns", ngrams.CHAR))
def tfidf_char(spark, sf_dir):
    return _tfidf(all_turns(spark, sf_dir), ngrams.CHAR)


@query("tfidf_char_wb", _tfidf_sql(o.TURNS, "turns", ngrams.CHAR_WB))
def tfidf_char_wb(spark, sf_dir):
    return _tfidf(all_turns(spark, sf_dir), ngrams.CHAR_WB)


@query("tfidf_word_maxdf", _tfidf_sql("", "documents", ngrams.WORD_MAXDF))
def tfidf_word_maxdf(spark, sf_dir):
    return _tfidf(table(spark, sf_dir, "documents"), ngrams.WORD_MAXDF)


_TRAIN = f"sp AS ({SPLIT_STRATIFIED_SQL}), train AS (SELECT d.* FROM documents d JOIN sp ON sp.doc_id = d.doc_id WHERE sp.split = 'train')"


@query(
    "tfidf_vocab",
    f"""WITH {_TRAIN}, {vocabulary_sql('train', ngrams.CHAR, 'x')}
SELECT term, df, cf, round(idf, 6) AS idf, row_number() OVER (ORDER BY term) - 1 AS term_id FROM x_vocab""",
)
def tfidf_vocab(spark, sf_dir):
    """Vocabulary of the labelled documents, fitted on the training side only."""
    train = split_stratified(docs_labeled(spark, sf_dir)).filter(F.col("split") == "train")
    vocabulary = lexical.fit_vocabulary(train, [ngrams.CHAR])
    return vocabulary.select("term", "df", "cf", F.round("idf", 6).alias("idf"), F.col("term_id").cast("bigint"))


@query(
    "stylo_scaled",
    f"""WITH sp AS ({SPLIT_STRATIFIED_SQL}), src AS (SELECT d.doc_id, d.text, sp.split FROM documents d JOIN sp ON sp.doc_id = d.doc_id),
{v2_sql('src', 'doc_id, split')}
SELECT doc_id, split, """
    + ", ".join(
        f"round(CASE WHEN (SELECT stddev_pop({c}) FROM v2 WHERE split = 'train') < 1e-12 THEN 0.0 ELSE "
        f"({c} - (SELECT avg({c}) FROM v2 WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM v2 WHERE split = 'train') END, 6) AS {c}"
        for c in stylometry.V2_FEATURES
    )
    + " FROM v2",
)
def stylo_scaled(spark, sf_dir):
    docs = split_stratified(docs_labeled(spark, sf_dir, heavy=True))
    features = stylometry.add_v2_features(docs, keep=["doc_id", "split"])
    stats = lexical.scaler(features.filter(F.col("split") == "train"), stylometry.V2_FEATURES)
    scaled = lexical.scale(features, stats, stylometry.V2_FEATURES)
    return stylometry.round_features(scaled, stylometry.V2_FEATURES)


@query(
    "features_hybrid",
    f"""WITH {o.TURNS}, {vocabulary_sql('turns', ngrams.WORD_STOP, 'a')}, {weights_sql(ngrams.WORD_STOP, 'a')},
{vocabulary_sql('turns', ngrams.CHAR, 'b')}, {weights_sql(ngrams.CHAR, 'b')}, {v2_sql('turns')},
long AS (UNPIVOT v2 ON {', '.join(stylometry.V2_FEATURES)} INTO NAME feature VALUE value),
st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY feature),
ids AS (SELECT block, term, row_number() OVER (ORDER BY block, term) - 1 AS feature_id FROM (
  SELECT 0 AS block, term FROM a_vocab UNION ALL SELECT 1, term FROM b_vocab))
SELECT doc_id, feature_id, round(w, 6) AS w FROM (
  SELECT doc_id, 0 AS block, term, w FROM a_w UNION ALL SELECT doc_id, 1, term, w FROM b_w) x
JOIN ids ON ids.block = x.block AND ids.term = x.term
UNION ALL
SELECT doc_id, (SELECT count(*) FROM ids) + list_position([{_list(stylometry.V2_FEATURES)}], long.feature) - 1,
       round(CASE WHEN s < 1e-12 THEN 0.0 ELSE (value - m) / s END, 6) FROM long JOIN st ON st.feature = long.feature""",
)
def features_hybrid(spark, sf_dir):
    """Word block, character block and scaled stylometry under one numbering, in long form."""
    conv = all_turns(spark, sf_dir)
    specs = [ngrams.WORD_STOP, ngrams.CHAR]
    vocabulary = lexical.fit_vocabulary(conv, specs)
    lexical_part = lexical.weigh(conv, vocabulary, specs).select(
        "doc_id", F.col("term_id").cast("bigint").alias("feature_id"), F.round("w", 6).alias("w")
    )
    # stored, because the scaler and the rows it scales both read it
    features = stored(stylometry.add_v2_features(all_turns(spark, sf_dir, heavy=True), keep=["doc_id"]), "style")
    names = stylometry.V2_FEATURES
    long = reshape.features_long(lexical.scale(features, lexical.scaler(features, names), names), ["doc_id"], names)
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    style_part = long.select(
        "doc_id", (F.lit(vocabulary.count()) + position).alias("feature_id"), F.round("value", 6).alias("w")
    )
    return lexical_part.unionByName(style_part)


# --- embeddings, weights ------------------------------------------------------------------


@query(
    "embedding_scaled",
    """WITH cells AS (SELECT vec_id AS doc_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY pos)
SELECT doc_id, CAST(cells.pos AS INTEGER) AS pos, round(CASE WHEN s < 1e-12 THEN 0.0 ELSE (x - m) / s END, 5) AS value
FROM cells JOIN st ON st.pos = cells.pos""",
)
def embedding_scaled(spark, sf_dir):
    emb = emb_labeled(spark, sf_dir)
    scaled = lexical.scale_embeddings(emb, lexical.embedding_stats(emb), ["doc_id"])
    return scaled.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select(
        "doc_id", "pos", F.round("x", 5).alias("value")
    )


@query(
    "embedding_mean_pool",
    """WITH cells AS (SELECT label AS grp, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings WHERE vec_id % 5 <> 0)
SELECT grp, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM cells GROUP BY grp, pos""",
)
def embedding_mean_pool(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "grp")
    pooled = lexical.masked_mean_pool(emb, "grp", F.col("vec_id") % 5 != 0)
    return pooled.withColumn("value", F.round("value", 6))


@query(
    "class_weights",
    f"""{o.with_(o.DOCS)} SELECT label, count(*) AS n, round(CAST((SELECT count(*) FROM docs) AS DOUBLE) / (2.0 * count(*)), 6) AS weight
FROM docs GROUP BY label""",
)
def class_weights(spark, sf_dir):
    return lexical.class_weights(docs_labeled(spark, sf_dir))
