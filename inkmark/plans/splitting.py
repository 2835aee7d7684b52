"""Registered queries: samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.operators import splits
from inkmark.plans import oracle as o
from inkmark.sources.bindings import conv_labeled, docs_labeled, with_generators

QUERIES = {}
ORACLES = {}

# Hold-out minima that the test tables reach; the operators default to 50 and 250.
MIN_DOMAIN = 20
MIN_GENERATOR = 20


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _hash(*keys, seed=42):
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || CAST({k} AS VARCHAR)" for k in keys) + ")"


def _docs(spark, sf_dir):
    return docs_labeled(spark, sf_dir).select("doc_id", "label", "domain", "grp")


def stratified_quota_sql(source, within="", share="(20 * sum(n) OVER (PARTITION BY {w}) + 99) // 100"):
    """CTEs q_<source>: quota per (within, label) by largest remainder."""
    w = f"{within}, " if within else ""
    part = within or "1"
    total = share.format(w=part)
    return f"""
c_{source} AS (SELECT {w}label, count(*) AS n FROM {source} GROUP BY {w}label),
t_{source} AS (SELECT *, CAST({total} AS BIGINT) AS total, CAST(sum(n) OVER (PARTITION BY {part}) AS BIGINT) AS total_n FROM c_{source}),
f_{source} AS (SELECT *, (n * total) // total_n AS fl, (n * total) % total_n AS rest FROM t_{source}),
q_{source} AS (SELECT {w}label, n, fl + CASE WHEN row_number() OVER (PARTITION BY {part} ORDER BY rest DESC, label)
                 <= total - sum(fl) OVER (PARTITION BY {part}) THEN 1 ELSE 0 END AS quota FROM f_{source})"""


@query(
    "sample_balanced",
    f"""{o.with_(o.DOCS)}, s AS (SELECT least(300, 200, count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS k FROM docs)
SELECT doc_id, label, domain, grp FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash('doc_id')}) AS rn FROM docs) WHERE rn <= (SELECT k FROM s)""",
)
def sample_balanced(spark, sf_dir):
    return splits.sample_balanced(_docs(spark, sf_dir), 300, 200)


@query(
    "sample_quota",
    f"""{o.with_(o.DOCS, o.GENERATED)},
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN label = 1 THEN 'ai:' || model ELSE 'human' END
        ORDER BY {_hash('doc_id')}) AS r1 FROM gen) WHERE label = 0 OR r1 <= 60),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY {_hash('doc_id')}) AS r2 FROM a) WHERE r2 <= 40),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash('doc_id')}) AS r3 FROM b)
      WHERE r3 <= CASE WHEN label = 1 THEN 100 ELSE 30 END)
SELECT doc_id, label, domain, model FROM c""",
)
def sample_quota(spark, sf_dir):
    docs = with_generators(_docs(spark, sf_dir)).select("doc_id", "label", "domain", "model")
    return splits.sample_nested_quota(docs, max_per_model=60, max_per_domain_label=40, max_human=30, max_ai=100)


_HOLES = """holed AS (SELECT doc_id, label, CASE WHEN doc_id % 7 > 0 THEN domain END AS domain,
  CASE WHEN doc_id % 5 > 0 THEN model END AS model, CASE WHEN doc_id % 6 > 0 THEN attack END AS attack FROM gen)"""


def _holed(spark, sf_dir):
    """The generated metadata with planted NULLs."""
    rows = with_generators(_docs(spark, sf_dir))
    holes = {"domain": 7, "model": 5, "attack": 6}
    return rows.select("doc_id", "label", *[F.when(F.col("doc_id") % n > 0, F.col(c)).alias(c) for c, n in holes.items()])


@query(
    "sample_quota_nulls",
    f"""{o.with_(o.DOCS, o.GENERATED, _HOLES)},
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN label = 1 THEN 'ai:' || coalesce(model, '') ELSE 'human' END
        ORDER BY {_hash('doc_id')}) AS r1 FROM holed) WHERE label = 0 OR r1 <= 60),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY {_hash('doc_id')}) AS r2 FROM a) WHERE r2 <= 40),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash('doc_id')}) AS r3 FROM b)
      WHERE r3 <= CASE WHEN label = 1 THEN 100 ELSE 30 END)
SELECT doc_id, label, domain, model FROM c""",
)
def sample_quota_nulls(spark, sf_dir):
    """Rows without generator or domain fill quotas of their own."""
    rows = _holed(spark, sf_dir).drop("attack")
    return splits.sample_nested_quota(rows, max_per_model=60, max_per_domain_label=40, max_human=30, max_ai=100)


@query(
    "sample_scan_quota",
    f"""WITH RECURSIVE {o.with_(o.DOCS, o.GENERATED, _HOLES).removeprefix('WITH ')},
ordered AS (SELECT *, row_number() OVER (ORDER BY {_hash('doc_id')}) AS i,
  CASE WHEN label = 1 THEN 'm' || coalesce(model, '') END AS m, 'd' || label || coalesce(domain, 'unknown') AS d, 'l' || label AS l FROM holed),
scan AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS taken, []::VARCHAR[] AS held
  UNION ALL SELECT o.i, CASE WHEN ok THEN doc_id END, CASE WHEN ok THEN held || [coalesce(m, '-'), d, l] ELSE held END
  FROM (SELECT o.i, o.doc_id, o.m, o.d, o.l, s.held,
    len(list_filter(held, lambda x: x = o.d)) < 20 AND len(list_filter(held, lambda x: x = o.l)) < CASE WHEN o.label = 1 THEN 45 ELSE 40 END
    AND (o.m IS NULL OR len(list_filter(held, lambda x: x = o.m)) < 25) AS ok FROM scan s JOIN ordered o ON o.i = s.i + 1) o)
SELECT doc_id, label, domain, model FROM ordered WHERE doc_id IN (SELECT taken FROM scan)""",
)
def sample_scan_quota(spark, sf_dir):
    """Coupled counters: only rows that every counter lets pass are counted."""
    rows = _holed(spark, sf_dir).drop("attack")
    return splits.sample_coupled_quota(rows, max_per_model=25, max_per_domain_label=20, max_human=40, max_ai=45)


@query(
    "sample_cap",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY {_hash('doc_id')}) AS rn FROM documents)
WHERE rn <= 700""",
)
def sample_cap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return splits.sample_cap(docs, 700)


SPLIT_STRATIFIED_SQL = f"""{o.with_(o.DOCS)}, {stratified_quota_sql('docs')},
r AS (SELECT doc_id, label, domain, row_number() OVER (PARTITION BY label ORDER BY {_hash('doc_id')}) AS rn FROM docs)
SELECT doc_id, r.label, domain, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q_docs ON r.label = q_docs.label"""


@query("split_stratified", SPLIT_STRATIFIED_SQL)
def split_stratified(spark, sf_dir):
    return splits.split_stratified(_docs(spark, sf_dir).select("doc_id", "label", "domain"))


@query(
    "split_three_way",
    f"""{o.with_(o.DOCS)}, {stratified_quota_sql('docs', share='(30 * sum(n) OVER (PARTITION BY {w}) + 99) // 100')},
held AS (SELECT label, unnest(range(quota)) AS i FROM q_docs), {stratified_quota_sql('held', share='(sum(n) OVER (PARTITION BY {w}) + 1) // 2')},
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash('doc_id')}) AS rn FROM docs)
SELECT doc_id, r.label, CASE WHEN rn <= q_held.quota THEN 'test' WHEN rn <= q_docs.quota THEN 'val' ELSE 'train' END AS split
FROM r JOIN q_docs ON r.label = q_docs.label JOIN q_held ON r.label = q_held.label""",
)
def split_three_way(spark, sf_dir):
    return splits.split_three_way(_docs(spark, sf_dir).select("doc_id", "label"))


def _group_sql(source, group):
    return f"""
g AS (SELECT g, row_number() OVER (ORDER BY {_hash('g')}) AS rn, count(*) OVER () AS k FROM (SELECT DISTINCT {group} AS g FROM {source})),
gl AS (SELECT g, rn, (20 * k + 99) // 100 AS t, (20 * k + 99) // 100 + (20 * (k - (20 * k + 99) // 100) + 99) // 100 AS h FROM g),
gs AS (SELECT g, CASE WHEN rn <= t THEN 'test' WHEN rn <= h THEN 'val' ELSE 'train' END AS side FROM gl)"""


@query(
    "split_grouped",
    f"""{o.with_(o.CONV)}, {_group_sql('conv', 'CAST(prompt_group AS VARCHAR)')}
SELECT doc_id, label, prompt_group, side AS split FROM conv JOIN gs ON gs.g = CAST(prompt_group AS VARCHAR)""",
)
def split_grouped(spark, sf_dir):
    conv = conv_labeled(spark, sf_dir).select("doc_id", "label", "prompt_group")
    return splits.split_grouped(conv, "prompt_group")


_SOURCED = "(SELECT *, coalesce(CASE WHEN doc_id % 4 > 0 THEN grp END, CASE WHEN doc_id % 8 = 4 THEN 'title ' || grp END, CAST(doc_id AS VARCHAR)) AS source_group FROM docs)"


@query(
    "split_source_grouped",
    f"""{o.with_(o.DOCS)}, sourced AS {_SOURCED}, {_group_sql('sourced', 'source_group')},
sided AS (SELECT doc_id, label, side FROM sourced JOIN gs ON gs.g = source_group),
rest AS (SELECT * FROM sided WHERE side <> 'test'), {stratified_quota_sql('rest')},
v AS (SELECT doc_id, rest.label, CASE WHEN row_number() OVER (PARTITION BY rest.label ORDER BY {_hash('doc_id')}) <= quota
      THEN 'val' ELSE 'train' END AS split FROM rest JOIN q_rest ON rest.label = q_rest.label)
SELECT doc_id, label, split FROM v UNION ALL SELECT doc_id, label, 'test' FROM sided WHERE side = 'test'""",
)
def split_source_grouped(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(
        "doc_id",
        "label",
        F.when(F.col("doc_id") % 4 > 0, F.col("grp")).alias("source_id"),
        F.when(F.col("doc_id") % 8 == 4, F.concat(F.lit("title "), "grp")).alias("title"),
    )
    return splits.split_source_grouped(docs, ["source_id", "title"]).select("doc_id", "label", "split")


def _holdout_sql(rows, columns="doc_id, label, domain"):
    """``rows``: CTE named ho with holdout, doc_id, label, is_test, is_train."""
    return f"""{rows},
ok AS (SELECT holdout FROM ho GROUP BY holdout HAVING count(DISTINCT label) FILTER (is_test) = 2
       AND count(DISTINCT label) FILTER (is_train) = 2),
tr AS (SELECT ho.* FROM ho JOIN ok ON ok.holdout = ho.holdout WHERE is_train), {stratified_quota_sql('tr', 'holdout')},
v AS (SELECT tr.*, CASE WHEN row_number() OVER (PARTITION BY tr.holdout, tr.label ORDER BY {_hash('doc_id')}) <= quota
      THEN 'val' ELSE 'train' END AS split FROM tr JOIN q_tr ON q_tr.holdout = tr.holdout AND q_tr.label = tr.label)
SELECT holdout, {columns}, split FROM v
UNION ALL SELECT ho.holdout, {columns}, 'test' FROM ho JOIN ok ON ok.holdout = ho.holdout WHERE is_test"""


@query(
    "split_domain_holdout",
    _holdout_sql(
        f"""{o.with_(o.DOCS)}, big AS (SELECT domain AS holdout FROM docs GROUP BY domain HAVING count(*) >= {MIN_DOMAIN}),
ho AS (SELECT holdout, doc_id, label, domain, domain = holdout AS is_test, domain <> holdout AS is_train FROM docs, big)"""
    ),
)
def split_domain_holdout(spark, sf_dir):
    return splits.split_domain_holdout(_docs(spark, sf_dir).select("doc_id", "label", "domain"), MIN_DOMAIN)


def _top_sql(column, top, extra=""):
    return f"""big AS (SELECT {column} AS holdout FROM gen WHERE label = 1 {extra} GROUP BY 1 HAVING count(*) >= {MIN_GENERATOR}
        ORDER BY count(*) DESC, {column} LIMIT {top})"""


_OWN_DOMAINS = "own AS (SELECT DISTINCT holdout, gen.domain FROM gen JOIN big ON gen.model = big.holdout)"
_GENERATOR_BASE = f"""{o.with_(o.DOCS, o.GENERATED)}, {_top_sql('model', 4)}, {_OWN_DOMAINS},
base AS (SELECT big.holdout, doc_id, label, gen.domain, model = big.holdout AS is_own,
                label = 0 AND own.domain IS NOT NULL AS is_human
         FROM gen CROSS JOIN big LEFT JOIN own ON own.holdout = big.holdout AND own.domain = gen.domain)"""
_ATTACK_BASE = f"""{o.with_(o.DOCS, o.GENERATED)}, {_top_sql('attack', 3, "AND attack <> 'none'")},
base AS (SELECT big.holdout, doc_id, label, gen.domain, attack = big.holdout AS is_own, label = 0 AS is_human FROM gen CROSS JOIN big)"""
_REFERENCE = "ho AS (SELECT *, is_own OR is_human AS is_test, NOT is_own AS is_train FROM base)"
_DISJOINT = f"""hr AS (SELECT holdout, doc_id, row_number() OVER (PARTITION BY holdout ORDER BY {_hash('doc_id', seed=43)}) AS rn,
        count(*) OVER (PARTITION BY holdout) AS k FROM base WHERE is_human AND NOT is_own),
ho AS (SELECT base.*, is_own OR coalesce(rn <= (20 * k + 99) // 100, false) AS is_test,
              NOT (is_own OR coalesce(rn <= (20 * k + 99) // 100, false)) AS is_train
       FROM base LEFT JOIN hr ON hr.holdout = base.holdout AND hr.doc_id = base.doc_id)"""


def _generated(spark, sf_dir):
    return with_generators(_docs(spark, sf_dir).select("doc_id", "label", "domain"))


@query("split_generator_holdout", _holdout_sql(f"{_GENERATOR_BASE}, {_REFERENCE}"))
def split_generator_holdout(spark, sf_dir):
    rows = splits.split_generator_holdout(_generated(spark, sf_dir).drop("attack"), MIN_GENERATOR, mode="reference")
    return rows.drop("model")


@query("split_generator_holdout_disjoint", _holdout_sql(f"{_GENERATOR_BASE}, {_DISJOINT}"))
def split_generator_holdout_disjoint(spark, sf_dir):
    return splits.split_generator_holdout(_generated(spark, sf_dir).drop("attack"), MIN_GENERATOR).drop("model")


@query("split_attack_holdout", _holdout_sql(f"{_ATTACK_BASE}, {_REFERENCE}"))
def split_attack_holdout(spark, sf_dir):
    rows = splits.split_attack_holdout(_generated(spark, sf_dir).drop("model"), MIN_GENERATOR, mode="reference")
    return rows.drop("attack")


@query("split_attack_holdout_disjoint", _holdout_sql(f"{_ATTACK_BASE}, {_DISJOINT}"))
def split_attack_holdout_disjoint(spark, sf_dir):
    return splits.split_attack_holdout(_generated(spark, sf_dir).drop("model"), MIN_GENERATOR).drop("attack")


@query(
    "split_domain_holdout_nulls",
    _holdout_sql(
        f"""{o.with_(o.DOCS, o.GENERATED, _HOLES)}, filled AS (SELECT * REPLACE (coalesce(domain, 'unknown') AS domain) FROM holed),
big AS (SELECT domain AS holdout FROM filled GROUP BY domain HAVING count(*) >= {MIN_DOMAIN}),
ho AS (SELECT holdout, doc_id, label, nullif(domain, 'unknown') AS domain, domain = holdout AS is_test, domain <> holdout AS is_train FROM filled, big)"""
    ),
)
def split_domain_holdout_nulls(spark, sf_dir):
    """Rows without a domain are the domain ``unknown``."""
    return splits.split_domain_holdout(_holed(spark, sf_dir).select("doc_id", "label", "domain"), MIN_DOMAIN)


@query(
    "split_attack_holdout_nulls",
    _holdout_sql(
        f"""{o.with_(o.DOCS, o.GENERATED, _HOLES)}, big AS (SELECT coalesce(attack, 'none') AS holdout FROM holed
        WHERE label = 1 AND coalesce(attack, 'none') <> 'none' GROUP BY 1 HAVING count(*) >= {MIN_GENERATOR} ORDER BY count(*) DESC, 1 LIMIT 3),
base AS (SELECT big.holdout, doc_id, label, domain, coalesce(attack, 'none') = big.holdout AS is_own, label = 0 AS is_human FROM holed CROSS JOIN big),
{_REFERENCE}"""
    ),
)
def split_attack_holdout_nulls(spark, sf_dir):
    """Rows without an attack name count as not attacked and stay in train."""
    rows = _holed(spark, sf_dir).drop("model")
    return splits.split_attack_holdout(rows, MIN_GENERATOR, mode="reference").drop("attack")


@query(
    "sanity_label_shuffle",
    f"""{o.with_(o.DOCS)}, r AS (SELECT doc_id, label, row_number() OVER (ORDER BY {_hash('doc_id', seed=43)}) AS rn FROM docs)
SELECT doc_id, label, CASE WHEN rn <= (SELECT sum(label) FROM docs) THEN 1 ELSE 0 END AS shuffled_label FROM r""",
)
def sanity_label_shuffle(spark, sf_dir):
    return splits.shuffle_labels(_docs(spark, sf_dir).select("doc_id", "label"))
