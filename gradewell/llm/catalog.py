"""Queries of the operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import divergence, embeddings, exact_dedup, fingerprints, html_text, language, lm_scores, minhash, mixing, packing, quality, search, secrets
from gradewell.llm.shared import Scratch
from gradewell.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
least AS (SELECT x AS vec_id, min(y) AS c FROM reach GROUP BY x),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.score_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")])


OP8_SQL = r"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
places AS (SELECT doc_id, len(ws) AS n, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts)),
corpus AS (SELECT count(*) AS n_all FROM places),
one AS (SELECT w, count(*) AS c FROM places GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM places WHERE v IS NOT NULL GROUP BY v, w),
own1 AS (SELECT doc_id, w, count(*) AS c FROM places GROUP BY doc_id, w),
own2 AS (SELECT doc_id, v, w, count(*) AS c FROM places WHERE v IS NOT NULL GROUP BY doc_id, v, w),
joined AS (
  SELECT p.doc_id, p.n, p.v, n_all - p.n AS rest, one.c - own1.c AS cw, before.c - own_before.c AS cv, two.c - own2.c AS cvw
  FROM places p CROSS JOIN corpus JOIN one ON one.w = p.w JOIN own1 ON own1.doc_id = p.doc_id AND own1.w = p.w
  LEFT JOIN one before ON before.w = p.v LEFT JOIN own1 own_before ON own_before.doc_id = p.doc_id AND own_before.w = p.v
  LEFT JOIN two ON two.v = p.v AND two.w = p.w LEFT JOIN own2 ON own2.doc_id = p.doc_id AND own2.v = p.v AND own2.w = p.w),
alone AS (SELECT *, CASE WHEN cw > 0 THEN ln(cw) - ln(greatest(rest, 1)) ELSE -ln(rest + 1) END AS own FROM joined),
sums AS (SELECT doc_id, max(n) AS n, sum(CASE WHEN v IS NULL THEN own WHEN cvw > 0 THEN ln(cvw) - ln(greatest(cv, 1)) ELSE ln(0.4) + own END) AS s FROM alone GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score, round(coalesce(s / n, 0), 6) AS mean_log_score
FROM documents LEFT JOIN sums USING (doc_id)
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (total - c)),
reach AS (SELECT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
least AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN least USING (doc_id)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the ledger of ``gradewell.secret.ledger`` where the session names one, else with a new one."""
    ledger = spark.conf.get("gradewell.secret.ledger", None) or Scratch(spark, "secret-ledger").root
    return secrets.scan(table(spark, sf_dir, "documents"), ledger)


OP6_SQL = r"""
WITH rules(k, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+()', 0, 20),
  (2, 'hex', '[0-9a-f]+()', 0, 24)),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
  SELECT doc_id, k, kind, least, string_split_regex(t, pat) AS gaps, regexp_extract_all(t, pat, 0) AS found,
         CASE WHEN grp = 2 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE regexp_extract_all(t, pat, 0) END AS kept
  FROM texts CROSS JOIN rules),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits),
spans AS (
  SELECT doc_id, k, kind, length(found[i]) AS n,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
  FROM each WHERE length(kept[i]) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS s FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 2)) // (s + 2 * v) AS p FROM c JOIN totals x ON x.lang = c.lang AND x.source = c.source JOIN sizes ON sizes.lang = c.lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 2)) // (any_value(x.s) + 2 * any_value(v)) AS q
      FROM c JOIN (SELECT lang, sum(s) AS s FROM totals GROUP BY lang) x ON x.lang = c.lang JOIN sizes ON sizes.lang = c.lang GROUP BY c.lang, c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
own AS (SELECT doc_id, r, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
corpus AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS words FROM own),
places AS (SELECT r, unnest(ts) AS term FROM own),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM places SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN corpus GROUP BY term),
m AS (SELECT r, doc_id, (10 + (90 * n::HUGEINT * docs) // words)::BIGINT AS m FROM own CROSS JOIN corpus),
scores AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_packing": op2_packing,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_language_id": op5_language_id,
        "op6_secret_scan": op6_secret_scan,
        "op7_source_mixing": op7_source_mixing,
        "op8_lm_scores": op8_lm_scores,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_html_text": op10_html_text,
        "op11_edit_fingerprints": op11_edit_fingerprints,
        "op12_source_divergence": op12_source_divergence,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op3_minhash_near_dedup": OP3_SQL, "op6_secret_scan": OP6_SQL, "op8_lm_scores": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_ranked_search": OP13_SQL}
