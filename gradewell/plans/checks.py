"""Validation, rubric and TF-IDF queries (OP-090 to 104, 140) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.functions import vector as V
from gradewell.operators import contracts as K
from gradewell.operators import rubric as R
from gradewell.operators.references import concept_errors
from gradewell.operators.tfidf import similarities, spread
from gradewell.plans.catalog import register
from gradewell.plans.scalars import HINT_SETS_SQL, hint_sets
from gradewell.session import table


def rubric_sets(spark: SparkSession, sf_dir: str, judged: int = 1) -> DataFrame:
    """Hint sets as the rubric reads them, in one aggregation: the first user turn is the statement, the first system turn the solution; how often a set is ``judged`` makes tasks smaller."""
    first = lambda role: F.coalesce(F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"], F.lit(""))
    hints = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], F.length("text") * judged)
    sets = turns.groupBy(F.col("conv_id").alias("set_id")).agg(hints.alias("hints"), first("user").alias("statement"), first("system").alias("solution"))
    return sets.withColumn("hints", F.transform("hints", lambda h: h["text"]))


@register(
    "op_092_domain_range",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22') THEN 'brand: ''' || p_brand || ''' is not one of [''Brand#11'', ''Brand#12'', ''Brand#21'', ''Brand#22'']' END, CASE WHEN p_size < 5 THEN 'size: ' || p_size || ' is less than the minimum of 5' WHEN p_size > 40 THEN 'size: ' || p_size || ' is greater than the maximum of 40' END, CASE WHEN length(p_name) < 8 THEN 'name: ''' || p_name || ''' is too short' WHEN length(p_name) > 9 THEN 'name: ''' || p_name || ''' is too long' END, CASE WHEN NOT regexp_matches(p_type, '^[A-Z]') THEN 'type: ''' || p_type || ''' does not match ''^[A-Z]''' END], lambda x: x IS NOT NULL), '; ') AS v FROM part",
)
def domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = K.violations(K.in_domain(F.col("p_brand"), ("Brand#11", "Brand#12", "Brand#21", "Brand#22"), "brand"), K.in_range(F.col("p_size"), 5, 40, "size"), K.has_length(F.col("p_name"), 8, 9, "name"), K.matches(F.col("p_type"), "^[A-Z]", "type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(checks, "; ").alias("v"))


_CONCEPTS_SQL = """dim AS (SELECT DISTINCT 'p' || p_partkey AS k FROM part WHERE p_size > 10),
each AS (SELECT l_orderkey, 'p' || l_partkey AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem WHERE l_orderkey % 7 <> 0),
lone AS (SELECT l_orderkey, 'p' || (arg_min(l_partkey, (l_linenumber, l_partkey)) + 1) AS p FROM lineitem GROUP BY l_orderkey)"""


def order_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, their parts as concepts; the primary one is the part after the first, and every seventh order has none."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("parts"))
    concepts = F.transform("parts", lambda x: F.concat(F.lit("p"), x.cast("string")))
    return rows.select("l_orderkey", F.when(F.col("l_orderkey") % 7 != 0, concepts).alias("concepts"), F.concat(F.lit("p"), (F.col("parts")[0] + 1).cast("string")).alias("primary"))


def concept_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("concept_id"))


@register(
    "op_095_referential_check",
    f"""WITH {_CONCEPTS_SQL}, bad AS (SELECT l_orderkey, string_agg('''' || x || '''', ', ' ORDER BY i) AS v FROM (SELECT l_orderkey, x, min(i) AS i FROM each WHERE x NOT IN (SELECT k FROM dim) GROUP BY ALL) GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN v IS NOT NULL THEN 'unknown concept ids: [' || v || ']' WHEN p NOT IN (SELECT k FROM dim) THEN 'unknown primary_concept: ' || p WHEN l_orderkey % 7 = 0 THEN 'missing concepts' END AS error FROM lone LEFT JOIN bad USING (l_orderkey)""",
)
def referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's concepts against the dimension table."""
    found = concept_errors(order_concepts(spark, sf_dir), ["l_orderkey"], F.col("concepts"), F.col("primary"), concept_dimension(spark, sf_dir), "concept_id")
    return found.select("l_orderkey", "error")


@register(
    "op_091_keys",
    "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN ': ''k'' is a required property' END, CASE WHEN event_id % 2 = 0 THEN ': Additional properties are not allowed (''z'' was unexpected)' END], lambda x: x IS NOT NULL), '; ') AS v FROM events",
)
def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and unknown keys of JSON documents made from the events' properties."""
    doc = F.when(F.col("event_id") % 6 == 0, '{"z": 1}').when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ', "z": 1}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(K.key_violations(doc, ("k",), ("k", "m")), "; ").alias("v"))


@register(
    "op_090_record_check",
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang: ''' || lang || ''' is not one of [''en'', ''fr'']' END, CASE WHEN n_chars < 100 THEN 'n_chars: ' || n_chars || ' is less than the minimum of 100' WHEN n_chars > 5000 THEN 'n_chars: ' || n_chars || ' is greater than the maximum of 5000' END, CASE WHEN NOT regexp_matches(source, '^[a-z]+[0-4]$') THEN 'source: ''' || source || ''' does not match ''^[a-z]+[0-4]$''' END, CASE WHEN quality < 1 THEN 'labels/quality: ' || quality || ' is less than the minimum of 1' END], lambda x: x IS NOT NULL), '; ') AS v FROM documents LEFT JOIN labels USING (doc_id)",
)
def record_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every record, path first; what isn't there breaks no rule."""
    checks = K.violations(K.in_domain(F.col("lang"), ("en", "fr"), "lang"), K.in_range(F.col("n_chars"), 100, 5000, "n_chars"), K.matches(F.col("source"), "^[a-z]+[0-4]$", "source"), K.in_range(F.col("quality"), 1, 1, "labels/quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.array_join(checks, "; ").alias("v"))


#: A valid segment record, one without a section's field, one of a wrong type, one with a wrong confidence and no JSON.
SEGMENTS = (
    '{"intent":{"text":"t","matches_problem":true,"confidence":"high"},"function":{"algorithm":"bfs","data_structures":["q"],"complexity":"n","confidence":"low"},"implementation":{"key_operations":["a"],"potential_issues":[],"confidence":"medium"}}',
    '{"intent":{"text":"t","matches_problem":true,"confidence":"high"},"function":{"algorithm":"bfs","data_structures":["q"],"confidence":"low"},"implementation":{"key_operations":["a"],"potential_issues":[],"confidence":"medium"}}',
    '{"intent":{"text":"t","matches_problem":"yes","confidence":"high"},"function":{"algorithm":"bfs","data_structures":["q"],"complexity":"n","confidence":"low"},"implementation":{"key_operations":["a"],"potential_issues":[],"confidence":"medium"}}',
    '{"intent":{"text":"t","matches_problem":true,"confidence":"sure"},"function":{"algorithm":"bfs","data_structures":["q"],"complexity":"n","confidence":"low"},"implementation":{"key_operations":["a"],"potential_issues":[],"confidence":"medium"}}',
)


@register(
    "op_093_segment_check",
    "SELECT event_id, ['', 'missing field: function.complexity', 'wrong type: intent.matches_problem (got str, expected bool)', 'invalid confidence in intent: ''sure'''][(event_id % 4)::INT + 1] AS v FROM events",
)
def segment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc")).select("event_id", F.array_join(K.segment_violations(F.col("doc")), "; ").alias("v"))


@register("op_096_count_bounds", HINT_SETS_SQL + "SELECT conv_id, CASE WHEN len(hints) < 1 THEN 'too_few_hints: ' || len(hints) || ' < 1' WHEN len(hints) > 4 THEN 'too_many_hints: ' || len(hints) || ' > 4' ELSE '' END AS v FROM hint_sets")
def count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hint_sets(spark, sf_dir).select("conv_id", F.array_join(R.count_violations(F.size("hints")), ";").alias("v"))


_WORD_CHAR = r"[\p{L}\p{N}_]"


def _duck_pattern(p: str) -> str:
    """The same for an engine whose word boundaries are ASCII: a boundary before a word is a start or another character, one after it an end."""
    p = p.replace("'", "''").replace(r"\w", _WORD_CHAR).replace(r"include\b", f"include([^{_WORD_CHAR[1:-1]}]|$)")
    return p.replace(r"\b", f"(^|[^{_WORD_CHAR[1:-1]}])")


_CODE_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{_duck_pattern(p)}') THEN 'code_token_match:' || '{p.replace(chr(39), chr(39) * 2)}' END" for p in R.CODE_SIGNS) + ", CASE WHEN length(text) - length(replace(text, ';', '')) > 3 THEN 'code_token_match:too_many_semicolons' END], lambda x: x IS NOT NULL)"


@register("op_097_code_signs", f"SELECT doc_id, array_to_string({_CODE_SQL}, ';') AS v FROM documents")
def code_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.code_violations(F.col("text")), ";").alias("v"))


_WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"
_SENTENCES = "greatest(1, len(regexp_extract_all(text, '[.!?]+')))"


@register(
    "op_098_length_bounds",
    f"SELECT doc_id, array_to_string(list_filter([CASE WHEN {_WORDS} > 60 THEN 'too_long_words:' || {_WORDS} || '>60' END, CASE WHEN {_SENTENCES} > 3 THEN 'too_long_sentences:' || {_SENTENCES} || '>3' END, CASE WHEN {_WORDS} < 4 THEN 'too_short_words:' || {_WORDS} END], lambda x: x IS NOT NULL), ';') AS v FROM documents",
)
def length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.length_violations(F.col("text")), ";").alias("v"))


@register(
    "op_100_order_check",
    "SELECT user_id, array_to_string(list('order_inversion_at_' || k || ': ' || printf('%.2f', s) || ' < ' || printf('%.2f', b) ORDER BY k), ';') AS v FROM (SELECT user_id, value / 100 AS s, lag(value / 100) OVER w AS b, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE s + 0.05 < b GROUP BY user_id",
)
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a user's scores fall, by position and value."""
    s, order = F.col("value") / 100, Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", s.alias("s"), F.lag(s).over(order).alias("b"), (F.row_number().over(order) - 1).alias("k"))
    says = F.concat(F.lit("order_inversion_at_"), F.col("k").cast("string"), F.lit(": "), R.shown(F.col("s")), F.lit(" < "), R.shown(F.col("b")))
    off = rows.where(F.col("s") + R.ORDER_TOLERANCE < F.col("b")).select("user_id", F.struct("k", says.alias("v")).alias("x"))
    return off.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), ";").alias("v"))


@register(
    "op_104_truncation_warnings",
    "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id > 4096 - 1024 THEN 'prompt=' || event_id || 'tok > num_ctx(4096) − num_predict(1024)=3072tok → prompt truncated by Ollama' END, CASE WHEN user_id * 10 >= 1024 THEN 'output=' || user_id * 10 || 'tok hit num_predict cap (1024) → JSON likely truncated' END], lambda x: x IS NOT NULL), '; ') AS v FROM events",
)
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(K.truncation_warnings(F.col("event_id"), F.col("user_id") * 10, F.lit(4096), F.lit(1024)), "; ").alias("v"))


@register(
    "op_13f_robust_json",
    "SELECT event_id, ['whole', 'fenced', 'braces', 'no JSON found in output', 'json parse failed'][(event_id % 5)::INT + 1] AS kind, CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events",
)
def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.col("props")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("so "), "props", F.lit(" ok"))).when(F.col("event_id") % 5 == 3, F.lit("none")).otherwise(F.lit('a {"k": } b'))
    found, error = K.robust_json(F.col("raw"))
    kind = F.when(F.col("e") != "", F.col("e")).when(F.col("event_id") % 5 == 0, "whole").when(F.col("event_id") % 5 == 1, "fenced").otherwise("braces")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", found.alias("j"), error.alias("e")).select("event_id", kind.alias("kind"), F.get_json_object("j", "$.k").alias("k"))


_SET_TEXTS_SQL = """
texts AS (SELECT conv_id AS grp, 'h' || turn AS doc, text FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, 'statement', statement FROM hint_sets UNION ALL
  SELECT h.conv_id, 'solution', coalesce(first(c.text ORDER BY c.turn, c.text), '') FROM hint_sets h LEFT JOIN conversations c ON c.conv_id = h.conv_id AND c.role = 'system' GROUP BY h.conv_id),"""
_SIMS_SQL = r"""
w AS (SELECT grp, doc, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM texts),
terms AS (SELECT grp, doc, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w),
tf AS (SELECT grp, doc, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT grp, term, count(*) AS df, row_number() OVER (PARTITION BY grp ORDER BY sum(tf) DESC, term) AS k FROM tf GROUP BY grp, term),
n AS (SELECT grp, count(*) AS n FROM texts GROUP BY grp),
x AS (SELECT tf.grp, tf.doc, tf.term, tf.tf * (ln((1 + n.n) / (1 + df.df)) + 1) AS x FROM tf JOIN df ON df.grp = tf.grp AND df.term = tf.term AND df.k <= 20000 JOIN n ON n.grp = tf.grp),
v AS (SELECT grp, doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY grp, doc)) AS v FROM x),
sims AS (SELECT a.grp, a.doc, b.doc AS anchor, sum(a.v * b.v) AS s FROM v a JOIN v b ON a.grp = b.grp AND a.term = b.term AND b.doc IN ('statement', 'solution') WHERE a.doc NOT IN ('statement', 'solution') GROUP BY ALL)
"""
TFIDF_SQL = _SET_TEXTS_SQL + _SIMS_SQL


@register(
    "op_140_tfidf_similarity",
    HINT_SETS_SQL.rstrip() + "," + TFIDF_SQL + "SELECT t.grp AS conv_id, t.doc, round(coalesce(a.s, 0), 6) + 0.0 AS sim_statement, round(coalesce(b.s, 0), 6) + 0.0 AS sim_solution FROM texts t LEFT JOIN sims a ON a.grp = t.grp AND a.doc = t.doc AND a.anchor = 'statement' LEFT JOIN sims b ON b.grp = t.grp AND b.doc = t.doc AND b.anchor = 'solution' WHERE t.doc NOT IN ('statement', 'solution')",
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf_sims(spark, sf_dir).select("conv_id", "doc", *[V.settled(F.col(c)).alias(c) for c in ("sim_statement", "sim_solution")])


def tfidf_sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("role") == "assistant", F.concat(F.lit("h"), "turn"))
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], F.length("text")).select(F.col("conv_id").alias("grp"), "role", "turn", "text", doc.alias("doc"))
    first = lambda role: F.coalesce(F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"], F.lit(""))
    hints = F.collect_list(F.when(F.col("role") == "assistant", F.struct("doc", "text")))
    anchors = [F.struct(F.lit(name).alias("doc"), first(role).alias("text")) for name, role in (("statement", "user"), ("solution", "system"))]
    texts = turns.groupBy("grp").agg(F.concat(hints, F.array(*anchors)).alias("t")).select("grp", F.inline("t"))
    found = similarities(texts, ["statement", "solution"]).where("doc NOT IN ('statement', 'solution')")
    return found.select(F.col("grp").alias("conv_id"), "doc", "sim_statement", "sim_solution")


@register(
    "op_099_similarity_caps",
    HINT_SETS_SQL.rstrip()
    + ","
    + TFIDF_SQL
    + """, placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations WHERE role = 'assistant')
    SELECT p.conv_id, 'hint' || i || '_too_close_to_' || anchor || ':' || printf('%.2f', s) || '>0.1' AS v FROM sims JOIN placed p ON p.conv_id = grp AND 'h' || turn = doc WHERE s > 0.10""",
)
def similarity_caps(spark: SparkSession, sf_dir: str, cap: float = 0.10) -> DataFrame:
    """Hints that are closer to the statement or the solution than the cap, by position and similarity."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = tfidf_sims(spark, sf_dir).withColumn("turn", F.substring("doc", 2, 10).cast("int")).withColumn("i", place)
    each = rows.select("conv_id", "i", F.inline(F.array(*[F.struct(F.lit(a).alias("anchor"), F.col(f"sim_{a}").alias("s")) for a in ("statement", "solution")])))
    return each.where(F.col("s") > cap).select("conv_id", F.concat(F.lit("hint"), F.col("i").cast("string"), F.lit("_too_close_to_"), "anchor", F.lit(":"), R.shown(F.col("s")), F.lit(f">{cap}")).alias("v"))


@register(
    "op_101_rubric_report",
    HINT_SETS_SQL.rstrip() + "," + TFIDF_SQL + """SELECT h.conv_id, len(h.hints)::BIGINT AS n_hints, round(coalesce(max(a.s), 0), 6) + 0.0 AS max_sim_to_statement, round(coalesce(max(b.s), 0), 6) + 0.0 AS max_sim_to_solution,
    round(coalesce(list_avg(list_transform(any_value(h.hints), lambda x: len(regexp_extract_all(x.text, '[\\p{L}\\p{N}_]+')))), 0), 6) + 0.0 AS avg_words
    FROM hint_sets h LEFT JOIN sims a ON a.grp = h.conv_id AND a.anchor = 'statement' LEFT JOIN sims b ON b.grp = h.conv_id AND b.anchor = 'solution' GROUP BY h.conv_id, h.hints""",
)
def rubric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.validate(rubric_sets(spark, sf_dir))
    return found.select(F.col("set_id").alias("conv_id"), "n_hints", V.settled(F.col("max_sim_to_statement")).alias("max_sim_to_statement"), V.settled(F.col("max_sim_to_solution")).alias("max_sim_to_solution"), V.settled(F.col("avg_words_per_hint")).alias("avg_words"))


_OWN_SQL = f"{_CODE_SQL} || list_filter([CASE WHEN {_WORDS} > 60 THEN 'too_long_words:' || {_WORDS} || '>60' END, CASE WHEN {_SENTENCES} > 3 THEN 'too_long_sentences:' || {_SENTENCES} || '>3' END, CASE WHEN {_WORDS} < 4 THEN 'too_short_words:' || {_WORDS} END], lambda x: x IS NOT NULL)"
_RETRY_SQL = (
    HINT_SETS_SQL.rstrip()
    + """, sol AS (SELECT conv_id, coalesce(first(text ORDER BY turn, text) FILTER (role = 'system'), '') AS solution FROM conversations GROUP BY conv_id),
pre AS (SELECT conv_id, k, conv_id || '/' || k AS grp, list_transform(hints, lambda h: h.text)[1:k] AS hs, statement, solution FROM (SELECT h.conv_id, hints, statement, solution, unnest(range(1, greatest(len(hints), 1) + 1)) AS k FROM hint_sets h JOIN sol USING (conv_id))),
hs AS (SELECT grp, i, hs[i] AS text FROM (SELECT grp, hs, unnest(range(1, len(hs) + 1)) AS i FROM pre)),
texts AS (SELECT grp, 'h' || i AS doc, text FROM hs UNION ALL SELECT grp, 'statement', statement FROM pre UNION ALL SELECT grp, 'solution', solution FROM pre),"""
    + _SIMS_SQL
    + f""", each AS (SELECT h.grp, h.i, {_OWN_SQL} AS own, coalesce(a.s, 0) AS st, coalesce(b.s, 0) AS so FROM hs h LEFT JOIN sims a ON a.grp = h.grp AND a.doc = 'h' || h.i AND a.anchor = 'statement' LEFT JOIN sims b ON b.grp = h.grp AND b.doc = 'h' || h.i AND b.anchor = 'solution'),
lagged AS (SELECT *, lag(so) OVER (PARTITION BY grp ORDER BY i) AS b FROM each),
sets AS (SELECT grp, flatten(list(own ORDER BY i)) AS own, count(*) FILTER (so + 0.05 < b) AS n_order, count(*) AS n,
  coalesce(list('hint' || (i - 1) || '_too_close_to_statement:' || printf('%.2f', st) || '>0.55' ORDER BY i) FILTER (st > 0.55), []) || coalesce(list('hint' || (i - 1) || '_too_close_to_solution:' || printf('%.2f', so) || '>0.55' ORDER BY i) FILTER (so > 0.55), [])
  || coalesce(list('order_inversion_at_' || (i - 1) || ': ' || printf('%.2f', so) || ' < ' || printf('%.2f', b) ORDER BY i) FILTER (so + 0.05 < b), []) AS whole FROM lagged GROUP BY grp),
checked AS (SELECT p.conv_id, p.k, coalesce(n, 0) AS n_hints, coalesce(n_order, 0) AS n_order, CASE WHEN coalesce(n, 0) < 1 THEN ['too_few_hints: 0 < 1'] WHEN n > 4 THEN ['too_many_hints: ' || n || ' > 4'] ELSE [] END || coalesce(whole, []) || coalesce(own, []) AS v FROM pre p LEFT JOIN sets s ON s.grp = p.grp),
final AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS r FROM checked WHERE NOT (len(v) > 0 AND len(v) = n_order AND k > 1))
SELECT conv_id, len(v) = 0 AS passed, n_hints, array_to_string(v, ';') AS violations FROM final WHERE r = 1"""
)


@register("op_102_trim_and_retry", _RETRY_SQL)
def trim_and_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.validate_with_retry(rubric_sets(spark, sf_dir, R.MAX_HINTS))
    return found.select(F.col("set_id").alias("conv_id"), "passed", "n_hints", F.array_join("violations", ";").alias("violations"))


@register(
    "op_103_metric_backfill",
    HINT_SETS_SQL + r"SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 0.0 ELSE round(coalesce(list_avg(list_transform(hints, lambda x: len(regexp_extract_all(x.text, '[\p{L}\p{N}_]+')))), 0), 6) + 0.0 END AS avg_words FROM hint_sets",
)
def metric_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have metrics keep them, the others are validated."""
    sets = rubric_sets(spark, sf_dir)
    had = sets.where("set_id % 2 = 0").select(F.col("set_id").alias("conv_id"), F.lit(0.0).alias("avg_words"))
    new = R.validate(sets.where("set_id % 2 <> 0")).select(F.col("set_id").alias("conv_id"), V.settled(F.col("avg_words_per_hint")).alias("avg_words"))
    return had.unionByName(new)
