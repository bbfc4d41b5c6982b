"""Scalar and filter queries (OP-030 to 059, 120 to 12Q, 130 to 13J) on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import classify as C
from gradewell.functions import text as T
from gradewell.functions import vector as V
from gradewell.operators.annotate import hint_rows
from gradewell.plans.catalog import register
from gradewell.session import table

#: Issue texts for event rows, by event_id modulo their number; also in ISSUES_SQL.
ISSUES = ("compile error", "Runtime fault", "time limit exceeded", "memory limit hit", "WA 38 vs 29", "tle", "segmentation fault", "checker: MLE", "presentation", "timeout")
ISSUES_SQL = "['" + "', '".join(ISSUES) + "'][(event_id % 10)::INT + 1]"


def graded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded rows: pts is value, issues one text that the id picks."""
    issue = F.element_at(F.array(*map(F.lit, ISSUES)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumns({"pts": F.col("value"), "issues": F.array(issue)})


def _scalar(name: str, source: str, key: str, column: Callable[[], Column], sql: str, where: str | None = None) -> None:
    """A query that computes one expression ``v`` for every row of a table; columns need a session, so it is made when the query runs."""
    oracle = f"SELECT {key}, {sql} AS v FROM {source}" + (f" WHERE {where}" if where else "")

    @register(name, oracle)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = graded_events(spark, sf_dir) if source == "events" else table(spark, sf_dir, source)
        return (rows.where(where) if where else rows).select(key, column().alias("v"))


@register("op_030_key_range_filter", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_brand, 'Brand#1') AND contains(p_type, 'E')")
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1") & F.col("p_type").contains("E")).select("p_partkey", "p_name")


@register(
    "op_031_composite_key",
    """SELECT event_id, key, string_split(key, '_')[1] AS year, string_split(key, '_')[2] AS tema,
              array_to_string(string_split(key, '_')[3:], '_') AS pid
       FROM (SELECT event_id, strftime(ts, '%Y') || '_' || event_type || '_u_' || user_id AS key FROM events)""",
)
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("_", F.date_format("ts", "yyyy"), "event_type", F.lit("u"), F.col("user_id").cast("string"))
    parts = F.split("key", "_", 3)
    return table(spark, sf_dir, "events").select("event_id", key.alias("key")).select("event_id", "key", parts[0].alias("year"), parts[1].alias("tema"), parts[2].alias("pid"))


def _prop() -> Column:
    return F.get_json_object("props", "$.k")


_scalar("op_032_lenient_float", "events", "event_id", lambda: C.float_or(F.when(F.col("event_id") % 3 == 0, F.concat(_prop(), F.lit("x"))).otherwise(_prop())), "coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') || 'x' ELSE json_extract_string(props, '$.k') END AS DOUBLE), 0.0)")
_scalar("op_033_default_value", "documents", "doc_id", lambda: C.text_or(F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.lit(None)).otherwise(F.col("lang")), "unknown"), "coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE lang END, ''), 'unknown')")
_scalar("op_041_score_bucket", "events", "event_id", lambda: C.score_bucket(F.col("value"), 50.0), "CASE WHEN value >= 50 THEN 'passing' ELSE 'failing' END")
_scalar("op_042_size_class", "documents", "doc_id", lambda: C.size_class(F.octet_length("text")), "CASE WHEN strlen(text) <= 200 THEN 'tiny' WHEN strlen(text) <= 5000 THEN 'small' WHEN strlen(text) <= 200000 THEN 'medium' WHEN strlen(text) <= 5000000 THEN 'large' ELSE 'stress' END")
_scalar("op_043_discriminator", "orders", "o_orderkey", lambda: C.discriminates(F.col("o_totalprice")), "CASE WHEN o_totalprice > 200000 THEN 'complexity' ELSE 'correctness' END")
_scalar("op_044_edge_case_name", "part", "p_partkey", lambda: C.edge_case_name(F.col("p_type")), "regexp_matches(lower(p_type), 'edge|corner|stress|small|big')")

_S = f"lower({ISSUES_SQL})"
_scalar("op_045_verdict", "events", "event_id", lambda: C.verdict(F.col("pts"), F.col("issues")), f"CASE WHEN value >= 99.999 THEN 'OK' WHEN regexp_matches({_S}, 'compile|compilation|ce') THEN 'CE' WHEN regexp_matches({_S}, 'runtime|segmentation') THEN 'RE' WHEN regexp_matches({_S}, 'tle|time limit') THEN 'TLE' WHEN regexp_matches({_S}, 'mle|memory limit') THEN 'MLE' WHEN contains({_S}, 'wa') OR value < 100 THEN 'WA' ELSE 'OTHER' END")
_W = "(^|[^a-z0-9_])({})([^a-z0-9_]|$)"
_scalar("op_045_verdict_strict", "events", "event_id", lambda: C.verdict_strict(F.col("pts"), F.col("issues")), f"CASE WHEN value >= 99.999 THEN 'OK' WHEN regexp_matches({_S}, '{_W.format('compile|compilation|ce')}') THEN 'CE' WHEN regexp_matches({_S}, '{_W.format('runtime|segmentation')}') THEN 'RE' WHEN regexp_matches({_S}, '{_W.format('tle|time limit')}') THEN 'TLE' WHEN regexp_matches({_S}, '{_W.format('mle|memory limit')}') THEN 'MLE' WHEN regexp_matches({_S}, '{_W.format('wa')}') OR value < 100 THEN 'WA' ELSE 'OTHER' END")
_REPORT = f"CASE WHEN value = 100 THEN 'OK' WHEN regexp_matches({_S}, 'compile|compilation|ce') AND NOT contains({_S}, 'wa') THEN 'CE' WHEN regexp_matches({_S}, 'runtime|segmentation|re ') THEN 'RE' WHEN regexp_matches({_S}, 'tle|time limit|timeout') THEN 'TLE' WHEN regexp_matches({_S}, 'mle|memory limit') THEN 'MLE' WHEN contains({_S}, 'wa') OR value < 100 THEN 'WA' ELSE 'OTHER' END"
_scalar("op_046_verdict_report", "events", "event_id", lambda: C.verdict_report(F.col("pts"), F.col("issues")), _REPORT)


@register("op_034_membership_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(kept, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("op_035_list_parameter", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src7', 'src13')")
def list_parameter(spark: SparkSession, sf_dir: str, names: str = "src1, src7,src13") -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source").isin(*[n.strip() for n in names.split(",")])).select("doc_id", "source")


def hint_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as hint sets: assistant turns are the hints, in turn order, and the first user turn the statement."""
    turns = table(spark, sf_dir, "conversations")
    level = F.element_at(F.array(*map(F.lit, ("macro", "structural", "specific", "very_specific"))), (F.col("turn") % 4 + 1).cast("int"))
    hint = F.when(F.col("role") == "assistant", F.struct("turn", level.alias("level"), "text"))
    statement = F.when(F.col("role") == "user", F.struct("turn", "text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(hint)).alias("hints"), F.min(statement).alias("statement"), F.count("*").alias("n_turns"))
    return grouped.select("conv_id", "hints", F.coalesce("statement.text", F.lit("")).alias("statement"), "n_turns", (F.col("conv_id") % 5 != 0).alias("passed"))


HINT_SETS_SQL = """WITH hint_sets AS (
  SELECT conv_id, coalesce(list({'turn': turn, 'level': ['macro', 'structural', 'specific', 'very_specific'][(turn % 4)::INT + 1], 'text': text} ORDER BY turn, text) FILTER (role = 'assistant'), []) AS hints,
         coalesce(first(text ORDER BY turn, text) FILTER (role = 'user'), '') AS statement, count(*) AS n_turns, conv_id % 5 <> 0 AS passed
  FROM conversations GROUP BY conv_id)
"""


@register("op_036_validity_filter", HINT_SETS_SQL + "SELECT conv_id, len(hints)::BIGINT AS n_hints FROM hint_sets WHERE passed AND len(hints) > 0")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = hint_sets(spark, sf_dir)
    return sets.where(F.coalesce("passed", F.lit(False)) & (F.size("hints") > 0)).select("conv_id", F.size("hints").cast("long").alias("n_hints"))


@register("op_037_drop_columns", "SELECT doc_id, lang FROM documents")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("text", "source", "n_chars")


@register(
    "op_038_fixed_layout",
    HINT_SETS_SQL
    + """SELECT 'conv' || conv_id AS problem_id, '' AS anon_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'set' || conv_id || '.cpp' END AS submission_name, CASE WHEN conv_id % 4 = 0 THEN 'java' ELSE 'unknown' END AS language, CASE WHEN conv_id % 6 = 0 THEN 'TLE' ELSE 'WA' END AS verdict, CASE WHEN conv_id % 2 = 0 THEN 'slow' ELSE '' END AS issues, '' AS concepts_targeted,
    array_to_string(list_transform(hints, lambda h: h.level || ':' || h.text), '|') AS hints, 'segments_silver_diff' AS source, CASE WHEN conv_id % 5 <> 0 THEN conv_id / 1000 END AS embedding_similarity, '' AS passing_file, passed AS validator_passed, CASE WHEN passed THEN '' ELSE 'too_short_words:2' END AS validator_violations FROM hint_sets WHERE len(hints) > 0""",
)
def fixed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of any source in the thirteen columns of hint rows; those without hints are dropped."""
    sets, when = hint_sets(spark, sf_dir), lambda k, value: F.when(F.col("conv_id") % k == 0, F.lit(value))
    rows = sets.select(
        F.concat(F.lit("conv"), "conv_id").alias("problem_id"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("set"), "conv_id", F.lit(".cpp"))).alias("submission_name"),
        when(4, "java").alias("language"), when(6, "TLE").alias("verdict"), when(2, ["slow"]).alias("issues"),
        F.transform("hints", lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"))).alias("generated_hints"),
        F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") / 1000).alias("embedding_similarity"),
        F.when(~F.col("passed"), F.array(F.lit("too_short_words:2"))).alias("hint_validation_errors"),
    )
    shown = hint_rows(rows).withColumn("hints", F.transform("hints", lambda h: F.concat_ws(":", h["level"], h["text"])))
    return shown.withColumns({c: F.array_join(c, "|") for c in ("issues", "concepts_targeted", "hints", "validator_violations")})


@register("op_039_force_valid", HINT_SETS_SQL + "SELECT conv_id, true AS passed, NOT passed AS overridden, 0::BIGINT AS n_violations FROM hint_sets")
def force_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are set valid and their violations cleared; an audit column says which were not."""
    sets = hint_sets(spark, sf_dir).withColumn("violations", F.when(~F.col("passed"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    forced = sets.withColumns({"overridden": ~F.col("passed"), "passed": F.lit(True), "violations": F.array().cast("array<string>")}).drop("hints", "statement")
    return forced.select("conv_id", "passed", "overridden", F.size("violations").cast("long").alias("n_violations"))


@register(
    "op_040_cap_hints",
    HINT_SETS_SQL + r"SELECT conv_id, array_to_string(list_transform(hints[1:4], lambda h: CASE WHEN length(h.text) > 60 THEN regexp_replace(left(h.text, 57), '\s+$', '') || '...' ELSE h.text END), '|') AS v FROM hint_sets",
)
def cap_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hint_sets(spark, sf_dir).select("conv_id", F.array_join(F.transform(F.slice("hints", 1, 4), lambda h: T.cap_text(h["text"], 60)), "|").alias("v"))


@register(
    "op_047_dominance",
    "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'mixed' END AS v FROM documents GROUP BY source",
)
def language_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(C.dominance(F.array_sort(F.collect_set("lang"))).alias("v"))


_scalar("op_048_similarity_bucket", "events", "event_id", lambda: C.similarity_bucket(F.col("value") / 100), "CASE WHEN value / 100 >= 0.97 THEN 'high' WHEN value / 100 >= 0.85 THEN 'medium' ELSE 'low' END")
_scalar("op_049_hint_level", "events", "event_id", lambda: C.hint_level(F.element_at(F.array(*map(F.lit, ("intent", "function", "implementation"))), (F.col("event_id") % 3 + 1).cast("int")), F.col("value") / 100), "CASE WHEN event_id % 3 = 0 THEN 'macro' WHEN event_id % 3 = 1 THEN 'structural' WHEN value / 100 >= 0.97 THEN 'very_specific' WHEN value / 100 >= 0.85 THEN 'specific' ELSE 'structural' END")
_scalar("op_050_closeness", "events", "event_id", lambda: C.closeness(F.when(F.col("event_id") % 7 != 0, F.col("value") / 100)), "CASE WHEN event_id % 7 <> 0 AND value / 100 >= 0.98 THEN 'almost identical' WHEN event_id % 7 <> 0 AND value / 100 >= 0.90 THEN 'similar' ELSE 'different' END")


@register(
    "op_051_completeness",
    """SELECT user_id, array_to_string(list_filter([CASE WHEN max((event_type = 'click')::INT) = 0 THEN 'click' END, CASE WHEN max((event_type = 'purchase')::INT) = 0 THEN 'purchase' END, CASE WHEN max((event_type = 'error')::INT) = 1 THEN 'error' END], lambda x: x IS NOT NULL), ',') AS missing FROM events GROUP BY user_id""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    def has(kind: str) -> Column:
        return F.bool_or(F.col("event_type") == kind)

    missing = F.array_compact(F.array(F.when(~has("click"), "click"), F.when(~has("purchase"), "purchase"), F.when(has("error"), "error")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(missing, ",").alias("missing"))


def _name() -> Column:
    return F.concat(F.lit("sub_"), F.date_format("ts", "yyyy.MM.dd__HH.mm.ss"), F.when(F.col("event_id") % 5 == 0, "").otherwise(".zip"))


_scalar("op_052_name_time", "events", "event_id", lambda: C.submitted_at(F.when(F.col("event_id") % 4 == 0, F.lit("upload.zip")).otherwise(_name())).cast("timestamp_ntz"), "CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) END")


def _file() -> Column:
    return F.concat(F.lit("anon_"), F.col("user_id"), F.lit("_"), F.col("event_id") % 101, F.when(F.col("event_id") % 6 == 0, ".txt").when(F.col("event_id") % 6 < 3, ".cpp").otherwise(".java"))


_FILE_SQL = "'anon_' || user_id || '_' || (event_id % 101) || CASE WHEN event_id % 6 = 0 THEN '.txt' WHEN event_id % 6 < 3 THEN '.cpp' ELSE '.java' END"


@register("op_053_solution_file", f"SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN 'anon_' || user_id END AS anon, CASE WHEN event_id % 6 <> 0 THEN (event_id % 101)::DOUBLE END AS score, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 < 3 THEN 'cpp' ELSE 'java' END AS ext FROM events")
def parse_solution_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.solution_file(_file()).alias("f")).select("event_id", "f.anon", "f.score", "f.ext")


_scalar("op_054_score_in_name", "events", "event_id", lambda: C.score_in_name(F.when(F.col("event_id") % 9 == 0, F.lit("noscore.cpp")).otherwise(_file()), 50.0), "CASE WHEN event_id % 9 = 0 THEN 50.0::DOUBLE ELSE (event_id % 101)::DOUBLE END")
_scalar("op_055_leading_integer", "events", "event_id", lambda: C.leading_integer(F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("n = ")).otherwise(F.lit("  -")), F.col("user_id").cast("string"), F.lit(" rest"))), "CASE WHEN event_id % 5 <> 0 THEN -user_id END")


@register(
    "op_056_explode_nested",
    "SELECT o_orderkey, l_linenumber, l_partkey, round(l_quantity, 6) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 5",
)
def explode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines nested, exploded to flat rows; empty lists yield no row."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))
    nested = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    flat = nested.select("o_orderkey", F.inline(F.filter("lines", lambda x: x["l_quantity"] > 5)))
    return flat.select("o_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("qty"))


@register("op_057_nonempty_hints", HINT_SETS_SQL + "SELECT conv_id, len(list_filter(hints, lambda h: h.text <> ''))::BIGINT AS n FROM hint_sets")
def nonempty_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.coalesce("hints", F.array()), lambda h: h["text"] != "")
    return hint_sets(spark, sf_dir).select("conv_id", F.size(kept).cast("long").alias("n"))


_scalar("op_058_integer_or_text", "events", "event_id", lambda: F.coalesce(F.trim(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("user_id"))).otherwise(F.lit("10m"))).try_cast("bigint"), F.lit(-1)), "coalesce(try_cast(trim(CASE WHEN event_id % 2 = 0 THEN ' ' || user_id ELSE '10m' END) AS BIGINT), -1)")
_scalar("op_059_variant_family", "events", "event_id", lambda: C.is_bootstrap(F.when(F.col("event_id") % 3 == 0, "bootstrap_full").otherwise("silver_full")), "event_id % 3 = 0")

_U = r"[\p{L}\p{N}_]+"
_scalar("op_120_word_tokens", "benchmark", "item_id", lambda: F.array_join(T.word_tokens(F.col("text")), "|"), rf"array_to_string(regexp_extract_all(text, '{_U}'), '|')")
_scalar("op_121_word_count", "documents", "doc_id", lambda: T.word_count(F.col("text")), f"len(regexp_extract_all(text, '{_U}'))::BIGINT")
_scalar("op_122_sentence_count", "documents", "doc_id", lambda: T.sentence_count(F.col("text")), "greatest(1, len(regexp_extract_all(text, '[.!?]+')))::BIGINT")
_scalar("op_123_whitespace_words", "documents", "doc_id", lambda: T.whitespace_words(F.col("text")), r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT")
_scalar("op_123_closing_marks", "documents", "doc_id", lambda: T.closing_marks(F.col("text")), "greatest(1, length(text) - length(translate(text, '.!?', '')))::BIGINT")
_LINES = r"list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_scalar("op_124_loc", "documents", "doc_id", lambda: T.loc(F.col("text")), rf"len(list_filter({_LINES}, lambda x: x <> '' AND NOT regexp_matches(x, '^(//|/\*|\*)')))::BIGINT")
_scalar("op_125_code_lines", "documents", "doc_id", lambda: F.md5(F.array_join(T.code_lines(F.col("text")), "\n")), rf"md5(array_to_string(list_transform(list_filter({_LINES}, lambda x: x <> '' AND NOT regexp_matches(x, '^(//|/\*|\*)') AND NOT regexp_matches(x, '\*/$')), lambda x: regexp_replace(x, '\s+', ' ', 'g')), chr(10)))")


@register(
    "op_126_identifier_counts",
    r"SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS token FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') AS text FROM benchmark)) GROUP BY item_id, token",
)
def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7f]", " ")
    each = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(ascii_text, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))).alias("token"))
    return each.groupBy("item_id", "token").agg(F.count("*").alias("n"))


_scalar("op_12c_repair_diacritics", "benchmark", "item_id", lambda: T.repair_diacritics(F.concat(F.lit("ˆınt ˘a S, T, "), F.col("text"))), "regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('înt ă S, T, ' || text, '(^|[^\\p{L}\\p{N}_])s\\s*,\\s*', '\\1ș', 'g'), '(^|[^\\p{L}\\p{N}_])S\\s*,\\s*', '\\1Ș', 'g'), '(^|[^\\p{L}\\p{N}_])t\\s*,\\s*', '\\1ț', 'g'), '(^|[^\\p{L}\\p{N}_])T\\s*,\\s*', '\\1Ț', 'g'), 's,', 'ș'), 't,', 'ț'), 'S,', 'Ș'), 'T,', 'Ț'), ' {2,}', ' ', 'g')")
_scalar("op_12j_statement_provenance", "documents", "doc_id", lambda: F.concat(F.when(F.col("doc_id") % 3 == 0, "cached:").otherwise("fresh:"), F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.col("lang"))), "CASE WHEN doc_id % 3 = 0 THEN 'cached:' ELSE 'fresh:' END || coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, lang)")
_scalar("op_12k_truncate", "documents", "doc_id", lambda: F.md5(T.truncate(F.col("text"), 600, "\n[cut]")), "md5(CASE WHEN length(text) > 600 THEN left(text, 600) || chr(10) || '[cut]' ELSE text END)")
_scalar("op_12l_strip_fences", "benchmark", "item_id", lambda: T.strip_fences(F.concat(F.lit("\n```json\n"), F.trim("text"), F.lit("\n```\n"))), r"regexp_replace(trim(text), '^\s+|\s+$', '', 'g')")
_scalar("op_12o_bullets", "region", "r_regionkey", lambda: T.bullets(F.split("r_name", " ")), "array_to_string(list_transform(string_split(r_name, ' '), lambda x: '- ' || x), chr(10))")
_scalar("op_12o_numbered", "nation", "n_nationkey", lambda: T.numbered(F.split("n_name", "_")), "array_to_string(list_transform(string_split(n_name, '_'), lambda x, i: i || '. ' || x), chr(10))")
_scalar("op_12o_chain_summary", "benchmark", "item_id", lambda: T.chain_summary(F.slice(F.split("text", " "), F.lit(1), (F.col("item_id") % 6).cast("int"))), "CASE WHEN item_id % 6 = 0 THEN 'nicio operație extrasă' WHEN item_id % 6 > 3 THEN array_to_string(string_split(text, ' ')[1:3], ' → ') || ' (+ ' || (item_id % 6 - 3) || ' mai multe)' ELSE array_to_string(string_split(text, ' ')[1:item_id % 6], ' → ') END")
_scalar("op_12q_content_key", "documents", "doc_id", lambda: T.content_key(F.col("text")), "left(sha1(text), 16)")
_scalar("op_089_numbers_masked", "events", "event_id", lambda: T.numbers_masked(F.element_at("issues", 1)), f"lower(trim(regexp_replace({ISSUES_SQL}, '-?\\d+', '<N>', 'g')))")

_scalar("op_136_rounding", "orders", "o_orderkey", lambda: F.round(F.col("o_totalprice") / 7, 4), "round(o_totalprice / 7, 4)")
_scalar("op_13c_intent_mismatch", "labels", "doc_id", lambda: ~F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1), F.lit(True)), "NOT coalesce(CASE WHEN doc_id % 3 <> 0 THEN quality = 1 END, true)")
_scalar("op_13e_struct_defaults", "events", "event_id", lambda: F.coalesce(F.get_json_object(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("{}")), "$.k").cast("bigint"), F.lit(0)), "coalesce(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::BIGINT END, 0)")
_scalar("op_13g_array_prefix", "benchmark", "item_id", lambda: F.array_join(F.slice(F.split("text", " "), 1, 4), "|"), "array_to_string(string_split(text, ' ')[1:4], '|')")
_scalar("op_13h_flatten", "benchmark", "item_id", lambda: F.array_join(F.flatten(F.array(F.slice(F.split("text", " "), 1, 2), F.slice(F.split("text", " "), 3, 2))), "|"), "array_to_string(flatten([string_split(text, ' ')[1:2], string_split(text, ' ')[3:4]]), '|')")
_scalar("op_13j_iso_time", "events", "event_id", lambda: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "strftime(ts, '%Y-%m-%dT%H:%M:%S')")


@register(
    "op_11l_ordered_distinct",
    "SELECT item_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), '|') AS v FROM benchmark",
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """array_distinct keeps first occurrences in order; sorted here for comparison only."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.split("text", " "))), "|").alias("v"))


@register(
    "op_13i_map_merge",
    "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS r FROM lineitem GROUP BY l_orderkey",
)
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two halves of an order's lines, merged as maps; missing keys are zero."""
    half = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count_if(F.col("l_linenumber") % 2 == 0).alias("even"), F.count_if(F.col("l_linenumber") % 2 == 1).alias("odd"))
    maps = half.groupBy("l_orderkey").agg(*[F.map_from_entries(F.collect_list(F.struct("l_returnflag", c))).alias(c) for c in ("even", "odd")])
    merged = maps.select("l_orderkey", F.map_zip_with("even", "odd", lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias("m"))
    return merged.select("l_orderkey", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("long").alias(k.lower()) for k in ("A", "N", "R")])


_COS = "round(list_sum(list_transform(range(1, 65), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(x.embedding, lambda v: v::DOUBLE * v::DOUBLE)) * list_sum(list_transform(y.embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) + 0.0"


@register("op_130_cosine", f"SELECT x.vec_id, y.vec_id AS other_id, {_COS} AS v FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return x.join(y, "vec_id").select("vec_id", "other_id", V.settled(V.cosine(F.col("embedding"), F.col("other"))).alias("v"))


@register("op_131_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 6) + 0.0 AS v FROM embeddings")
def dot_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.settled(V.dot(F.col("embedding"), F.col("embedding"))).alias("v"))


@register(
    "op_133_jaccard",
    r"""WITH s AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM benchmark)
    SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1), 6) + 0.0 AS v FROM s a JOIN s b ON b.item_id = a.item_id + 1""",
)
def jaccard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select("item_id", V.token_set(F.col("text")).alias("w"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("other"))
    return a.join(b, "item_id").select("item_id", V.settled(V.jaccard(F.col("w"), F.col("other"))).alias("v"))
