"""Aggregation and report queries (OP-080 to 09S, 132) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.functions import classify as C
from gradewell.functions import text as T
from gradewell.functions import vector as V
from gradewell.operators import semantic as S
from gradewell.operators.selection import quantiles, select_ranks
from gradewell.plans.catalog import register
from gradewell.plans.scalars import _REPORT, HINT_SETS_SQL, ISSUES_SQL, graded_events, hint_sets
from gradewell.session import table, with_settings


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """Equal bins, the last one closed; values outside are left out."""
    v = F.col(value)
    bin_no = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return rows.where(v.between(low, high)).groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Most frequent values; ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


@register("op_080_count_per_key", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@register("op_081_nested_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@register("op_082_having_with_reason", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 12 THEN 'kept' ELSE 'below_min:' || count(*) || '<12' END AS reason FROM orders GROUP BY o_custkey")
def having(spark: SparkSession, sf_dir: str, least: int = 12) -> DataFrame:
    """Group sizes, with the reason of those that are dropped."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.withColumn("reason", F.when(F.col("n") >= least, "kept").otherwise(F.concat(F.lit("below_min:"), F.col("n"), F.lit(f"<{least}"))))


@register("op_083_first_then_group", "SELECT d, count(*) AS n FROM (SELECT user_id, min(ts)::DATE AS d FROM events GROUP BY user_id) GROUP BY d")
def first_then_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event only, counted by day."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("d"))
    return first.groupBy("d").agg(F.count("*").alias("n"))


@register("op_084_coverage_histogram", "SELECT kinds, count(*) AS n FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS kinds FROM lineitem GROUP BY l_orderkey) GROUP BY kinds")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("kinds")).groupBy("kinds").agg(F.count("*").alias("n"))


@register("op_085_mean_per_group", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY event_type ORDER BY mean, event_type")
def mean_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(V.settled(F.avg("value")).alias("mean")).orderBy("mean", "event_type")


@register("op_086_score_histogram", "SELECT event_type, least(floor(value / 5), 19)::BIGINT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "events"), "value", 0, 100, 20, "event_type")


@register("op_086_loc_histogram", r"SELECT least(floor(v / 15), 39)::BIGINT AS bin, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '[.!?]+'))::DOUBLE AS v FROM documents) WHERE v BETWEEN 0 AND 600 GROUP BY 1")
def loc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.regexp_count("text", F.lit("[.!?]+")).cast("double").alias("v"))
    return histogram(rows, "v", 0, 600, 40)


@register("op_087_unit_histogram", "SELECT n AS size, count(*) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def unit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@register("op_088_top_k", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "part"), "p_type", 10)


@register("op_089_issue_categories", f"SELECT issue, count(*) AS n FROM (SELECT lower(trim(regexp_replace({ISSUES_SQL}, '-?\\d+', '<N>', 'g'))) AS issue FROM events) GROUP BY issue ORDER BY n DESC, issue LIMIT 15")
def issue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = graded_events(spark, sf_dir).select(F.explode("issues").alias("raw"))
    return top_k(issues.select(T.numbers_masked(F.col("raw")).alias("issue")), "issue", 15)


@register(
    "op_09a_violation_reasons",
    "SELECT reason, count(*) AS n FROM (SELECT string_split(CASE WHEN n_chars > 5000 THEN 'too_long_words:' || n_chars WHEN n_chars < 100 THEN 'too_short_words:' || n_chars ELSE 'schema' END, ':')[1] AS reason FROM documents WHERE n_chars IS NOT NULL) GROUP BY reason",
)
def violation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    long = rows.where("n_chars > 5000").select(F.concat(F.lit("too_long_words:"), "n_chars").alias("v"))
    short = rows.where("n_chars < 100").select(F.concat(F.lit("too_short_words:"), "n_chars").alias("v"))
    schema = rows.where("n_chars BETWEEN 100 AND 5000").select(F.lit("schema").alias("v"))
    return long.unionByName(short).unionByName(schema).groupBy(F.substring_index("v", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@register("op_09b_length_by_level", HINT_SETS_SQL + f"SELECT h.level AS level, count(*) AS n, round(avg(len(regexp_extract_all(h.text, '{T.WORD}'))), 6) + 0.0 AS mean_words, round(median(len(regexp_extract_all(h.text, '{T.WORD}'))), 6) + 0.0 AS median_words FROM (SELECT unnest(hints) AS h FROM hint_sets) GROUP BY 1")
def length_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = hint_sets(spark, sf_dir).select(F.explode("hints").alias("h")).select("h.level", T.word_count(F.col("h.text")).alias("w"))
    means = each.groupBy("level").agg(F.count("*").alias("n"), V.settled(F.avg("w")).alias("mean_words"))
    return means.join(quantiles(each, ["level"], "w", {"median": 0.5}).select("level", V.settled(F.col("median")).alias("median_words")), "level")


@register("op_09c_median_p95", "SELECT event_type, round(median(value), 6) + 0.0 AS med, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95 FROM events GROUP BY event_type")
def median_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of groups of any size: no group's values are gathered."""
    found = quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"med": 0.5, "p95": 0.95})
    return found.select("event_type", *[V.settled(F.col(c)).alias(c) for c in ("med", "p95")])


@register("op_09d_count_matrix", f"SELECT v AS verdict, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS \"view\" FROM (SELECT event_type, {_REPORT} AS v FROM events) GROUP BY v")
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded_events(spark, sf_dir).select("event_type", C.verdict_report(F.col("pts"), F.col("issues")).alias("verdict"))
    return rows.groupBy("verdict").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)


@register("op_09e_dimension_coverage", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000) ON c_nationkey = n_nationkey GROUP BY n_name")
def dimension_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@register(
    "op_09g_threshold_counts",
    "SELECT coalesce(source, 'all') AS source, count(*) AS n, count(*) FILTER (s >= 0.85) AS above, count(*) FILTER (s < 0.85) AS below, count(*) FILTER (s IS NULL) AS missing FROM (SELECT event_type AS source, CASE WHEN event_id % 9 <> 0 THEN value / 100 END AS s FROM events) GROUP BY ROLLUP(source)",
)
def threshold_counts(spark: SparkSession, sf_dir: str, threshold: float = 0.85) -> DataFrame:
    """Counts around a threshold, by group and over all, in one pass."""
    s = F.when(F.col("event_id") % 9 != 0, F.col("value") / 100)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), s.alias("s"))
    counts = rows.rollup("source").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= threshold).alias("above"), F.count_if(F.col("s") < threshold).alias("below"), F.count_if(F.col("s").isNull()).alias("missing"))
    return counts.withColumn("source", F.coalesce("source", F.lit("all")))


@register(
    "op_09h_source_comparison",
    """WITH d AS (SELECT source, doc_id, n_chars, lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
    langs AS (SELECT source, string_agg(lang, ', ' ORDER BY n DESC, lang) AS top3 FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM d GROUP BY source, lang) WHERE k <= 3 GROUP BY source)
    SELECT source, count(*) AS attempts, count(*) FILTER (quality = 1) AS valid, round(100.0 * count(*) FILTER (quality = 1) / count(*), 2) + 0.0 AS rate, count(DISTINCT lang) AS n_langs, round(avg(n_chars), 4) + 0.0 AS mean_chars, round(median(n_chars), 4) + 0.0 AS median_chars, any_value(top3) AS top3
    FROM d JOIN langs USING (source) GROUP BY source""",
)
def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    w = Window.partitionBy("source").orderBy(F.desc("n"), "lang")
    top = d.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w)).where("k <= 3")
    top = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "lang"))), lambda x: x["lang"]), ", ").alias("top3"))
    valid = F.count_if(F.col("quality") == 1)
    report = d.groupBy("source").agg(F.count("*").alias("attempts"), valid.alias("valid"), V.settled(100.0 * valid / F.count("*"), 2).alias("rate"), F.count_distinct("lang").alias("n_langs"), V.settled(F.avg("n_chars"), 4).alias("mean_chars"))
    medians = quantiles(d, ["source"], "n_chars", {"median": 0.5}).select("source", V.settled(F.col("median"), 4).alias("median_chars"))
    return report.join(top, "source").join(medians, "source")


@register("op_09i_length_summary", "SELECT event_type, min(value) AS low, list_sort(list(value))[count(*) // 2 + 1] AS mid, max(value) AS high FROM events GROUP BY event_type")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper median and greatest; the median is the value at a rank, which is found by counting."""
    found = select_ranks(table(spark, sf_dir, "events"), ["event_type"], "value", {"mid": lambda n: F.floor(n / 2)})
    return found.select("event_type", "low", "mid", "high")


@register(
    "op_09j_median_representative",
    "SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY abs(n_chars - m), n_chars, doc_id) AS k FROM (SELECT *, median(n_chars) OVER (PARTITION BY source, lang) AS m FROM documents)) WHERE k = 1",
)
def median_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of each group whose length is nearest to the group's median."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    m = quantiles(rows, ["source", "lang"], "n_chars", {"m": 0.5}).drop("n")
    best = rows.join(m, ["source", "lang"]).groupBy("source", "lang").agg(F.min(F.struct(F.abs(F.col("n_chars") - F.col("m")).alias("d"), "n_chars", "doc_id")).alias("x"))
    return best.select("source", "lang", "x.doc_id")


@register(
    "op_09k_confidence_distribution",
    "SELECT c, count(*) AS n FROM (SELECT unnest([CASE quality WHEN 1 THEN 'high' ELSE 'low' END, CASE toxic WHEN 1 THEN 'medium' ELSE 'high' END, 'none']) AS c FROM labels) WHERE c IN ('high', 'medium', 'low') GROUP BY c",
)
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.array(F.when(F.col("quality") == 1, "high").otherwise("low"), F.when(F.col("toxic") == 1, "medium").otherwise("high"), F.lit("none"))
    return table(spark, sf_dir, "labels").select(F.explode(three).alias("c")).where(F.col("c").isin("high", "medium", "low")).groupBy("c").agg(F.count("*").alias("n"))


@register(
    "op_09l_consistency_verdict",
    "SELECT source, round(rate, 3) + 0.0 AS rate, n_langs, CASE WHEN rate >= 0.8 AND n_langs <= 3 THEN 'READY' ELSE 'NOT READY' END AS verdict FROM (SELECT source, avg((quality = 1)::INT) AS rate, count(DISTINCT lang) AS n_langs FROM documents JOIN labels USING (doc_id) GROUP BY source)",
)
def consistency_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rated = d.groupBy("source").agg(F.avg((F.col("quality") == 1).cast("int")).alias("r"), F.count_distinct("lang").alias("n_langs"))
    return rated.select("source", V.settled(F.col("r"), 3).alias("rate"), "n_langs", F.when((F.col("r") >= 0.8) & (F.col("n_langs") <= 3), "READY").otherwise("NOT READY").alias("verdict"))


@register(
    "op_09m_mean_off_diagonal",
    r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations)
    SELECT a.conv_id, round(avg(len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1)), 6) + 0.0 AS v FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY a.conv_id""",
)
def mean_off_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of different texts of a group; the matrix is symmetric, so half of it is enough."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", V.token_set(F.col("text")).alias("w"))
    other = t.select("conv_id", F.col("turn").alias("turn2"), F.col("w").alias("v"))
    half = t.join(other, "conv_id").where("turn < turn2")
    return half.groupBy("conv_id").agg(V.settled(F.avg(V.jaccard(F.col("w"), F.col("v")))).alias("v"))


@register(
    "op_09m_vector_mean",
    """WITH u AS (SELECT label, vec_id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))
    SELECT a.label, count(DISTINCT a.vec_id) AS n, round(avg(list_dot_product(a.u, b.u)), 6) + 0.0 AS mean FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label""",
)
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of different vectors of a label, from the sum of its unit vectors."""
    found = S.mean_likeness(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return found.select("label", "n", V.settled(F.col("mean")).alias("mean"))


@register(
    "op_132_pairwise_matrix",
    """WITH u AS (SELECT label, vec_id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))
    SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(round(list_dot_product(a.u, b.u), 9), 6) + 0.0 AS v FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id""",
)
def pairwise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of cosines of each label, by blocks; the result's session has the settings by which a writer makes it small."""
    found = S.pairwise(table(with_settings(spark, S.STORED_MATRIX), sf_dir, "embeddings"), ["label"], "vec_id", "embedding", by_row=True)
    return found.select("label", "a", "b", V.settled(F.col("sim")).alias("v"))


@register(
    "op_09o_problem_index",
    "SELECT source, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages, length(arg_min(text, doc_id))::BIGINT AS chunk_chars, left(arg_min(text, doc_id), 600) AS excerpt FROM documents GROUP BY source",
)
def problem_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.struct(F.length("text").cast("long").alias("n"), F.left("text", F.lit(600)).alias("x")), "doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), first.alias("f")).select("source", "n", "languages", F.col("f.n").alias("chunk_chars"), F.col("f.x").alias("excerpt"))


@register("op_09p_fixed_order_counts", f"SELECT k.v AS verdict, count(e.v) AS n FROM (VALUES ('OK'), ('WA'), ('TLE'), ('RE'), ('CE'), ('MLE'), ('OTHER')) k(v) LEFT JOIN (SELECT {_REPORT} AS v FROM events) e ON e.v = k.v GROUP BY k.v")
def fixed_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category in its order, zeros too."""
    order = spark.createDataFrame([(i, v) for i, v in enumerate(C.VERDICTS)], "place int, verdict string")
    counts = graded_events(spark, sf_dir).groupBy(C.verdict_report(F.col("pts"), F.col("issues")).alias("verdict")).agg(F.count("*").alias("n"))
    return order.join(counts, "verdict", "left").orderBy("place").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


@register("op_09q_flag_small_groups", "SELECT source, count(*) AS n, count(*) < 50 AS small FROM documents GROUP BY source ORDER BY n, source")
def flag_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < 50).orderBy("n", "source")


@register("op_09r_shares", "SELECT coalesce(lang, '?') AS lang, round(100.0 * count(*) / sum(count(*)) OVER (), 4) + 0.0 AS share FROM (SELECT CASE WHEN doc_id % 11 <> 0 THEN lang END AS lang FROM documents) GROUP BY 1")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each category; the window is over one row a category."""
    counts = table(spark, sf_dir, "documents").groupBy(F.coalesce(F.when(F.col("doc_id") % 11 != 0, F.col("lang")), F.lit("?")).alias("lang")).agg(F.count("*").alias("n"))
    return counts.select("lang", V.settled(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))
