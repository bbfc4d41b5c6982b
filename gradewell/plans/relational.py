"""Joins, windows, sampling, splits and set operations (OP-020, 060 to 076, 110 to 11P) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.functions import vector as V
from gradewell.operators import pairing as P
from gradewell.operators.asof import nearest_preferred
from gradewell.operators.splits import grouped_split
from gradewell.plans.catalog import register
from gradewell.plans.scalars import HINT_SETS_SQL, hint_sets
from gradewell.operators.nearest import top_k
from gradewell.operators.ranks import running
from gradewell.operators.references import checked_ids
from gradewell.operators.selection import first_n, hash_key, order_key
from gradewell.session import table

#: Orders stand for attempts: o_custkey is the author, 'F' fails, 'O' passes, the year is the problem, the priority the language.
ATTEMPTS_SQL = "attempts AS (SELECT o_orderkey, o_custkey, o_orderstatus, year(o_orderdate)::BIGINT AS problem, left(o_orderpriority, 1) AS language, o_totalprice FROM orders)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").cast("long").alias("problem"), F.left("o_orderpriority", F.lit(1)).alias("language"), "o_totalprice")


@register(
    "op_020_log_compaction",
    "SELECT run_id, event_id, status FROM (SELECT user_id || '-' || event_type AS run_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
)
def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each run; an aggregate, so no run's records are sorted."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("run_id"), "event_id", F.when(F.col("event_id") % 3 == 0, "error").otherwise("ok").alias("status"))
    return rows.groupBy("run_id").agg(F.max("event_id").alias("event_id"), F.max_by("status", "event_id").alias("status"))


@register(
    "op_060_inner_lookup",
    "SELECT c_custkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) AS skipped FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3",
)
def inner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the dimension knows, and how many it doesn't."""
    dim = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    skipped = rows.join(dim, "c_nationkey", "left_anti").agg(F.count("*").alias("skipped"))
    return rows.join(dim, "c_nationkey").join(skipped).select("c_custkey", "n_name", "skipped")


@register("op_061_left_lookup", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_nationkey = s_nationkey")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(dim, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@register(
    "op_062_first_match",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
)
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left")


@register(
    "op_063_same_author_pairs",
    f"""WITH {ATTEMPTS_SQL}, fails AS (SELECT *, row_number() OVER (PARTITION BY problem, o_custkey ORDER BY o_orderkey) AS n FROM attempts WHERE o_orderstatus = 'F'),
    passes AS (SELECT problem, o_custkey, min(o_orderkey) AS passing_file FROM attempts WHERE o_orderstatus = 'O' GROUP BY ALL)
    SELECT problem, o_custkey, o_orderkey AS failing_file, passing_file FROM fails JOIN passes USING (problem, o_custkey) WHERE n <= 3""",
)
def same_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir)
    failing = rows.where("o_orderstatus = 'F'").select("problem", "o_custkey", "o_orderkey")
    return P.same_author_pairs(failing, rows.where("o_orderstatus = 'O'"), ["problem", "o_custkey"], "o_orderkey", 3)


@register(
    "op_064_cross_author_pairs",
    f"""WITH {ATTEMPTS_SQL},
    pairs AS (SELECT a.problem, a.language, a.o_orderkey AS fail, b.o_orderkey AS ok, row_number() OVER g - 1 AS n, count(*) OVER (PARTITION BY a.problem, a.language) AS total
      FROM attempts a JOIN attempts b ON a.problem = b.problem AND a.language = b.language AND a.o_custkey <> b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' WINDOW g AS (PARTITION BY a.problem, a.language ORDER BY a.o_orderkey, b.o_custkey, b.o_orderkey)),
    chosen AS (SELECT *, ('0x' || left(md5('7|' || problem || '|' || language), 8))::BIGINT % total AS first, greatest(total // 15, 1) AS step FROM pairs)
    SELECT problem, language, fail, ok FROM chosen WHERE (n - first + total) % total % step = 0 AND (n - first + total) % total // step < least(15, total)""",
)
def cross_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).select("problem", "language", "o_custkey", "o_orderkey", "o_orderstatus")
    failing = rows.where("o_orderstatus = 'F'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "fail")
    passing = rows.where("o_orderstatus = 'O'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "ok")
    return P.cross_author_pairs(failing, passing, ["problem", "language"], "o_custkey", 15, 7, "fail", "ok")


@register("op_065_anti_join_resume", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@register(
    "op_066_nearest_value",
    f"""WITH {ATTEMPTS_SQL}, pairs AS (SELECT p.o_orderkey, f.o_orderkey AS fail, abs(f.o_totalprice - p.o_totalprice) AS d, f.language = p.language AS same
      FROM attempts p JOIN attempts f ON f.o_custkey = p.o_custkey AND f.o_orderstatus = 'F' WHERE p.o_orderstatus = 'O')
    SELECT o_orderkey, fail AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY same DESC, d, fail) AS k FROM pairs) WHERE k = 1""",
)
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same author's failing attempts, in the same language if there are any, the one nearest in score; ties: the smaller key."""
    rows = attempts(spark, sf_dir)
    ok = rows.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "language", "o_totalprice")
    failing = rows.where("o_orderstatus = 'F'").select("o_custkey", "language", F.col("o_orderkey").alias("nearest"), "o_totalprice")
    return nearest_preferred(ok, failing, ["o_custkey"], "language", "o_totalprice", "o_orderkey", "nearest").select("o_orderkey", "nearest")


@register(
    "op_067_range_buckets",
    "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN s >= 0 AND s < 0.5 THEN '0.00-0.50' WHEN s >= 0.5 AND s < 0.7 THEN '0.50-0.70' WHEN s >= 0.7 AND s < 0.85 THEN '0.70-0.85' WHEN s >= 0.85 AND s < 1.01 THEN '0.85-1.00' ELSE 'other' END AS bucket FROM (SELECT value / 100 AS s FROM events)) GROUP BY bucket",
)
def range_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in half-open ranges; what no range holds is ``other``."""
    s = F.col("value") / 100
    bucket = F.when((s >= 0) & (s < 0.5), "0.00-0.50").when((s >= 0.5) & (s < 0.7), "0.50-0.70").when((s >= 0.7) & (s < 0.85), "0.70-0.85").when((s >= 0.85) & (s < 1.01), "0.85-1.00").otherwise("other")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@register(
    "op_068_pair_enrichment",
    "SELECT l_orderkey, l_linenumber, p_partkey IS NOT NULL AS part_exists, p_name, s_suppkey IS NOT NULL AS supplier_exists FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey",
)
def pair_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.lit(True).alias("part"))
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("supplier"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.col("part").isNotNull().alias("part_exists"), "p_name", F.col("supplier").isNotNull().alias("supplier_exists"))


@register(
    "op_069_known_ids",
    "SELECT l.l_orderkey, coalesce(string_agg('p' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_orderkey % 7 <> 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)), '') AS v FROM lineitem l GROUP BY l_orderkey",
)
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a list that a dimension table knows, in their order; repeats stay."""
    from gradewell.plans.checks import concept_dimension, order_concepts

    found = checked_ids(order_concepts(spark, sf_dir), ["l_orderkey"], F.col("concepts"), concept_dimension(spark, sf_dir), "concept_id")
    return found.select("l_orderkey", F.array_join("known", ",").alias("v"))


@register(
    "op_070_code_lookup",
    "SELECT source, arg_min(doc_id, (CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id)) AS doc_id, left(arg_min(text, (CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id)), 5000) AS code FROM documents GROUP BY source",
)
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First file of each source, the preferred language before the others."""
    rank = F.struct(F.when(F.col("lang") == "en", 0).otherwise(1).alias("r"), "doc_id", F.left("text", F.lit(5000)).alias("code"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min(rank).alias("x")).select("source", "x.doc_id", "x.code")


@register(
    "op_071_alias_join",
    "SELECT o_orderkey, coalesce(m.id, lower(trim(o_orderpriority))) AS v FROM orders LEFT JOIN (VALUES ('1-urgent', 'p1'), ('2-high', 'p2'), ('5-low', 'p5')) m(alias, id) ON m.alias = lower(trim(o_orderpriority))",
)
def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("1-URGENT", "p1"), ("2-High", "p2"), (" 5-low ", "p5")], "alias string, id string")
    key, names = P.canonical_id(F.col("o_orderpriority"), aliases)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    return rows.join(names, F.col("key") == F.col("__alias"), "left").select("o_orderkey", F.coalesce("__id", "key").alias("v"))


@register(
    "op_072_best_match",
    r"""WITH a AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w, role FROM conversations),
    s AS (SELECT a.conv_id, a.turn, b.turn AS other, len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1) AS sim FROM a JOIN a b USING (conv_id) WHERE a.role = 'assistant' AND b.role = 'user')
    SELECT conv_id, turn, arg_max(other, (sim, -other)) AS other, round(max(sim), 6) + 0.0 AS sim FROM s GROUP BY conv_id, turn HAVING max(sim) >= 0.05""",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant turn the most similar user turn of its conversation, if similar enough; ties: the earlier."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", V.token_set(F.col("text")).alias("w"))
    a = rows.where("role = 'assistant'").select("conv_id", "turn", "w")
    b = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("other"), F.col("w").alias("v"))
    best = a.join(b, "conv_id").groupBy("conv_id", "turn").agg(F.max(F.struct(V.jaccard(F.col("w"), F.col("v")).alias("sim"), (-F.col("other")).alias("n"))).alias("x"))
    return best.where("x.sim >= 0.05").select("conv_id", "turn", (-F.col("x.n")).alias("other"), V.settled(F.col("x.sim")).alias("sim"))


@register("op_073_point_lookup", HINT_SETS_SQL + "SELECT conv_id, statement, coalesce(hints[1].text, '') AS solution FROM hint_sets")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hint_sets(spark, sf_dir).select("conv_id", "statement", F.coalesce(F.try_element_at("hints", F.lit(1))["text"], F.lit("")).alias("solution"))


@register(
    "op_074_coalescing_lookup",
    "SELECT l.doc_id, coalesce(nullif(CASE WHEN l.doc_id % 2 = 0 THEN '' ELSE d.text END, ''), d.lang) AS v FROM labels l LEFT JOIN documents d USING (doc_id)",
)
def coalescing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents"), "doc_id", "left")
    own = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("text"))
    return rows.select("doc_id", F.coalesce(F.nullif(own, F.lit("")), F.col("lang")).alias("v"))


@register(
    "op_075_packet_assembly",
    "SELECT n_nationkey, n_name, r_name, count(c_custkey) AS n_customers, array_to_string(list_sort(list(c_custkey) FILTER (c_custkey IS NOT NULL))[1:2], ',') AS representatives FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, r_name",
)
def packet_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = P.top_by(table(spark, sf_dir, "customer").where("c_acctbal > 5000"), ["c_nationkey"], 2, "c_custkey")
    some = reps.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("representatives"))
    counts = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    base = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").withColumnRenamed("n_nationkey", "c_nationkey")
    out = base.join(counts, "c_nationkey", "left").join(some, "c_nationkey", "left")
    return out.select(F.col("c_nationkey").alias("n_nationkey"), "n_name", "r_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), "representatives")


@register("op_076_sorted_ids", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def sorted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a dimension with their places in order."""
    return running(table(spark, sf_dir, "supplier").select("s_suppkey"), [], ["s_suppkey"]).select("s_suppkey", (F.col("place") + 1).alias("place"))


@register("op_110_running_list", "SELECT event_id, user_id, row_number() OVER w AS place, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def running_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("place"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@register("op_111_first_last", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@register("op_112_next_start", "SELECT conv_id, turn, lead(turn, 1, 1000) OVER (PARTITION BY conv_id ORDER BY turn) - turn AS width FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk ends where the next one begins, the last at the end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().select("conv_id", "turn", (F.lead("turn", 1, 1000).over(w) - F.col("turn")).alias("width"))


@register("op_113_top_n", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 2, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@register(
    "op_114_budgeted_cap",
    "WITH done AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT o_custkey, o_orderkey FROM (SELECT r.o_custkey, r.o_orderkey, coalesce(n, 0) AS had, row_number() OVER (PARTITION BY r.o_custkey ORDER BY r.o_orderkey) AS k FROM orders r LEFT JOIN done USING (o_custkey) WHERE o_orderstatus = 'F') WHERE k <= 6 - had",
)
def budgeted_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows up to a cap that counts those already produced."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    done = rows.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("had"))
    new = rows.where("o_orderstatus = 'F'").join(done, "o_custkey", "left")
    return P.top_by(new, ["o_custkey"], 6 - F.coalesce("had", F.lit(0)), "o_orderkey").select("o_custkey", "o_orderkey")


@register(
    "op_115_even_cap",
    "SELECT problem, lang2, doc_id FROM (SELECT source AS problem, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS lang2, doc_id, row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE WHEN lang2 = 'a' THEN 7 // 2 ELSE 7 - 7 // 2 END",
)
def even_cap(spark: SparkSession, sf_dir: str, cap: int = 7) -> DataFrame:
    """A cap shared by two languages, each with its own part of it."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("problem"), F.when(F.col("lang") == "en", "a").otherwise("b").alias("lang2"), "doc_id")
    return P.top_by(rows, ["problem", "lang2"], F.when(F.col("lang2") == "a", cap // 2).otherwise(cap - cap // 2), "doc_id")


@register(
    "op_116_systematic_sample",
    "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: k * (n - 1) // 4), i)",
)
def systematic_sample(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """``k`` evenly spaced ranks of each group."""
    rows = running(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"]).withColumnsRenamed({"place": "i", "size": "n"})
    ranks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (k - 1)).cast("long"))
    return rows.where((F.col("n") <= k) | F.array_contains(ranks, F.col("i"))).select("source", "doc_id")


@register("op_117_has_progress", "SELECT user_id, event_type, count(*) >= 2 AND count(DISTINCT value) >= 2 AS v FROM events GROUP BY user_id, event_type")
def has_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two different values are two attempts; the least and the greatest differ, so no list and no distinct count is needed
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.coalesce((F.count("*") >= 2) & (F.min("value") < F.max("value")), F.lit(False)).alias("v"))


@register("op_118_total_sort", "SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey) AS place FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)")
def total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    placed = running(counts, [], [-F.col("n"), "c_nationkey"]).select("c_nationkey", "n", (F.col("place") + 1).alias("place"))
    return placed.orderBy("place")


@register("op_119_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit(spark: SparkSession, sf_dir: str, n: int = 25) -> DataFrame:
    rows = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")
    return rows.limit(n) if n else rows


def _sample(name: str, per: int, seed: int, in_key: bool) -> None:
    key = f"'{seed}|' || source || '|' || doc_id" if in_key else f"'{seed}|' || doc_id"

    @register(name, f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5({key}), doc_id) AS n FROM documents) WHERE n <= {per}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        order = P.seeded(seed, "source", "doc_id") if in_key else P.seeded(seed, "doc_id")
        return P.top_by(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], per, order, "doc_id")


_sample("op_11a_seeded_sample", 5, 11, False)
_sample("op_11b_group_seeded_sample", 5, 7, True)


@register("op_11c_sample_sorted", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 40)")
def sample_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "documents").select("doc_id").orderBy(P.seeded(7, "doc_id"), "doc_id").limit(40)
    return some.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("place"))


@register("op_11d_pool_sample", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 8")
def pool_sample(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """``k`` of the top max(50, 4k) rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    pool = first_n(rows, max(50, 4 * k), F.bitwise_not(order_key(F.col("o_totalprice"), rows.schema["o_totalprice"].dataType)), "o_orderkey")
    return first_n(pool, k, hash_key(P.seeded(7, "o_orderkey")), P.seeded(7, "o_orderkey"), "o_orderkey").select("o_orderkey")


SPLIT_SQL = """members AS (SELECT DISTINCT event_type AS problem, user_id AS anon FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY md5('23|' || problem || '|' || anon), anon) AS k, count(*) OVER (PARTITION BY problem) AS n FROM members),
split AS (SELECT problem, anon, CASE WHEN k <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN k <= greatest(1, floor(n * 0.8)) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("problem"), F.col("user_id").alias("anon"))
    return grouped_split(rows, "problem", "anon", 0.8, 0.1, 23)


@register("op_11e_group_split", f"WITH {SPLIT_SQL} SELECT event_id, split FROM events JOIN split ON problem = event_type AND anon = user_id")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("event_id", "split")


@register("op_09n_split_statistics", f"WITH {SPLIT_SQL} SELECT split, problem, count(*) AS n FROM events JOIN split ON problem = event_type AND anon = user_id GROUP BY split, problem")
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split", "problem").agg(F.count("*").alias("n"))


@register("op_09s_split_matrix", f"WITH {SPLIT_SQL} SELECT problem, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM events JOIN split ON problem = event_type AND anon = user_id GROUP BY problem")
def split_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("problem").pivot("split", ["train", "val", "test"]).count().na.fill(0).orderBy("problem")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(q.embedding, lambda v: v::DOUBLE * v::DOUBLE)) * list_sum(list_transform(e.embedding, lambda v: v::DOUBLE * v::DOUBLE)))"


@register(
    "op_11f_vector_top_k",
    f"SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 9) DESC, e.vec_id) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE n <= 5",
)
def vector_top_k(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The ``k`` nearest of all vectors for a stated set of query vectors, block by block."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k)


@register("op_11g_argmax_first", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY user_id")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@register(
    "op_11h_ratio_mix",
    "WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE quality = 0), n AS (SELECT least((SELECT count(*) FROM a), floor((SELECT count(*) FROM b) * 0.7 / 0.3))::BIGINT AS na) SELECT doc_id, 'a' AS origin FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('23|' || doc_id), doc_id) AS k FROM a) WHERE k <= (SELECT na FROM n) UNION ALL SELECT doc_id, 'b' FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('23|' || doc_id), doc_id) AS k FROM b) WHERE k <= (SELECT floor(na * 0.3 / 0.7) FROM n)",
)
def ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources mixed 70 to 30, as many rows as the scarcer allows."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = rows.agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b")).first()
    n_a = min(n["a"], int(n["b"] * 0.7 / 0.3))
    key = hash_key(P.seeded(23, "doc_id"))
    a = first_n(rows.where("quality = 1"), n_a, key, P.seeded(23, "doc_id"), "doc_id").select("doc_id", F.lit("a").alias("origin"))
    return a.unionByName(first_n(rows.where("quality = 0"), int(n_a * 0.3 / 0.7), key, P.seeded(23, "doc_id"), "doc_id").select("doc_id", F.lit("b").alias("origin")))


@register("op_11i_bag_union", "SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id")))


@register("op_11j_key_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select("s_nationkey"))


@register("op_11k_key_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey").distinct())


@register("op_11m_distinct_ends", "SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def distinct_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ids of both sides of pairs, before an expensive call."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("id")).union(rows.select("l_suppkey")).distinct()


@register(
    "op_11n_multiset_difference",
    r"""WITH t AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY ALL)
    SELECT b.item_id, b.w, b.n - coalesce(a.n, 0) AS delta FROM t b LEFT JOIN t a ON a.item_id = b.item_id - 1 AND a.w = b.w WHERE b.n > coalesce(a.n, 0)""",
)
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a text has more often than the one before it."""
    counts = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    before = counts.select((F.col("item_id") + 1).alias("item_id"), "w", F.col("n").alias("m"))
    delta = F.col("n") - F.coalesce("m", F.lit(0))
    return counts.join(before, ["item_id", "w"], "left").where(delta > 0).select("item_id", "w", delta.alias("delta"))


@register("op_11o_upsert", "SELECT doc_id, quality + 10 AS quality FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return P.upsert(rows.select("doc_id", "quality"), rows.where("toxic = 1").select("doc_id", (F.col("quality") + 10).alias("quality")), ["doc_id"])


@register(
    "op_14c_incremental_resume",
    "SELECT user_id, count(*) FILTER (event_id >= 500) AS new_rows, count(*) FILTER (event_id < 500) AS done_rows FROM events GROUP BY user_id",
)
def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run still has to do, and what the first had done."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    done = rows.where("event_id < 500")
    new = P.not_done(rows, done, ["event_id"])
    both = new.withColumn("new", F.lit(1)).unionByName(done.withColumn("new", F.lit(0)))
    return both.groupBy("user_id").agg(F.sum("new").alias("new_rows"), F.count_if(F.col("new") == 0).alias("done_rows"))


@register(
    "op_14m_parameter_grid",
    "WITH grid AS (SELECT v || '-' || t AS run_id FROM (VALUES ('full'), ('short'), ('plain')) a(v), (VALUES (0), (3), (7)) b(t)) SELECT run_id FROM grid WHERE run_id NOT IN (SELECT event_type || '-' || (event_id % 4) FROM events) AND run_id <> 'short-3'",
)
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant at every temperature that hasn't run well yet."""
    variants = spark.createDataFrame([("full",), ("short",), ("plain",)], "v string")
    grid = variants.select(F.explode(F.array(*[F.concat("v", F.lit(f"-{t}")) for t in (0, 3, 7)])).alias("run_id"))
    done = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("event_id") % 4).cast("string")).alias("run_id")).distinct()
    return P.not_done(grid.where("run_id <> 'short-3'"), done, ["run_id"])


@register("op_14n_first_row", "SELECT user_id, event_id, props FROM events WHERE user_id = 7 ORDER BY event_id LIMIT 1")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id = 7").orderBy("event_id").limit(1).select("user_id", "event_id", "props")


@register("op_14o_listing", "SELECT source, count(*) AS n, count(*) FILTER (length(text) < 100) AS n_short, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 100).alias("n_short"), F.sum(F.length("text")).cast("long").alias("chars"))


@register(
    "op_14b_valid_routing",
    "SELECT CASE WHEN passed THEN 'valid' ELSE 'invalid' END AS route, count(*) AS n FROM (SELECT coalesce(quality = 1, false) AS passed FROM labels) GROUP BY 1",
)
def valid_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed to the valid or the dead-letter side of one plan."""
    rows = table(spark, sf_dir, "labels").withColumn("passed", F.coalesce(F.col("quality") == 1, F.lit(False)))
    valid, invalid = rows.where("passed"), rows.where("NOT passed")
    return valid.select(F.lit("valid").alias("route")).unionByName(invalid.select(F.lit("invalid").alias("route"))).groupBy("route").agg(F.count("*").alias("n"))


@register("op_14e_messages", "SELECT conv_id, array_to_string(list(role || ':' || text ORDER BY turn, text), '|') AS v FROM conversations GROUP BY conv_id")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(lines, "|").alias("v"))
