"""Queries around file sources, archives, differences, requests and reports (OP-001 to 023, 127 to 12B, 11P, 14K, 14P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import text as T
from gradewell.operators import diffs as D
from gradewell.operators import prompts as P
from gradewell.plans.catalog import register
from gradewell.sources import files
from gradewell.session import table

# --- file sources and sinks


@register("op_001_lines_round_trip", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.shared_folder(spark)
    files.write_lines(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_lines(spark, path, "event_id long, user_id long, event_type string, value double").withColumn("value", F.round("value", 6))


@register("op_002_rows_written", "SELECT count(*) AS n FROM events")
def rows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = files.write_lines(table(spark, sf_dir, "events").select("event_id"), files.shared_folder(spark))
    return spark.createDataFrame([(n,)], "n long")


@register("op_003_document", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-003 and 004: a small table as one JSON document and back."""
    path = files.shared_folder(spark)
    files.write_document(table(spark, sf_dir, "region"), path)
    return files.read_document(spark, path, "r_regionkey long, r_name string")


@register("op_005_tolerant_lines", "SELECT event_id FROM events WHERE event_id % 7 <> 0")
def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.shared_folder(spark)
    line = F.when(F.col("event_id") % 7 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct("event_id")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return files.read_lines(spark, path, "event_id long", tolerant=True)


@register("op_006_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = files.shared_folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    files.write_lines(rows.where("event_id % 2 = 0"), path)
    files.write_lines(rows.where("event_id % 2 = 1"), path, append=True)
    return files.read_lines(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: an archive for each benchmark text, with the text as a test's input in an archive inside it."""
    from gradewell.sources.archives import zipped

    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("a/"), F.col("item_id"), F.lit(".zip")).alias("path"), zipped(F.col("item_id").cast("string"), F.col("text")).alias("content"))


_MEMBERS_SQL = """(SELECT 'a/' || item_id || '.zip' AS archive, 'README.txt' AS member, 'item ' || item_id AS payload FROM benchmark UNION ALL SELECT 'a/' || item_id || '.zip', 'private_tests/p' || item_id || '/' || item_id || '-small.in', text FROM benchmark
    UNION ALL SELECT 'a/' || item_id || '.zip', 'private_tests/p' || item_id || '/' || item_id || '-small.ref', length(text)::VARCHAR FROM benchmark)"""


@register("op_007_extract", f"SELECT archive, member, md5(payload) AS v, true AS again FROM {_MEMBERS_SQL}")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members into a folder, and once more, which does nothing."""
    from gradewell.sources.archives import extract_once, extracted

    files_in, target = archives(spark, sf_dir), files.shared_folder(spark)
    first, second = extract_once(files_in, target), extract_once(files_in, target)
    return extracted(spark, target).select("archive", "member", F.md5("payload").alias("v"), F.lit(first and not second).alias("again"))


@register("op_008_selective_extract", rf"SELECT archive, member, strlen(payload)::BIGINT AS size FROM {_MEMBERS_SQL} WHERE regexp_matches(member, '\.(in|ref)$') AND strlen(payload) < 600")
def selective_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of inner archives of one name, by extension and size."""
    from gradewell.sources.archives import members_of

    return members_of(archives(spark, sf_dir), wanted=r"\.(in|ref)$", inner=r"^tests_\d+\.zip$", most=599, payload=False).select("archive", "member", "size")


@register("op_010_member_payloads", rf"SELECT string_split(member, '/')[2] AS pid, regexp_replace(string_split(member, '/')[3], '\.in$', '') AS test_id, strlen(payload)::BIGINT AS size, md5(payload) AS v FROM {_MEMBERS_SQL} WHERE member LIKE 'private_tests/%.in'")
def member_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.sources.archives import members_of, test_inputs

    return test_inputs(members_of(archives(spark, sf_dir))).select("pid", "test_id", "size", F.md5("payload").alias("v"))


@register("op_009_listing_ids", "SELECT DISTINCT string_split(p_type || '/' || p_name, '/')[1] AS pid FROM part")
def listing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.sources.archives import test_ids

    return test_ids(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_name").alias("member")))


@register("op_011_solution_folders", "SELECT lang AS pid, 'anon' || doc_id AS anon, (doc_id % 101)::DOUBLE AS score, text AS code FROM documents")
def solution_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-011 and 012 on rows of the shape that a folder scan has (path, content), one for each document."""
    name = F.concat(F.lit("/root/2024_"), "lang", F.lit("/anon"), "doc_id", F.lit("_"), F.col("doc_id") % 101, F.lit(".cpp"))
    rows = table(spark, sf_dir, "documents").select(F.split(name, "/").alias("p"), F.encode("text", "UTF-8").alias("content"))
    from gradewell.functions.classify import solution_file

    f = rows.select(F.split(F.element_at("p", -2), "_", 2)[1].alias("pid"), solution_file(F.element_at("p", -1)).alias("f"), files.safe_text(F.col("content")).alias("code"))
    return f.select("pid", "f.anon", "f.score", "code")


@register(
    "op_013_safe_text",
    """WITH t AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 997 THEN length(text) ELSE list_max(list_filter(range(249, 998), lambda k: strlen(left(text, k)) <= 997)) END AS k FROM documents WHERE strlen(text) <= 200000)
    SELECT doc_id, md5(text) AS v, md5(left(text, k) || CASE WHEN k < length(text) AND strlen(left(text, k)) < 997 THEN chr(65533) ELSE '' END) AS cut FROM t
    UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE strlen(text) > 200000""",
)
def safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read within the bound, and within one of 997 bytes, which falls inside characters; longer ones than the bound have no digest in SQL."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    within = F.octet_length("b") <= 200_000
    return rows.select("doc_id", F.when(within, F.md5(files.safe_text(F.col("b")))).alias("v"), F.when(within, F.md5(files.safe_text(F.col("b"), 997))).alias("cut"))


@register("op_012_folder_groups", "SELECT lang AS pid, '2024|' || lang AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang")
def folder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grouped by year and problem of their folder."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat(F.lit("2024_"), "lang"), "_", 2).alias("k"))
    return rows.groupBy(F.concat_ws("|", F.col("k")[0], F.col("k")[1]).alias("key"), F.col("k")[1].alias("pid")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).select("pid", "key", "n", "first")


@register("op_016_packets", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON packets, one for each source, read as a table."""
    path = files.shared_folder(spark)
    files.write_lines(table(spark, sf_dir, "documents").select("source", "doc_id"), path)
    return files.read_lines(spark, f"{path}/*.json", "source string, doc_id long").groupBy("source").agg(F.count("*").alias("n"))


@register("op_017_csv_sink", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.shared_folder(spark)
    files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey long, n_name string").option("header", True).csv(path)


@register(
    "op_018_markdown",
    "SELECT 0 AS place, '| n_nationkey | n_name | n_regionkey |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT n_nationkey::INT + 2, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM nation",
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = files.markdown(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"))
    return spark.createDataFrame(list(enumerate(report.split("\n"))), "place int, line string")


@register("op_004_document_sink", "SELECT n_nationkey, n_name FROM nation")
def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as one compact JSON document, read back whole."""
    path = files.shared_folder(spark)
    files.write_document(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, pretty=False)
    return files.read_document(spark, path, "n_nationkey long, n_name string")


@register("op_023_optional_scan", "SELECT NULL::BIGINT AS a WHERE false")
def optional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_optional(spark, files.shared_folder(spark), "a long")


# --- differences


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document beside the first one that opens with the same line, as normalised lines."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.substring_index("text", "\n", 1).alias("opens"), "text")
    # ids alone are grouped; a text moves once as a version and once as the first one
    pairs = rows.groupBy("opens").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("opens", "first")
    firsts = rows.select(F.col("doc_id").alias("first"), T.code_lines(F.col("text")).alias("b"))
    named = rows.join(pairs, "opens").where("doc_id <> first").select("doc_id", "first", T.code_lines(F.col("text")).alias("a"))
    return named.join(firsts, "first").select("doc_id", "first", "a", "b")


_LINES_SQL = r"""list_transform(list_filter(list_transform(string_split(rtrim(text, chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|/\*|\*)') AND NOT regexp_matches(x, '\*/$')), lambda x: regexp_replace(x, '\s+', ' ', 'g'))"""


@register(
    "op_128_line_diff",
    f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10))[1] AS opens, {_LINES_SQL} AS l FROM documents WHERE text IS NOT NULL),
    pair AS (SELECT v.doc_id, v.first, v.l AS a, f.l AS b, len(v.l) AS n, len(f.l) AS m FROM (SELECT *, min(doc_id) OVER (PARTITION BY opens) AS first FROM d) v JOIN d f ON f.doc_id = v.first AND v.doc_id <> v.first),
    old AS (SELECT doc_id, unnest(a) AS line, unnest(range(n)) AS i FROM pair), new AS (SELECT doc_id, unnest(b) AS line, unnest(range(m)) AS j FROM pair),
    same AS (SELECT doc_id, i, j, i - row_number() OVER (PARTITION BY doc_id, i - j ORDER BY i) AS island FROM old JOIN new USING (doc_id, line)),
    runs AS (SELECT doc_id, min(i) AS i, min(j) AS j, count(*) AS len FROM same GROUP BY doc_id, i - j, island),
    areas AS (
      SELECT doc_id, 0 AS i0, n AS i1, 0 AS j0, m AS j1, NULL::BIGINT AS bi, NULL::BIGINT AS bj, 0 AS bl FROM pair
      UNION ALL
      SELECT doc_id, CASE side WHEN 0 THEN i0 ELSE ci + cl END, CASE side WHEN 0 THEN ci ELSE i1 END, CASE side WHEN 0 THEN j0 ELSE cj + cl END, CASE side WHEN 0 THEN cj ELSE j1 END, ci, cj, CASE side WHEN 0 THEN cl ELSE 0 END
      FROM (SELECT *, unnest([0, 1]) AS side FROM (
        SELECT a.doc_id, a.i0, a.i1, a.j0, a.j1, c.ci, c.cj, c.cl, row_number() OVER (PARTITION BY a.doc_id, a.i0, a.i1, a.j0, a.j1 ORDER BY c.cl DESC, c.ci, c.cj) AS k
        FROM areas a JOIN runs r ON r.doc_id = a.doc_id, LATERAL (SELECT greatest(r.i, a.i0, a.j0 + r.i - r.j) AS ci, greatest(r.i, a.i0, a.j0 + r.i - r.j) - r.i + r.j AS cj, least(r.i + r.len, a.i1, a.j1 + r.i - r.j) - greatest(r.i, a.i0, a.j0 + r.i - r.j) AS cl) c
        WHERE c.cl > 0 AND a.i0 < a.i1 AND a.j0 < a.j1) WHERE k = 1)),
    common AS (SELECT doc_id, sum(bl) AS c FROM areas GROUP BY doc_id)
    SELECT doc_id, first, (m - c)::BIGINT AS n_added, (n - c)::BIGINT AS n_removed, CASE WHEN n + m = 0 THEN 1.0 ELSE round(2.0 * c / (n + m), 6) + 0.0 END AS ratio FROM pair JOIN common USING (doc_id)""",
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-127, 128: lines that were added and removed by longest common blocks, and the share that is common."""
    rows = versions(spark, sf_dir).select("doc_id", "first", D.diff_lines("a", "b").alias("d"))
    return rows.select("doc_id", "first", "d.n_added", "d.n_removed", F.round("d.ratio", 6).alias("ratio"))


@register("op_129_diff_summary")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-127 to 129: blocks, structure and excerpt as a reader sees them."""
    rows = versions(spark, sf_dir).select("doc_id", D.diff_lines("a", "b").alias("d"))
    return rows.select("doc_id", F.size("d.added_blocks").alias("n_added_blocks"), F.size("d.removed_blocks").alias("n_removed_blocks"), D.summary(F.col("d")).alias("summary"), "d.excerpt")


_NORMAL = r"list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|/\*|\*)') AND NOT regexp_matches(x, '\*/$'))"


@register(
    "op_128_multiset_diff",
    f"""WITH l AS (SELECT item_id, unnest({_NORMAL}) AS w FROM benchmark), c AS (SELECT item_id, trim(w) AS w, count(*) AS n FROM l GROUP BY ALL)
    SELECT i.item_id, coalesce((SELECT sum(greatest(b.n - coalesce(a.n, 0), 0)) FROM c b LEFT JOIN c a ON a.item_id = i.item_id AND a.w = b.w WHERE b.item_id = i.item_id + 1), 0)::BIGINT AS added FROM benchmark i JOIN benchmark j ON j.item_id = i.item_id + 1""",
)
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free lines that the next version adds."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", " ", "\n").alias("text"))
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    rows = rows.join(other, "item_id").select("item_id", T.code_lines(F.col("text")).alias("a"), T.code_lines(F.col("other")).alias("b"))
    a = rows.select("item_id", F.explode("a").alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    b = rows.select("item_id", F.explode("b").alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("m"))
    delta = b.join(a, ["item_id", "w"], "left").groupBy("item_id").agg(F.sum(F.greatest(F.col("m") - F.coalesce("n", F.lit(0)), F.lit(0))).alias("added"))
    return rows.select("item_id").join(delta, "item_id", "left").select("item_id", F.coalesce("added", F.lit(0)).cast("long").alias("added"))


@register("op_12a_template_hints")
def template_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints without a model."""
    rows = versions(spark, sf_dir).select("doc_id", D.diff_lines("a", "b").alias("d"))
    return rows.select("doc_id", F.inline(D.template_hints(F.col("d"), F.lit("arrays"), F.lit("medium"))), F.lit("silver_diff").alias("source"))


@register("op_12b_template_rows")
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of hints without a model, in the layout of hint sets."""
    meta = {"problem_id": F.concat(F.lit("p"), "doc_id"), "anon_id": F.concat(F.lit("anon_"), "doc_id"), "submission_name": F.concat(F.lit("anon_"), "doc_id", F.lit("_40.cpp")), "language": F.lit("cpp"), "passing_file": F.concat("doc_id", F.lit("_100.cpp"))}
    rows = versions(spark, sf_dir).select("doc_id", D.diff_lines("a", "b").alias("d"))
    made = rows.select("doc_id", D.template_row(F.col("d"), F.lit("arrays"), F.lit("medium"), F.lit(0.91234), **meta).alias("r")).select("doc_id", "r.*")
    return made.withColumns({c: F.to_json(c) for c in ("issues", "concepts_targeted", "hints", "validator_violations")})


# --- requests and reports


@register("op_14k_problem_context", "SELECT doc_id, lang, source, left(text, 200) AS excerpt FROM documents WHERE doc_id = 7")
def problem_context(spark: SparkSession, sf_dir: str, doc_id: int = 7) -> DataFrame:
    """The point lookup behind an interactive request."""
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == doc_id).select("doc_id", "lang", "source", F.left("text", F.lit(200)).alias("excerpt"))


@register("op_11p_validated_save", "SELECT count(*) AS n FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1)")
def validated_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write only if no row is invalid, else fail before anything is written."""
    rows = table(spark, sf_dir, "labels")
    bad = rows.where(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).count()
    if bad:
        raise ValueError(f"{bad} rows are invalid")
    return spark.createDataFrame([(files.write_lines(rows, files.shared_folder(spark)),)], "n long")


@register(
    "op_14p_report",
    """WITH r AS (SELECT source, count(*) AS n, avg(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END) AS rate, count(DISTINCT lang) AS langs, array_to_string(list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)), ', ') AS algs, list_sort(list(doc_id::VARCHAR) FILTER (doc_id % 97 = 0)) AS off FROM documents GROUP BY source)
    SELECT source, 'SEGMENT CONSISTENCY REPORT — ' || source || chr(10) || repeat('=', 60) || chr(10) || 'Files checked:        ' || n || chr(10) || 'Schema pass rate:     ' || round(100 * rate)::INT || '%' || chr(10) || 'Algorithm consistent: ' || CASE WHEN langs = 1 THEN 'True' ELSE 'False' END || chr(10)
    || 'Algorithms found:     [' || algs || ']' || chr(10) || 'Intent mismatches:    ' || CASE WHEN off IS NULL THEN 'none' ELSE '[' || array_to_string(off, ', ') || ']' END || chr(10) || chr(10) || 'VERDICT: ' || CASE WHEN rate >= 0.8 AND langs = 1 THEN 'READY' ELSE 'NOT READY' END AS report FROM r""",
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistency report of each problem as text; here a source is a problem, a document a file and a language an algorithm."""
    d = table(spark, sf_dir, "documents")
    checked = d.select("source", F.col("doc_id").cast("string").alias("file"), (F.col("doc_id") % 4 != 0).alias("passed"), F.col("lang").alias("algorithm"), (F.col("doc_id") % 97 == 0).alias("mismatch"))
    return P.consistency_report(checked, "source").select("source", "report")


@register("op_019_config_scan", "SELECT n_nationkey, 'model.name' AS name, '\"' || n_name || '\"' AS value FROM nation UNION ALL SELECT n_nationkey, 'model.size', n_regionkey::VARCHAR FROM nation UNION ALL SELECT n_nationkey, 'seed', n_nationkey::VARCHAR FROM nation")
def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested configurations as rows."""
    from gradewell.sources.paths import config_entries

    text = F.concat(F.lit('{"model": {"name": "'), "n_name", F.lit('", "size": '), "n_regionkey", F.lit('}, "seed": '), "n_nationkey", F.lit("}"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(config_entries(text)))


@register("op_021_folders", "SELECT unnest(['data', 'data/annotations', 'data/figures', 'data/hints', 'data/processed', 'data/raw', 'data/raw/solutions', 'data/raw/statements', 'data/raw/tests']) AS folder")
def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.sources.paths import make_folders

    root = files.shared_folder(spark)
    made = make_folders(spark, root)
    return spark.createDataFrame([(f.removeprefix(f"{root}/"),) for f in made if files.exists(spark, f)], "folder string")


@register(
    "op_024_paths",
    "SELECT doc_id, 'data/raw/statements/[PA] Tema ' || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END || ' 2021.pdf' AS statement, 'data/raw/solutions/2021_' || source AS solutions, 'adapter_ablation_anon' || doc_id || '_' || source AS stem FROM documents",
)
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.sources.paths import output_stem, solutions_folder, statement_path

    theme = F.when(F.col("doc_id") % 2 == 0, "tema1").otherwise("tema2")
    problem = F.concat(F.lit("2021_"), theme, F.lit("_"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", statement_path(F.lit("2021"), theme).alias("statement"), solutions_folder(problem).alias("solutions"), output_stem("adapter_ablation", F.concat(F.lit("anon"), F.col("doc_id").cast("string")), problem).alias("stem"))
