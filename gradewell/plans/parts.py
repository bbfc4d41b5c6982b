"""Queries for parts of long texts (OP-12D to 12I) on statements made from whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import statements as S
from gradewell.plans.catalog import register
from gradewell.session import table

#: A contents entry, the headers of three tasks with their headings, and where a task's files are named.
CONTENTS = "1 problema 1: alfa\n1.1 Enunț . . . . 2\n"
FIRST, SECOND, THIRD = "1 problema 1 (30p): alfa\n1.1 Enunț\n", "\nProblema 2 – beta\n2.1 Enunt\nfișierul sum.in ", "\n3Bonus gama\n3.1 Enunț\n"
HEAD = CONTENTS + "." * 600
#: How much of each header its pattern takes, from the task's start.
TAKEN = (len("1 problema 1 (30p):"), len("Problema 2 –"), len("3Bonus"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a document's whole text as the body of each of three tasks, behind a table of contents."""
    body = F.coalesce("text", F.lit(""))
    whole = F.concat(F.lit(HEAD + FIRST), body, F.lit(SECOND), body, F.lit(THIRD), body)
    return table(spark, sf_dir, "documents").select("doc_id", whole.alias("text"))


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


_STARTS_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS b FROM documents),
t AS (SELECT doc_id, '{HEAD}{FIRST}' || b || '{SECOND}' || b || '{THIRD}' || b AS text, [{len(HEAD)}, {len(HEAD + FIRST)} + length(b) + 1, {len(HEAD + FIRST + SECOND)} + 2 * length(b) + 1] AS starts FROM d),
k AS (SELECT doc_id, text, unnest([1, 2, 3]) AS number, unnest(starts) AS start FROM t),
sections AS (SELECT doc_id, text, number, start, substr(text, start + [{', '.join(map(str, TAKEN))}][number] + 1, {S.HEADING_WITHIN}) AS w FROM k),
found AS (SELECT * FROM sections WHERE regexp_matches(w, number || '\.1\s+Enun') AND regexp_matches(w, '(?i)Enun[^\n]*\s+[A-Za-zăâîșțĂÂÎȘȚ]') AND NOT regexp_matches(w, 'Enun[^\n]*\. \.')),
chunks AS (SELECT doc_id, number, {_strip("substr(text, start + 1, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) - start)")} AS chunk FROM found)
"""


@register("op_12e_sections", _STARTS_SQL + "SELECT doc_id, start::BIGINT AS start, number::BIGINT AS number FROM found")
def find_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of every whole text; a header whose heading isn't followed by prose is none."""
    return S.with_sections(statements(spark, sf_dir), "doc_id")


@register("op_12f_section_chunk", _STARTS_SQL + "SELECT doc_id, md5(chunk) AS v, length(chunk) AS n_chars FROM chunks WHERE number = 2")
def section_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir).select("doc_id", S.chunk_in_sections(F.col("text"), F.lit("sum")).alias("chunk"))
    return rows.select("doc_id", F.md5("chunk").alias("v"), F.length("chunk").cast("long").alias("n_chars"))


def _anchored(body: Column) -> Column:
    """A text that names a file, with the heading of a task before it in every second document."""
    heading = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("\n5.1 Enunț "), body)).otherwise(F.lit(""))
    return F.concat(body, heading, F.lit(" path.out "), body)


_ANCHOR_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS b FROM documents),
a AS (SELECT doc_id, b || CASE WHEN doc_id % 2 = 1 THEN chr(10) || '5.1 Enunț ' || b ELSE '' END AS before, b FROM d),
t AS (SELECT doc_id, before || ' path.out ' || b AS text, length(before) + 1 AS anchor, greatest(0, length(before) + 1 - {S.LOOK_BACK}) AS low, length(b) AS n FROM a),
s AS (SELECT *, CASE WHEN doc_id % 2 = 1 AND n >= low THEN n WHEN doc_id % 2 = 1 AND n + 1 = low THEN low END AS start FROM t),
chunks AS (SELECT doc_id, {_strip(f"CASE WHEN start IS NULL THEN substr(text, greatest(0, anchor - {S.BEFORE}) + 1, least(anchor, {S.BEFORE}) + {S.AFTER}) ELSE substr(text, start + 1, {S.MOST}) END")} AS chunk FROM s)
"""


@register("op_12g_anchor_chunk", _ANCHOR_SQL + "SELECT doc_id, md5(chunk) AS v, length(chunk) AS n_chars FROM chunks")
def anchor_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", S.chunk_at_anchor(_anchored(F.coalesce("text", F.lit(""))), F.lit("path")).alias("chunk"))
    return rows.select("doc_id", F.md5("chunk").alias("v"), F.length("chunk").cast("long").alias("n_chars"))


_NO_WORD = r"[^\p{L}\p{N}_]"
_MENTION_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS b FROM documents),
one AS (SELECT doc_id, b, regexp_matches(b, '(?i)(^|{_NO_WORD})de({_NO_WORD}|$)') AS has, length(regexp_extract(b, '(?is)^((?:.*?{_NO_WORD})??)de(?:{_NO_WORD}|$)', 1)) AS p FROM d),
two AS (SELECT *, substr(b, p + 3) AS rest, regexp_matches(substr(b, p + 3), '(?i){_NO_WORD}de({_NO_WORD}|$)') AS again FROM one),
chunks AS (SELECT doc_id, CASE WHEN has THEN {_strip(f"substr(b, CASE WHEN again THEN p + 2 + length(regexp_extract(rest, '(?is)^(.*?{_NO_WORD})de(?:{_NO_WORD}|$)', 1)) ELSE p END + 1, {S.MENTION})")} END AS chunk FROM two)
"""


@register("op_12h_second_mention", _MENTION_SQL + "SELECT doc_id, md5(chunk) AS v FROM chunks")
def second_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.second_mention(F.coalesce("text", F.lit("")), F.lit("de"))).alias("v"))


def _cte(sql: str, kind: str) -> str:
    """A query's chunks as rows of one kind."""
    columns = {"section": "number = 2 AND doc_id % 3 = 0", "anchor": "doc_id % 3 = 1", "mention": "doc_id % 3 = 2"}[kind]
    return f"({sql} SELECT doc_id, md5(chunk) AS v FROM chunks WHERE {columns})"


@register("op_12i_chunk_cascade", " UNION ALL ".join(_cte(q, k) for q, k in ((_STARTS_SQL, "section"), (_ANCHOR_SQL, "anchor"), (_MENTION_SQL, "mention"))))
def chunk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By task, around the file's mention, or from the second mention: each in a third of the documents."""
    body, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    whole = F.when(kind == 0, F.concat(F.lit(HEAD + FIRST), body, F.lit(SECOND), body, F.lit(THIRD), body)).when(kind == 1, _anchored(body)).otherwise(body)
    name = F.when(kind == 0, "sum").when(kind == 1, "path").otherwise("de")
    rows = table(spark, sf_dir, "documents").select("doc_id", whole.alias("t"), name.alias("name"))
    return rows.select("doc_id", F.md5(S.cascade(F.col("t"), F.col("name"))).alias("v"))


NAMES = ("the", "with", "und", "des", "que")


@register(
    "op_12d_longest_chunks",
    rf"""WITH p AS (SELECT doc_id, length(text) AS n, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS k FROM documents WHERE text <> ''),
    q AS (SELECT doc_id, n, lower(piece) AS name, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start FROM p),
    m AS (SELECT doc_id, name, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) - start AS size FROM q WHERE name IN {NAMES})
    SELECT doc_id, name, max(size)::BIGINT AS n_chars FROM m GROUP BY ALL""",
)
def longest_chunks(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    found = S.longest_chunks(table(spark, sf_dir, "documents"), ["doc_id"], list(names))
    return found.select("doc_id", "name", F.length("chunk").cast("long").alias("n_chars"))
