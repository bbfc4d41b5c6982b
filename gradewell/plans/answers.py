"""Queries around model calls (OP-014, 015, 12M, 12N, 141 to 149, 14A, 14D, 14F to 14H), on prompts made from conversations.

The stand-ins answer from a number that follows from the prompt, so SQL can say what they answer.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import text as T
from gradewell.operators import annotate as A
from gradewell.operators import prompts as P
from gradewell.operators import providers as M
from gradewell.plans.catalog import register
from gradewell.plans.checks import SEGMENTS
from gradewell.plans.scalars import HINT_SETS_SQL, hint_sets
from gradewell.session import table


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each conversation."""
    return hint_sets(spark, sf_dir).select("conv_id", F.lit(P.SYSTEM).alias("system"), P.user_prompt({"task": F.col("statement")}).alias("user"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(x: str) -> str:
    return rf"len(list_filter(string_split_regex({x}, '\s+'), lambda wd: wd <> ''))"


def _number(x: str) -> str:
    return f"('0x' || left(md5({x}), 8))::BIGINT"


ASKED_SQL = (
    HINT_SETS_SQL.rstrip()
    + f""", asked AS (SELECT conv_id, {_literal(P.SYSTEM)} AS s, CASE WHEN statement <> '' THEN '## Task' || chr(10) || statement ELSE '' END AS u FROM hint_sets),
n AS (SELECT conv_id, s, u, {_number("s || u")} AS n, {_words("s || ' ' || u")} AS prompt_tokens FROM asked)
"""
)
_HINT_SQL = """'{"hints": [{"level": "macro", "text": "Look at part ' || n % 97 || ' of the task again."}]}'"""


@register("op_144_chat", ASKED_SQL + f"SELECT conv_id, CASE WHEN n % 5 <> 0 THEN {_HINT_SQL} END AS answer, CASE WHEN n % 5 = 0 THEN 'ConnectionError: no answer' END AS error FROM n")
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer or an error for each row, after retries."""
    return M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(fail_every=5), pause=0).select("conv_id", "answer", "error")


@register("op_145_token_counts", ASKED_SQL + f"SELECT conv_id, CASE WHEN n % 5 = 0 THEN 3 ELSE 1 END AS attempts, CASE WHEN n % 5 = 0 THEN 0 ELSE prompt_tokens END AS prompt_tokens, CASE WHEN n % 5 = 0 THEN 0 ELSE {_words(_HINT_SQL)} END AS reply_tokens FROM n")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(fail_every=5), pause=0)
    return found.select("conv_id", "attempts", "prompt_tokens", "reply_tokens")


@register("op_146_format_fallback", ASKED_SQL + f"SELECT conv_id, CASE WHEN n % 7 <> 0 THEN {_HINT_SQL} END AS answer, CASE WHEN n % 7 <> 0 THEN ['json', 'free', 'thinking', 'json'][n % 4 + 1] END AS via, CASE WHEN n % 7 = 0 THEN 'ConnectionError: no answer' END AS error FROM n")
def format_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chat_json(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(fail_every=7, moods=True)).select("conv_id", "answer", "via", "error")


@register(
    "op_14a_error_isolation",
    ASKED_SQL + "SELECT CASE WHEN n % 5 = 0 THEN 'ConnectionError: no answer' WHEN n % 3 = 0 THEN 'answer is no JSON' ELSE 'valid' END AS outcome, count(*) AS n, min(conv_id) AS first FROM n GROUP BY 1",
)
def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows and dead letters, with what is wrong with these."""
    answer = lambda n: "no JSON" if n % 3 == 0 else M.one_hint(n)
    good, bad = M.route(M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(answer, fail_every=5), pause=0))
    outcomes = good.select("conv_id", F.lit("valid").alias("outcome")).unionByName(bad.select("conv_id", F.col("error").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


# --- annotations, segments, hints

CONCEPTS, ALIASES = ("arrays", "graphs", "greedy", "dp"), {"vectori": "arrays", "grafuri": "graphs"}
POOL = ("Vectori", "arrays", "grafuri", "no_such", "dp")


def annotation_answer(n: int) -> str:
    concepts = [POOL[n % 5], POOL[n // 5 % 5]] if n % 11 else []
    return json.dumps({"concepts": concepts, "primary_concept": POOL[n // 25 % 5], "difficulty": ("easy", "medium", "hard")[n % 3], "title": f"T{n % 100}"})


def _named(x: str) -> str:
    pool = "[" + ", ".join(map(_literal, POOL)) + "]"
    return f"(CASE lower({pool}[{x} % 5 + 1]) WHEN 'vectori' THEN 'arrays' WHEN 'grafuri' THEN 'graphs' ELSE {pool}[{x} % 5 + 1] END)"


@register(
    "op_147_annotations",
    ASKED_SQL
    + f""", a AS (SELECT *, {_named("n")} AS x, {_named("n // 5")} AS y, {_named("n // 25")} AS first FROM n),
    b AS (SELECT *, CASE WHEN n % 11 = 0 THEN [] WHEN x = y THEN [x] ELSE [x, y] END AS ids, n % 7 = 0 AS failed FROM a)
    SELECT conv_id, CASE WHEN NOT failed THEN array_to_string(ids, '|') END AS concepts, CASE WHEN NOT failed THEN first END AS primary_concept, CASE WHEN NOT failed THEN ['easy', 'medium', 'hard'][n % 3 + 1] END AS difficulty,
    CASE WHEN failed THEN 'LLM call failed: ConnectionError: no answer' WHEN list_contains(ids, 'no_such') THEN 'unknown concept ids: [''no_such'']' WHEN first = 'no_such' THEN 'unknown primary_concept: no_such' WHEN len(ids) = 0 THEN 'missing concepts' END AS problem FROM b""",
)
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(annotation_answer, fail_every=7), pause=0)
    found = A.annotations(rows, CONCEPTS, ALIASES)
    return found.select("conv_id", F.array_join("annotation.concepts", "|").alias("concepts"), "annotation.primary_concept", "annotation.difficulty", "problem")


def segment_answer(n: int) -> str:
    return "no braces" if n % 9 == 0 else "so {broken" + "}" if n % 9 == 1 else f"Here:\n```json\n{SEGMENTS[n % 4]}\n```"


@register(
    "op_148_segments",
    ASKED_SQL
    + f""", a AS (SELECT *, [{', '.join(map(_literal, SEGMENTS))}][n % 4 + 1] AS doc FROM n),
    b AS (SELECT *, CASE WHEN n % 9 = 0 THEN 'no braces' WHEN n % 9 = 1 THEN 'so {{broken}}' ELSE 'Here:' || chr(10) || '```json' || chr(10) || doc || chr(10) || '```' END AS answer FROM a),
    c AS (SELECT *, {_words("answer")} AS reply_tokens FROM b)
    SELECT conv_id, CASE WHEN n % 5 = 0 THEN 'llm_call_failed' WHEN n % 9 < 2 THEN 'json_parse_failed' ELSE ['', 'missing field: function.complexity', 'wrong type: intent.matches_problem (got str, expected bool)', 'invalid confidence in intent: ''sure'''][n % 4 + 1] END AS schema_errors,
    CASE WHEN n % 5 = 0 THEN 'ConnectionError: no answer' WHEN n % 9 = 0 THEN 'no JSON found in output' WHEN n % 9 = 1 THEN 'json parse failed' END AS error, CASE WHEN n % 5 = 0 THEN '' ELSE answer END AS raw, CASE WHEN n % 5 <> 0 AND n % 9 > 1 THEN doc END AS segments,
    CASE WHEN n % 5 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN prompt_tokens > 60 - 4 THEN 'prompt=' || prompt_tokens || 'tok > num_ctx(60) − num_predict(4)=56tok → prompt truncated by Ollama' END, CASE WHEN reply_tokens >= 4 THEN 'output=' || reply_tokens || 'tok hit num_predict cap (4) → JSON likely truncated' END], lambda x: x IS NOT NULL), ';') END AS warnings FROM c""",
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(segment_answer, fail_every=5), pause=0)
    found = A.extracted_segments(rows, context=60, budget=4)
    return found.select("conv_id", F.array_join("schema_errors", ";").alias("schema_errors"), "error", "raw", "segments", F.array_join("warnings", ";").alias("warnings"))


def hints_answer(n: int) -> str:
    if n % 10 == 9:
        return "nothing to say"
    hints = [{"level": "vague" if n % 8 == 1 and k == 1 else "macro", "text": " " if n % 8 == 2 and k == 0 else f"hint {k}"} for k in range(n % 6)]
    return json.dumps({"hints": hints, "gap_codes": {"level": ("intent", "function", "implementation", "other")[n % 4], "missing_concept": "" if n % 3 == 0 else "loops"}, "rationale_short": f"r{n % 13}"})


_HINT_ERRORS_SQL = """list_filter([CASE WHEN n % 4 = 3 THEN 'gap_codes.level invalid: other' END, CASE WHEN n % 3 = 0 THEN 'gap_codes.missing_concept lipsă sau gol' END, CASE WHEN n % 6 = 0 THEN 'lista ''hints'' este goală' END,
    CASE WHEN n % 6 = 5 THEN 'prea multe hinturi: 5 (max 4)' END, CASE WHEN n % 8 = 1 AND n % 6 > 1 THEN 'hints[1].level invalid: vague' END, CASE WHEN n % 8 = 2 AND n % 6 > 0 THEN 'hints[0].text lipsă sau gol' END], lambda x: x IS NOT NULL)"""


@register(
    "op_149_hints_from_segments",
    ASKED_SQL
    + f"""SELECT conv_id, CASE WHEN n % 7 = 0 OR n % 10 = 9 THEN 0 ELSE least(n % 6, 4) END AS n_hints, CASE WHEN n % 7 = 0 OR n % 10 = 9 THEN NULL ELSE ['intent', 'function', 'implementation', 'other'][n % 4 + 1] END AS gap_level,
    CASE WHEN n % 7 = 0 THEN 'llm_error: ConnectionError: no answer' WHEN n % 10 = 9 THEN 'parse_error: no JSON found in output' ELSE array_to_string({_HINT_ERRORS_SQL}, ';') END AS errors, CASE WHEN n % 7 = 0 OR n % 10 = 9 THEN '' ELSE 'r' || n % 13 END AS rationale,
    CASE WHEN n % 7 = 0 THEN 'concept_segments_llm_error' WHEN n % 10 = 9 THEN 'concept_segments_parse_error' ELSE 'concept_segments' END AS source FROM n""",
)
def hints_from_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.hints_from_segments(M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(hints_answer, fail_every=7), pause=0))
    return found.select("conv_id", F.size("hints").alias("n_hints"), F.col("gap_codes.level").alias("gap_level"), F.array_join("errors", ";").alias("errors"), "rationale", "source")


@register("op_094_hint_document", ASKED_SQL + f"SELECT conv_id, CASE WHEN n % 10 = 9 THEN '''gap_codes'' lipsă;''hints'' nu este o listă' ELSE array_to_string({_HINT_ERRORS_SQL}, ';') END AS v FROM n")
def hint_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap codes, the list of hints and each hint, of documents that a stand-in wrote."""
    rows = M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(lambda n: "{}" if n % 10 == 9 else hints_answer(n)), pause=0)
    return rows.select("conv_id", F.array_join(A.hint_document_violations(F.col("answer")), ";").alias("v"))


def generated_answer(n: int) -> str:
    return "I can't" if n % 6 == 0 else json.dumps({"hints": [{"level": "macro", "text": f"t{n % 50}"}], "concepts_targeted": [POOL[n % 5], "dp"]})


@register(
    "op_14h_generate",
    ASKED_SQL + """SELECT conv_id, CASE WHEN n % 6 = 0 THEN '' ELSE 't' || n % 50 END AS hints, CASE WHEN n % 6 = 0 THEN '' ELSE ['dp', 'arrays|dp', 'dp', 'dp', 'dp|dp'][n % 5 + 1] END AS concepts, CASE WHEN n % 6 = 0 THEN 'model_returned_non_json' ELSE '' END AS violations FROM n""",
)
def generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.generated(M.chat(asked(spark, sf_dir), "system", "user", lambda: M.EchoChat(generated_answer), pause=0), CONCEPTS)
    return found.select("conv_id", F.array_join(F.transform("hints", lambda h: h["text"]), "|").alias("hints"), F.array_join("concepts_targeted", "|").alias("concepts"), F.array_join("violations", "|").alias("violations"))


def _ids(x: str) -> str:
    return rf"list_transform(list_filter(string_split_regex({x}, '\s+'), lambda wd: wd <> ''), lambda wd: ('0x' || left(md5(wd), 8))::BIGINT % 50000)"


@register("op_14g_inference_ids", ASKED_SQL + f"SELECT conv_id, array_to_string({_ids(chr(39) + '<system> ' + chr(39) + ' || s || ' + chr(39) + ' <user> ' + chr(39) + ' || u || ' + chr(39) + ' <assistant>' + chr(39))}, ' ') AS ids FROM n")
def inference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template output of every shape, normalised; an option that the template doesn't take is left out."""
    rows, shapes = asked(spark, sf_dir), ("flat", "mapping", "nested")
    made = [rows.where(F.col("conv_id") % 3 == k).select("conv_id", M.inference_ids("system", "user", lambda shape=shape: M.WordTemplate(shape)).alias("ids")) for k, shape in enumerate(shapes)]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("conv_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


# --- embeddings

_VECTOR_SQL = "(SELECT item_id, text, list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS v FROM benchmark)"
_UNIT_SQL = "array_to_string(list_transform(v, lambda x: round(1e6 * x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12))::BIGINT), ' ')"


def _shown(embedding: str):
    return F.array_join(F.transform(embedding, lambda x: F.round(x * 1e6).cast("long").cast("string")), " ")


@register("op_141_embeddings", f"SELECT item_id, {_UNIT_SQL} AS v FROM {_VECTOR_SQL}")
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.embed(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", M.LetterEmbedding)
    return rows.select("item_id", _shown("embedding").alias("v"))


@register("op_142_embedding_cache", f"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '7' ELSE {_UNIT_SQL} END AS v, item_id % 2 = 1 AS is_new FROM {_VECTOR_SQL}")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts are in the cache, under vectors that only the cache can have."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    cache = rows.where("item_id % 2 = 0").select(T.content_key(F.col("text")).alias("content_key"), F.array(F.lit(7e-6)).alias("embedding")).distinct()
    found, new = M.embed_cached(rows, "text", cache, M.LetterEmbedding)
    known = new.select(F.col("content_key").alias("k"), F.lit(True).alias("is_new"))
    return found.withColumn("k", T.content_key(F.col("text"))).join(known, "k", "left").select("item_id", _shown("embedding").alias("v"), F.coalesce("is_new", F.lit(False)).alias("is_new"))


@register("op_143_sentence_embeddings", f"SELECT turn, conv_id, CASE WHEN conv_id % 2 = 0 THEN {_UNIT_SQL} END AS v FROM (SELECT conv_id, turn, list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS v FROM conversations)")
def sentence_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of a batch once; null where there is no provider."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    some, none = M.embed(rows.where("conv_id % 2 = 0"), "text", M.LetterEmbedding), M.embed(rows.where("conv_id % 2 = 1"), "text", lambda: None)
    return some.unionByName(none).select("conv_id", "turn", _shown("embedding").alias("v"))


# --- documents as text

_PLAIN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\s*>', ' ', 'g'), '(?is)<style.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@register("op_014_statement_text", f"SELECT page_id, md5({_PLAIN_SQL}) AS v FROM pages")
def statement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as text, here pages without their markup."""
    plain = F.col("html")
    for pattern in (r"(?is)<script.*?</script\s*>", r"(?is)<style.*?</style\s*>", r"<[^>]*>", r"\s+"):
        plain = F.regexp_replace(plain, pattern, " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(plain)).alias("v"))


class MarkupText:
    """Stand-in parser: markup is taken off; a document that isn't markup can't be read."""

    def text(self, data: bytes) -> str:
        import re

        source = data.decode("utf-8")
        if not source.lstrip().startswith("<"):
            raise ValueError("no markup")
        for pattern in (r"(?is)<script.*?</script\s*>", r"(?is)<style.*?</style\s*>", r"<[^>]*>", r"[ \t\n\f\r]+"):
            source = re.sub(pattern, " ", source)
        return source.strip(" ")


@register("op_015_parsed_documents", f"SELECT page_id, md5(CASE WHEN page_id % 5 = 0 THEN '' ELSE {_PLAIN_SQL} END) AS v FROM pages")
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a parser behind an interface; what it can't read is empty."""
    html = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("%broken "), "html")).otherwise(F.col("html"))
    files = table(spark, sf_dir, "pages").select("page_id", F.encode(html, "UTF-8").alias("content"))
    return M.document_texts(files, "content", MarkupText).select("page_id", F.md5("text").alias("v"))


# --- prompts and samples


@register("op_12m_prompts", HINT_SETS_SQL + "SELECT conv_id, '## Task' || chr(10) || CASE WHEN length(statement) > 8000 THEN left(statement, 8000) || chr(10) || '[cut]' ELSE statement END AS prompt FROM hint_sets WHERE statement <> ''")
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    parts = P.standard_parts(F.col("statement"), F.array().cast("array<string>"), none, none)
    return hint_sets(spark, sf_dir).where("statement <> ''").select("conv_id", P.user_prompt(parts).alias("prompt"))


@register(
    "op_12n_prompt_variants",
    HINT_SETS_SQL
    + """SELECT conv_id, v AS variant, concat_ws(chr(10) || chr(10), CASE WHEN statement <> '' THEN '## Task' || chr(10) || statement END, CASE WHEN v <> 'no_concepts' THEN '## Concepts' || chr(10) || '- arrays' END, CASE WHEN v <> 'no_pitfalls' THEN '## Pitfalls' || chr(10) || '- bounds' END,
    CASE WHEN v <> 'no_reference' THEN '## Reference' || chr(10) || 'turns: ' || n_turns END, CASE WHEN v <> 'no_diff' THEN '## Diff' || chr(10) || '+' || conv_id END) AS prompt FROM hint_sets, (VALUES ('full'), ('no_pitfalls'), ('no_concepts'), ('no_reference'), ('no_diff')) a(v)""",
)
def prompt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"task": F.col("statement"), "concepts": F.lit("- arrays"), "pitfalls": F.lit("- bounds"), "reference": F.concat(F.lit("turns: "), "n_turns"), "diff": F.concat(F.lit("+"), "conv_id")}
    return P.all_variants(hint_sets(spark, sf_dir), parts).select("conv_id", "variant", "prompt")


@register(
    "op_14d_chat_samples",
    HINT_SETS_SQL + f"SELECT conv_id, {_literal(P.SYSTEM)} AS system, statement AS user, to_json({{'hints': list_transform(hints, lambda h: {{'level': h.level, 'text': h.text}})}})::VARCHAR AS assistant FROM hint_sets WHERE len(hints) > 0",
)
def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hint_sets(spark, sf_dir).where(F.size("hints") > 0)
    sample = P.chat_sample(F.lit(P.SYSTEM), F.col("statement"), F.transform("hints", lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"))), problem_id=F.col("conv_id"))
    return rows.select("conv_id", sample.alias("s")).select("conv_id", "s.system", "s.user", "s.assistant")


@register(
    "op_14f_training_rows",
    HINT_SETS_SQL.rstrip()
    + f""", t AS (SELECT conv_id, {_ids("statement")} AS p, {_ids("coalesce(hints[1].text, '')")} AS t FROM hint_sets)
    SELECT conv_id, array_to_string((p || t)[-128:], ' ') AS ids, array_to_string((list_transform(p, lambda x: -100) || t)[-128:], ' ') AS labels FROM t""",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = hint_sets(spark, sf_dir).select(F.col("conv_id").alias("sample_id"), F.col("statement").alias("prompt"), F.coalesce(F.try_element_at("hints", F.lit(1))["text"], F.lit("")).alias("target"))
    rows = M.training_rows(samples, M.HashTokenizer, 128)
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select(F.col("sample_id").alias("conv_id"), shown("input_ids").alias("ids"), shown("labels").alias("labels"))


