"""What becomes of model answers: annotations, segments, hints (OP-147 to 149, 14H, 094). Errors are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.contracts import LEVELS, robust_json, segment_violations, truncation_warnings, violations

#: The fields that an annotation takes from an answer, allowed gap levels, the most hints and kept characters of a bad answer.
ANNOTATION = "primary_concept string, concepts array<string>, difficulty string, expected_complexity string, common_pitfalls array<string>, title string, summary string, llm_confidence string"
GAP_LEVELS = ("intent", "function", "implementation")
MOST_HINTS, RAW_KEPT = 4, 300
#: What tells where a hint set came from.
FROM_SEGMENTS, CALL_FAILED, NOT_PARSED = "concept_segments", "concept_segments_llm_error", "concept_segments_parse_error"
HINTS = "hints array<struct<level: string, text: string>>, gap_codes struct<level: string, missing_concept: string>, rationale_short string, concepts_targeted array<string>"


def _quoted(items: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def annotations(answered: DataFrame, concepts: tuple[str, ...], aliases: dict[str, str]) -> DataFrame:
    """``answered`` (answer, error and others) with ``annotation`` and the first ``problem`` that it has; a failed call has no annotation.

    Concept names become ids (by their lower case; unknown ones stay), each once
    in order.
    """
    found = F.from_json("answer", ANNOTATION)
    known = F.create_map(*[F.lit(x) for alias, name in (aliases | {c: c for c in concepts}).items() for x in (alias, name)])
    to_id = lambda c: F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), c)
    ids, first = F.array_distinct(F.transform(found["concepts"], to_id)), to_id(found["primary_concept"])
    unknown = F.filter(ids, lambda c: ~c.isin(*concepts))
    kept = found.withField("concepts", ids).withField("primary_concept", first).withField("annotation_source", F.lit("llm"))
    problem = (
        F.when(F.col("answer").isNull(), F.concat(F.lit("LLM call failed: "), "error"))
        .when(found.isNull(), "LLM call failed: no JSON")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown concept ids: "), _quoted(unknown)))
        .when(F.coalesce(first, F.lit("")) != "", F.when(~first.isin(*concepts), F.concat(F.lit("unknown primary_concept: "), first)))
    )
    missing = F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "missing concepts")
    return answered.withColumns({"annotation": F.when(F.col("answer").isNotNull(), kept), "problem": F.coalesce(problem, missing)})


def extracted_segments(answered: DataFrame, context: int = 8192, budget: int = 5048) -> DataFrame:
    """``answered`` (answer, error, prompt_tokens, reply_tokens and others) with segments (JSON text), schema_errors, raw and warnings."""
    found, why = robust_json(F.col("answer"))
    failed, none = F.col("answer").isNull(), F.array().cast("array<string>")
    errors = F.when(failed, F.array(F.lit("llm_call_failed"))).when(found.isNull(), F.array(F.lit("json_parse_failed"))).otherwise(segment_violations(found))
    return answered.withColumns(
        {
            "segments": found,
            "schema_errors": errors,
            "error": F.when(failed, F.col("error")).when(found.isNull(), why),
            "raw": F.when(failed, "").when(found.isNull(), F.left("answer", F.lit(RAW_KEPT))).otherwise(F.col("answer")),
            "warnings": F.when(failed, none).otherwise(truncation_warnings(F.col("prompt_tokens"), F.col("reply_tokens"), F.lit(context), F.lit(budget))),
        }
    )


def hint_document_violations(document: Column) -> Column:
    """What is wrong with a hint document (JSON text): its gap codes, its list of hints, each hint."""
    d = F.from_json(document, HINTS)
    gap, hints = d["gap_codes"], d["hints"]
    filled = lambda text: F.trim(F.coalesce(text, F.lit(""))) != ""
    place = lambda i, rest: F.concat(F.lit("hints["), i.cast("string"), F.lit("]"), F.lit(rest))
    of_hint = lambda h, i: violations(
        F.when(~F.coalesce(h["level"].isin(*LEVELS), F.lit(False)), F.concat(place(i, ".level invalid: "), F.coalesce(h["level"], F.lit("None")))),
        F.when(~filled(h["text"]), place(i, ".text lipsă sau gol")),
    )
    whole = violations(
        F.when(gap.isNull(), "'gap_codes' lipsă"),
        F.when(gap.isNotNull() & ~F.coalesce(gap["level"].isin(*GAP_LEVELS), F.lit(False)), F.concat(F.lit("gap_codes.level invalid: "), F.coalesce(gap["level"], F.lit("None")))),
        F.when(gap.isNotNull() & ~filled(gap["missing_concept"]), "gap_codes.missing_concept lipsă sau gol"),
        F.when(hints.isNull(), "'hints' nu este o listă"),
        F.when(F.size(hints) == 0, "lista 'hints' este goală"),
        F.when(F.size(hints) > MOST_HINTS, F.concat(F.lit("prea multe hinturi: "), F.size(hints).cast("string"), F.lit(" (max 4)"))),
    )
    return F.concat(whole, F.coalesce(F.flatten(F.transform(hints, of_hint)), F.array().cast("array<string>")))


def hints_from_segments(answered: DataFrame) -> DataFrame:
    """``answered`` (answer, error and others) with hints, gap_codes, errors, rationale and the source tag that says what went wrong."""
    found, why = robust_json(F.col("answer"))
    failed, d = F.col("answer").isNull(), F.from_json(found, HINTS)
    source = F.when(failed, CALL_FAILED).when(found.isNull(), NOT_PARSED).otherwise(FROM_SEGMENTS)
    errors = F.when(failed, F.array(F.concat(F.lit("llm_error: "), "error"))).when(found.isNull(), F.array(F.concat(F.lit("parse_error: "), why))).otherwise(hint_document_violations(found))
    hints = F.coalesce(F.slice(d["hints"], 1, MOST_HINTS), F.from_json(F.lit('{"hints": []}'), HINTS)["hints"])
    return answered.withColumns({"hints": hints, "gap_codes": d["gap_codes"], "errors": errors, "rationale": F.coalesce(d["rationale_short"], F.lit("")), "source": source})


def generated(answered: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """``answered`` (answer and others) with hints, the concepts that are known, and violations; an answer that isn't JSON as a whole is one."""
    d = F.from_json("answer", HINTS)
    parses = F.try_parse_json("answer").isNotNull()
    none = F.from_json(F.lit('{"hints": [], "concepts_targeted": []}'), HINTS)
    return answered.withColumns(
        {
            "hints": F.when(parses, F.coalesce(d["hints"], none["hints"])).otherwise(none["hints"]),
            "concepts_targeted": F.when(parses, F.filter(F.coalesce(d["concepts_targeted"], none["concepts_targeted"]), lambda c: c.isin(*concepts))).otherwise(none["concepts_targeted"]),
            "violations": F.when(~F.coalesce(parses, F.lit(False)), F.array(F.lit("model_returned_non_json"))).otherwise(F.array().cast("array<string>")),
        }
    )


#: Where rows in the fixed layout say they come from, and what stands for a language and a verdict that aren't there.
SOURCE_TAG, LANGUAGE, VERDICT = "segments_silver_diff", "unknown", "WA"


def hint_rows(rows: DataFrame) -> DataFrame:
    """``rows`` in the thirteen columns of hint rows, with defaults for columns that are missing or null; rows without ``generated_hints`` are dropped.

    A row is valid if it has no ``hint_validation_errors``. Other columns go.
    """

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in rows.columns else default

    text, texts = F.lit(""), F.array().cast("array<string>")
    errors = given("hint_validation_errors", texts)
    plain = {c: given(c, text) for c in ("problem_id", "anon_id", "submission_name")}
    layout = plain | {
        "language": given("language", F.lit(LANGUAGE)),
        "verdict": given("verdict", F.lit(VERDICT)),
        "issues": given("issues", texts),
        "concepts_targeted": given("concepts_targeted", texts),
        "hints": F.col("generated_hints"),
        "source": F.lit(SOURCE_TAG),
        "embedding_similarity": given("embedding_similarity", F.lit(None).cast("double")),
        "passing_file": given("passing_file", text),
        "validator_passed": F.size(errors) == 0,
        "validator_violations": errors,
    }
    return rows.where(F.size("generated_hints") > 0).select(*[c.alias(k) for k, c in layout.items()])
