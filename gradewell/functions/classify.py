"""Column builders that classify rows (OP-041 to 059)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS_POINTS = 99.999
#: Greatest bytes of each size class.
SIZE_CLASSES = (("tiny", 200), ("small", 5_000), ("medium", 200_000), ("large", 5_000_000))
LARGEST_CLASS = "stress"
#: Words that mark a test as an edge case.
EDGE_WORDS = ("edge", "corner", "stress", "small", "big")
SIM_HIGH, SIM_MEDIUM = 0.97, 0.85
#: Verdicts in report order.
VERDICTS = ("OK", "WA", "TLE", "RE", "CE", "MLE", "OTHER")


def score_bucket(points: Column, least: float = PASS_POINTS) -> Column:
    return F.when(points >= least, "passing").otherwise("failing")


def size_class(n_bytes: Column) -> Column:
    return reduce(lambda c, s: c.when(n_bytes <= s[1], s[0]), SIZE_CLASSES[1:], F.when(n_bytes <= SIZE_CLASSES[0][1], SIZE_CLASSES[0][0])).otherwise(LARGEST_CLASS)


def discriminates(n_bytes: Column) -> Column:
    return F.when(n_bytes > 200_000, "complexity").otherwise("correctness")


def edge_case_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(EDGE_WORDS))


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, w: a | text.contains(w), words[1:], text.contains(words[0]))


def verdict(points: Column, issues: Column) -> Column:
    """By ordered substrings of all issues; a text with ``ce`` in any word is a compile error."""
    s = F.lower(F.array_join(F.coalesce(issues, F.array().cast("array<string>")), " "))
    return (
        F.when(points >= PASS_POINTS, "OK")
        .when(_has(s, "compile", "compilation", "ce"), "CE")
        .when(_has(s, "runtime", "segmentation"), "RE")
        .when(_has(s, "tle", "time limit"), "TLE")
        .when(_has(s, "mle", "memory limit"), "MLE")
        .when(_has(s, "wa") | (points < 100), "WA")
        .otherwise("OTHER")
    )


def verdict_strict(points: Column, issues: Column) -> Column:
    """The same with whole words, so that an exceeded limit isn't a compile error."""
    s = F.lower(F.array_join(F.coalesce(issues, F.array().cast("array<string>")), " "))

    def word(*words: str) -> Column:
        return s.rlike(r"(^|[^a-z0-9_])(" + "|".join(words) + r")([^a-z0-9_]|$)")

    return (
        F.when(points >= PASS_POINTS, "OK")
        .when(word("compile", "compilation", "ce"), "CE")
        .when(word("runtime", "segmentation"), "RE")
        .when(word("tle", "time limit"), "TLE")
        .when(word("mle", "memory limit"), "MLE")
        .when(word("wa") | (points < 100), "WA")
        .otherwise("OTHER")
    )


def verdict_report(points: Column, issues: Column) -> Column:
    """The report's variant: exactly 100 points pass, and a wrong answer is no compile error."""
    s = F.lower(F.array_join(F.coalesce(issues, F.array().cast("array<string>")), " "))
    return (
        F.when(points == 100, "OK")
        .when(_has(s, "compile", "compilation", "ce") & ~_has(s, "wa"), "CE")
        .when(_has(s, "runtime", "segmentation", "re "), "RE")
        .when(_has(s, "tle", "time limit", "timeout"), "TLE")
        .when(_has(s, "mle", "memory limit"), "MLE")
        .when(_has(s, "wa") | (points < 100), "WA")
        .otherwise("OTHER")
    )


def dominance(languages: Column) -> Column:
    """One language or a mix."""
    return F.when(F.size(languages) == 1, F.element_at(languages, 1)).otherwise("mixed")


def similarity_bucket(sim: Column) -> Column:
    return F.when(sim >= SIM_HIGH, "high").when(sim >= SIM_MEDIUM, "medium").otherwise("low")


def hint_level(gap_level: Column, sim: Column) -> Column:
    return F.when(gap_level == "intent", "macro").when(gap_level == "function", "structural").when(sim >= SIM_HIGH, "very_specific").when(sim >= SIM_MEDIUM, "specific").otherwise("structural")


def closeness(sim: Column) -> Column:
    """How near two solutions are; unknown counts as far."""
    s = F.coalesce(sim, F.lit(0.0))
    return F.when(s >= 0.98, "almost identical").when(s >= 0.90, "similar").otherwise("different")


def float_or(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def text_or(text: Column, default: str) -> Column:
    """Null and empty alike take the default."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def submitted_at(name: Column) -> Column:
    """Time in a submission's name, yyyy.mm.dd__hh.mm.ss; null if there is none or it isn't a time."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{4}\.\d{2}\.\d{2}__\d{2}\.\d{2}\.\d{2})", 1), F.lit("")), F.lit("yyyy.MM.dd__HH.mm.ss"))


SOLUTION_FILE = r"^(.+)_(\d+(?:\.\d+)?)\.(cpp|java)$"


def solution_file(name: Column) -> Column:
    """anon, score and ext of a solution's file name; null if it isn't one."""
    parts = [F.regexp_extract(name, SOLUTION_FILE, k) for k in (1, 2, 3)]
    return F.when(name.rlike(SOLUTION_FILE), F.struct(parts[0].alias("anon"), parts[1].try_cast("double").alias("score"), parts[2].alias("ext")))


def score_in_name(name: Column, default: float | None = None) -> Column:
    found = F.nullif(F.regexp_extract(name, r"_(\d+(?:\.\d+)?)\.", 1), F.lit("")).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def leading_integer(text: Column) -> Column:
    """The integer that begins the first 128 characters."""
    return F.nullif(F.regexp_extract(F.left(text, F.lit(128)), r"^\s*(-?\d+)", 1), F.lit("")).try_cast("bigint")


def is_bootstrap(variant: Column) -> Column:
    return variant.startswith("bootstrap")
