"""Prompt rendering and chat samples (OP-12M, 12N, 12P, 14D), in wording of our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import bullets, truncate

SYSTEM = "You help a student to find the next step. Answer with JSON: a list of one to four hints, each with a level and a short text. Never write code."
STATEMENT_CHARS, CODE_CHARS = 8000, 5000
#: Share of files with a valid record from which a problem is ready.
READY_RATE = 0.8
#: Blocks of a prompt in their order; a variant leaves out one of them.
BLOCKS = ("task", "concepts", "pitfalls", "verdict", "code", "reference", "diff")
VARIANTS = {"full": (), "no_pitfalls": ("pitfalls",), "no_concepts": ("concepts",), "no_reference": ("reference",), "no_diff": ("diff",)}


def block(title: str, body: Column) -> Column:
    """A titled part of a prompt; nothing if it is empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body))


def user_prompt(parts: dict[str, Column], variant: str = "full") -> Column:
    """The given parts in fixed order, without those that the variant leaves out."""
    left_out = VARIANTS[variant]
    return F.concat_ws("\n\n", *[block(name.capitalize(), parts[name]) for name in BLOCKS if name in parts and name not in left_out])


def all_variants(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """``rows`` once for each variant, with ``variant`` and ``prompt``."""
    made = F.array(*[F.struct(F.lit(v).alias("variant"), user_prompt(parts, v).alias("prompt")) for v in VARIANTS])
    return rows.withColumn("__p", F.explode(made)).select(*rows.columns, "__p.variant", "__p.prompt")


def standard_parts(statement: Column, concepts: Column, code: Column, verdict: Column) -> dict[str, Column]:
    return {"task": truncate(statement, STATEMENT_CHARS, "\n[cut]"), "concepts": bullets(concepts), "verdict": verdict, "code": truncate(code, CODE_CHARS, "\n[cut]")}


def chat_sample(system: Column, user: Column, hints: Column, **meta: Column) -> Column:
    """One training sample: system, user, assistant (the hints as JSON) and what it was made from."""
    return F.struct(system.alias("system"), user.alias("user"), F.to_json(F.struct(hints.alias("hints"))).alias("assistant"), F.struct(*[c.alias(k) for k, c in meta.items()]).alias("meta"))


def consistency_report(checked: DataFrame, problem: str) -> DataFrame:
    """``checked`` (problem, file, passed, algorithm, mismatch) -> problem, report: what a reader is told of each problem's files."""
    names = lambda c: F.array_join(F.array_sort(c), ", ")
    found = checked.groupBy(problem).agg(
        F.count("*").alias("n"),
        F.avg(F.col("passed").cast("double")).alias("rate"),
        F.collect_set("algorithm").alias("algorithms"),
        F.collect_list(F.when(F.col("mismatch"), F.col("file"))).alias("off"),
    )
    one = F.size("algorithms") == 1
    lines = {
        "Files checked:        ": F.col("n").cast("string"),
        "Schema pass rate:     ": F.concat(F.round(100 * F.col("rate")).cast("int").cast("string"), F.lit("%")),
        "Algorithm consistent: ": F.when(one, "True").otherwise("False"),
        "Algorithms found:     ": F.concat(F.lit("["), names(F.col("algorithms")), F.lit("]")),
        "Intent mismatches:    ": F.when(F.size("off") == 0, "none").otherwise(F.concat(F.lit("["), names(F.col("off")), F.lit("]"))),
    }
    verdict = F.when((F.col("rate") >= READY_RATE) & one, "READY").otherwise("NOT READY")
    head = F.concat(F.lit("SEGMENT CONSISTENCY REPORT — "), F.col(problem), F.lit("\n" + "=" * 60))
    return found.select(problem, F.concat_ws("\n", head, *[F.concat(F.lit(k), v) for k, v in lines.items()], F.lit(""), F.concat(F.lit("VERDICT: "), verdict)).alias("report"))
