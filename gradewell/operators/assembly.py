"""From rows to a data set: problems with enough solutions, two sources at a ratio, splits and their statistics (OP-082, 11A, 11E, 11H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.pairing import seeded
from gradewell.operators.ranks import running
from gradewell.operators.selection import first_n, hash_key
from gradewell.operators.splits import grouped_split

#: Fixed value: solutions that a problem needs.
MIN_SOLUTIONS = 30
SPLITS = ("train", "val", "test")


def problem_decisions(rows: DataFrame, problems: DataFrame, least: int = MIN_SOLUTIONS) -> DataFrame:
    """Which of ``problems`` (problem_id, n_solutions, languages array) stay: problem_id, n_solutions, n_feedback, kept, reason, language_dominant.

    n_feedback counts the problem's ``rows``. A problem without a number of
    solutions has none; one in several rows counts with its most. The dominant
    language is cpp or java where it is the only one, else mixed.
    """
    feedback = rows.groupBy(F.col("problem_id").alias("__p")).agg(F.count("*").alias("n_feedback"))
    one = problems.where("problem_id IS NOT NULL").groupBy("problem_id").agg(F.max(F.struct(F.coalesce("n_solutions", F.lit(0)).alias("n"), "languages")).alias("x"))
    found = one.join(feedback, F.col("problem_id") == F.col("__p"), "left").withColumn("n", F.col("x.n"))
    only = F.when(F.size("x.languages") == 1, F.col("x.languages")[0])
    kept = F.col("n") >= least
    return found.select(
        "problem_id",
        F.col("n").cast("long").alias("n_solutions"),
        F.coalesce("n_feedback", F.lit(0)).alias("n_feedback"),
        kept.alias("kept"),
        F.when(~kept, F.lit(f"<{least} solutions on disk")).alias("reason"),
        F.when(only.isin("cpp", "java"), only).otherwise("mixed").alias("language_dominant"),
    )


def rows_of_kept(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows whose problem stays."""
    return rows.join(decisions.where("kept").select("problem_id"), "problem_id", "left_semi")


def at_ratio(first: DataFrame, second: DataFrame, ratio: float, key: Column, seed: int) -> DataFrame:
    """Rows of both, ``first`` making up ``ratio``, as many as the scarcer allows; each chosen by a seeded hash of ``key``.

    Where one has no rows, or the ratio is 0 or 1, all of what is wanted stay.
    ``first`` and ``second`` have the same columns.
    """
    a, b = first.count(), second.count()
    if not a or not b:
        return first.unionByName(second)
    total = min(a / max(ratio, 1e-6), b / max(1 - ratio, 1e-6))
    shuffled = seeded(seed, key)
    sides = ((first, int(total * ratio + 1e-9)), (second, int(total * (1 - ratio) + 1e-9)))
    return sides[0][0].transform(first_n, sides[0][1], hash_key(shuffled), shuffled).unionByName(sides[1][0].transform(first_n, sides[1][1], hash_key(shuffled), shuffled))


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows that passed the validator and have hints."""
    return rows.where(F.coalesce("validator_passed", F.lit(False)) & (F.size("hints") > 0))


def sampled(rows: DataFrame, group: str, per_group: int, seed: int, name: str) -> DataFrame:
    """At most ``per_group`` rows of each group in a seeded order of their names; a group may hold any share of the rows."""
    placed = running(rows, [group], [seeded(seed, group, name), name])
    return placed.where(F.col("place") < per_group).select(*rows.columns)


def split_counts(samples: DataFrame, problem: str) -> DataFrame:
    """How many samples of each problem are in each split, zeros too."""
    return samples.groupBy(problem).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def assembled(silver: DataFrame, bootstrap: DataFrame | None, ratio: float | None, train: float, val: float, seed: int, key: str) -> DataFrame:
    """Valid rows of one or two sources, at a ratio if there is one, with ``split``: all rows of an author of a problem in one."""
    mix = valid_rows(silver)
    if bootstrap is not None:
        other = valid_rows(bootstrap)
        mix = mix.unionByName(other) if ratio is None else at_ratio(mix, other, ratio, F.col(key), seed)
    return grouped_split(mix, "problem_id", "anon_id", train, val, seed)
