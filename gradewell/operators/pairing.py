"""Joins of unsuccessful and successful attempts, lookups and resumption (OP-060 to 076)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.operators.ranks import running
from gradewell.sources.files import kept


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in the given order; ties need a last key in it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_by(rows: DataFrame, keys: list[str], n: int | Column, *order: Column | str) -> DataFrame:
    """At most ``n`` rows for each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def seeded(seed: int, *keys: Column | str) -> Column:
    """A deterministic shuffle key: the digest of seed and row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def same_author_pairs(failing: DataFrame, passing: DataFrame, keys: list[str], file: str, per_author: int) -> DataFrame:
    """Each author's failing files (at most ``per_author``, by name) with the author's first passing file."""
    one = passing.groupBy(*keys).agg(F.min(file).alias("passing_file"))
    some = top_by(failing, keys, per_author, file)
    return some.withColumnRenamed(file, "failing_file").join(one, keys)


def cross_author_pairs(failing: DataFrame, passing: DataFrame, keys: list[str], author: str, limit: int, seed: int, fail: str, ok: str) -> DataFrame:
    """At most ``limit`` pairs for each key of a failing and a passing file of different authors: keys, fail, ok.

    The pairs of a key are thought of in order of the failing file, the passing
    author and the passing file, and numbered, and
    evenly spaced numbers from a seeded first one are taken. A number names its
    pair: the failing file is found in the running sums of how many files of
    others each could meet, the passing file by its place; so pairs are chosen
    from all and only the chosen ones are made. Places and sums are counted in
    two levels, so a key may hold any share of the files.
    """
    # in order of authors, an author's own files stand together, so a start and a number are enough to step over them
    placed = kept(running(passing.select(*keys, F.col(author).alias("__other"), ok), keys, ["__other", ok]).withColumnRenamed("place", "__place"))
    per_key = placed.groupBy(*keys).agg(F.count("*").alias("__n_ok"))
    own = placed.groupBy(*keys, F.col("__other").alias(author)).agg(F.min("__place").alias("__own"), F.count("*").alias("__n_own"))
    met = failing.select(*keys, author, fail).join(per_key, keys).join(own, [*keys, author], "left")
    met = met.withColumn("__n_own", F.coalesce("__n_own", F.lit(0))).withColumn("__others", F.col("__n_ok") - F.col("__n_own"))
    met = running(met, keys, [fail], {"__until": "__others"}).withColumnRenamed("__until_total", "__total").where("__others > 0")
    first = F.pmod(F.conv(F.left(seeded(seed, *keys), F.lit(8)), 16, 10).cast("long"), F.col("__total"))
    step = F.greatest(F.floor(F.col("__total") / limit), F.lit(1))
    numbers = F.transform(F.sequence(F.lit(0), F.least(F.lit(limit).cast("long"), F.col("__total")) - 1), lambda k: F.pmod(first + k * step, F.col("__total")))
    mine = F.filter(numbers, lambda x: (x >= F.col("__until") - F.col("__others")) & (x < F.col("__until")))
    at = F.col("__at") + F.when(F.col("__at") >= F.col("__own"), F.col("__n_own")).otherwise(F.lit(0))
    chosen = met.select(*keys, fail, "__own", "__n_own", F.explode(F.transform(mine, lambda x: x - (F.col("__until") - F.col("__others")))).alias("__at"))
    return chosen.select(*keys, fail, at.alias("__place")).join(placed.select(*keys, "__place", ok), [*keys, "__place"]).select(*keys, fail, ok)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key hasn't been produced yet; null keys match each other."""
    named = done.select(*[F.col(k).alias(f"__d_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__d_{k}"))
        same = eq if same is None else same & eq
    return rows.join(named, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace the old ones of the same key."""
    return not_done(old, new, keys).unionByName(new)


def canonical_id(raw: Column, aliases: DataFrame) -> tuple[Column, DataFrame]:
    """Lookup key of an alias, and the alias table keyed by it."""
    return F.lower(F.trim(raw)), aliases.select(F.lower(F.trim("alias")).alias("__alias"), F.col("id").alias("__id"))
