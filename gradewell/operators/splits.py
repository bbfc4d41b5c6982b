"""Group-aware train, validation and test splits (OP-11E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.pairing import seeded
from gradewell.operators.ranks import running


def grouped_split(rows: DataFrame, stratum: str, group: str, train: float, val: float, seed: int, global_group: bool = False) -> DataFrame:
    """``rows`` with ``split``; all rows of a (stratum, group) are in one split.

    In each stratum the groups in seeded order give max(1, floor(n * train)) to
    training, floor(n * val) to validation and the rest to test; their places are
    counted in two levels, so a stratum may hold all groups. With
    ``global_group`` a group is in one split over all strata. A null group is
    the group ``_unknown``.
    """
    named = rows.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("_unknown"))).withColumn("__s", F.lit("all") if global_group else F.col(stratum).cast("string"))
    groups = running(named.select("__s", "__g").distinct(), ["__s"], [seeded(seed, "__s", "__g"), "__g"]).select("__s", "__g", (F.col("place") + 1).alias("k"), F.col("size").alias("n"))
    n_train = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    split = F.when(F.col("k") <= n_train, "train").when(F.col("k") <= n_train + F.floor(F.col("n") * val), "val").otherwise("test")
    return named.join(groups.select("__s", "__g", split.alias("split")), ["__s", "__g"]).drop("__s", "__g")
