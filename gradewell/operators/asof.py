"""Nearest-value joins: of the rows of a key the one whose value is nearest (OP-066).

Both sides are sorted together, range-partitioned by key and value. The last row
of the other side before a row, and the next one after it, are found inside its
partition; where that holds none, they come from the neighbouring partitions of
the key, of which each gives its first and last row. No pairs are made and no key
is one task's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.sources.files import kept


def nearest(targets: DataFrame, candidates: DataFrame, keys: list[str], value: str, target: str, name: str) -> DataFrame:
    """For each row of ``targets`` that has one, the candidate of its key nearest in ``value``: target, name, distance.

    Of equally near ones the smaller ``name``. Rows without a value have no
    nearest and are nobody's; null keys are a key like others. Repeated targets
    are answered each.
    """
    # of equal values the smallest name is enough
    one = candidates.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.min(name).alias("__name"))
    other = one.select(*keys, "__v", F.lit(0).alias("__side"), F.struct("__v", "__name").alias("__c"), F.lit(None).cast(targets.schema[target].dataType).alias("__t"))
    asked = targets.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.lit(1).alias("__side"), F.lit(None).cast(other.schema["__c"].dataType).alias("__c"), F.col(target).alias("__t"))
    # written, because another run of the range partitioning would draw other bounds
    placed = kept(other.union(asked).repartitionByRange(*keys, "__v", "__side").withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part", *keys).orderBy("__v", "__side")
    found = placed.withColumns({
        "__before": F.last("__c", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "__after": F.first("__c", ignorenulls=True).over(local.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).where("__side = 1")
    ends = placed.groupBy("__part", *keys).agg(F.min("__c").alias("__low"), F.max("__c").alias("__high"))
    order = Window.partitionBy(*keys).orderBy("__part")  # one row for each key and partition
    ends = ends.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], F.last("__high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"), F.first("__low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__p"))
    sides = found.join(ends, on).withColumns({"__before": F.coalesce("__before", "__earlier"), "__after": F.coalesce("__after", "__later")})

    def far(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.__v") - F.col("__v")).alias("d"), F.col(f"{side}.__name").alias("n")))

    best = F.array_min(F.array_compact(F.array(far("__before"), far("__after"))))
    return sides.withColumn("__x", best).where("__x IS NOT NULL").select(F.col("__t").alias(target), F.col("__x.n").alias(name), F.col("__x.d").alias("distance"))


def nearest_preferred(targets: DataFrame, candidates: DataFrame, keys: list[str], preferred: str, value: str, target: str, name: str) -> DataFrame:
    """``nearest`` among the candidates that share ``preferred`` with the target too; among all of the key where none does.

    A null preference is none: all of the key are asked. ``target`` must be an id of the targets.
    """
    first = nearest(targets.where(F.col(preferred).isNotNull()), candidates, [*keys, preferred], value, target, name)
    found = kept(first)
    rest = targets.join(found.select(target), target, "left_anti")
    return found.unionByName(nearest(rest, candidates, keys, value, target, name))
