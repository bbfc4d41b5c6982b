"""Places and running sums over groups of any size, in two levels.

Rows are range-partitioned by group and order, so a large group lies in many
partitions. Places and sums are counted inside each partition; what the earlier
partitions of the same group hold is added, from one row for each group and
partition. No window is over a group's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.sources.files import kept


def same_keys(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality of key columns that differ in a suffix."""
    return reduce(Column.__and__, [F.col(f"{k}{left}").eqNullSafe(F.col(f"{k}{right}")) for k in keys], F.lit(True))


def running(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 0, in the group's order) and ``size`` (rows of the group).

    For each item of ``sums``, a name and a numeric column, also the running sum
    up to and with the row, and ``<name>_total`` of the group. ``order`` is
    ascending; its ties have an arbitrary order among them. Null keys are a group like others.
    ``place``, ``size``, the sums' names and names that begin with ``__r_`` must
    not be columns of ``rows``.
    """
    sums = sums or {}
    taken = {"place", "size", *sums, *(f"{s}_total" for s in sums)} & set(rows.columns) | {c for c in rows.columns if c.startswith("__r_")}
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be overwritten")
    ordered = rows.withColumns({f"__r_o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)})
    names = [F.col(f"__r_o{i}") for i in range(len(order))]
    # written, because another run of the range partitioning would draw other bounds
    placed = kept(ordered.repartitionByRange(*[F.col(k) for k in keys], *names).withColumn("__r_part", F.spark_partition_id()))
    local = Window.partitionBy("__r_part", *keys).orderBy(*names)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = placed.withColumns({"place": F.row_number().over(local) - 1, **{name: F.sum(column).over(upto) for name, column in sums.items()}})
    parts = placed.groupBy("__r_part", *keys).agg(F.count("*").alias("__r_n"), *[F.sum(column).alias(f"__r_{name}") for name, column in sums.items()])
    # one row for each group and partition
    by_part = Window.partitionBy(*keys).orderBy("__r_part")
    over, earlier = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_part.rowsBetween(Window.unboundedPreceding, -1)
    held = {"__r_n": "size", **{f"__r_{name}": f"{name}_total" for name in sums}}
    offsets = parts.select(F.col("__r_part").alias("__r_p"), *[F.col(k).alias(f"__r_k_{k}") for k in keys], *[c for part, whole in held.items() for c in (F.coalesce(F.sum(part).over(earlier), F.lit(0)).alias(f"{part}_before"), F.sum(part).over(over).alias(whole))])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__r_k_{k}")) for k in keys], F.col("__r_part") == F.col("__r_p"))
    found = each.join(offsets, on)
    return found.select(*rows.columns, (F.col("place") + F.col("__r_n_before")).cast("long").alias("place"), "size", *[c for name in sums for c in ((F.col(name) + F.col(f"__r_{name}_before")).alias(name), F.col(f"{name}_total"))])

