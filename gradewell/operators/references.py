"""Ids in lists against a dimension table (OP-069, 095)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.contracts import quoted


def checked_ids(rows: DataFrame, idents: list[str], items: Column, dimension: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``known`` and ``unknown``: the items that the dimension has, and those that it hasn't, in their order, repeats too.

    ``idents`` name a row, ``items`` is an array of texts; null items are
    unknown. The dimension is joined: a small one goes to all tasks, as its size
    says when it is read, a large one is exchanged. Rows without items have
    empty lists. ``rows`` must not have columns known and unknown.
    """
    each = rows.select(*idents, F.posexplode(items).alias("__pos", "__item"))
    dim = dimension.select(F.col(key).cast("string").alias("__key")).where("__key IS NOT NULL").distinct()
    found = each.join(dim, F.col("__item") == F.col("__key"), "left")
    entry = F.struct(F.col("__pos").alias("pos"), F.col("__item").alias("item"), F.col("__key").isNotNull().alias("has"))
    lists = found.groupBy(*idents).agg(F.sort_array(F.collect_list(entry)).alias("__l")).withColumnsRenamed({i: f"__{i}" for i in idents})
    on = reduce(Column.__and__, [F.col(i).eqNullSafe(F.col(f"__{i}")) for i in idents])
    none = F.array().cast("array<string>")
    of = lambda has: F.coalesce(F.transform(F.filter("__l", lambda x: x["has"] == has), lambda x: x["item"]), none)
    return rows.join(lists, on, "left").select(*rows.columns, of(True).alias("known"), of(False).alias("unknown"))


def concept_errors(rows: DataFrame, idents: list[str], concepts: Column, primary: Column, dimension: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``error``, null where there is none: unknown concepts, an unknown primary one, or no concepts, in fixed words and this order.

    Repeated concepts count once; a null or empty primary concept breaks no rule.
    """
    listed = F.array_distinct(F.coalesce(concepts, F.array().cast("array<string>")))
    asked = rows.withColumns({"__c": listed, "__p": F.coalesce(primary, F.lit(""))})
    # the primary concept comes last, so its place in the list of unknown ones tells it from the others
    checked = checked_ids(asked, idents, F.concat("__c", F.array("__p")), dimension, key)
    primary_unknown = ~F.array_contains("known", F.col("__p")) & (F.col("__p") != "")
    bad = F.slice("unknown", F.lit(1), F.size("unknown") - F.when(F.array_contains("known", F.col("__p")), 0).otherwise(1))
    error = (
        F.when(F.size(bad) > 0, F.concat(F.lit("unknown concept ids: ["), F.array_join(F.transform(bad, lambda x: F.coalesce(quoted(x), F.lit("None"))), ", "), F.lit("]")))
        .when(primary_unknown, F.concat(F.lit("unknown primary_concept: "), "__p"))
        .when(F.size("__c") == 0, F.lit("missing concepts"))
    )
    return checked.select(*rows.columns, error.alias("error"))
