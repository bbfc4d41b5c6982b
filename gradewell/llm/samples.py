"""Bounded samples of labelled rows, the only thing that a model is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: With many labels, each gets its share of so many rows, but one row at least: every label is learned.
MAX_ROWS = 16_000
_SLOTS = 1 << 30


def sample_ids(rows: DataFrame, per_label: int, total: int = MAX_ROWS) -> DataFrame:
    """Of ``rows`` (doc_id, label): about ``per_label`` ids of each label, chosen by a hash of the id; doc_id, label.

    With many labels it is ``total`` divided by their number, but one at least.
    Nulls are left out; an id with several labels counts with the least of them.
    The driver sees the labels' counts and the chosen ids.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", F.col("label").cast("string").alias("label"))
    counts = rows.groupBy("label").count().collect()
    schema = "doc_id long, label string"
    if not counts:
        return spark.createDataFrame([], schema)
    per_label = max(1, min(per_label, total // len(counts)))
    # half as many again as wanted on average; what is too much is cut below, and a label of few rows is taken whole
    shares = [(r["label"], _SLOTS if r["count"] <= 30 else min(_SLOTS, int(_SLOTS * 1.5 * max(per_label, 20) / r["count"]) + 1)) for r in counts]
    some = rows.join(F.broadcast(spark.createDataFrame(shares, "label string, share long")), "label").where(F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS)) < F.col("share"))
    some = some.groupBy("doc_id").agg(F.min("label").alias("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = some.withColumn("rank", rank).where(F.col("rank") <= per_label).select("doc_id", "label").collect()
    return spark.createDataFrame([tuple(r) for r in chosen], schema)


def sample_texts(docs: DataFrame, ids: DataFrame, max_chars: int) -> list[tuple[int, str, str]]:
    """(doc_id, label, text) of the sampled ids, by doc_id. Texts are whole.

    A label's texts are taken in the order of a hash of their ids while they
    have ``max_chars`` characters together at most, and the first one of any
    length; so a label of long texts alone is learned from fewer of them.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    found = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    found = found.withColumns({"rank": F.row_number().over(order), "held": F.sum(F.length("text")).over(order)}).where((F.col("held") <= max_chars) | (F.col("rank") == 1))
    return [(r["doc_id"], r["label"], r["text"]) for r in found.orderBy("doc_id").select("doc_id", "label", "text").collect()]
