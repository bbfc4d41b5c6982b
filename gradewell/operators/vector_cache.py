"""A stored, content-addressed cache of what texts are encoded to (OP-142)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.text import content_key
from gradewell.sources.bucketed import BucketTable
from gradewell.sources.files import kept

KEY = "content_key"
#: Texts that aren't known are encoded and stored in so many steps; an interrupted run keeps the steps that were done.
STEPS = 8


def open_cache(spark: SparkSession, root: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, root, [KEY], buckets)


def read_through(rows: DataFrame, text: str, cache: BucketTable, encode: Callable[[DataFrame], DataFrame], steps: int = STEPS) -> tuple[DataFrame, int]:
    """``rows`` with ``embedding``, and how many texts were encoded for it.

    ``encode`` takes (content_key, text) and returns a row (content_key,
    embedding) for each; it sees each text that the cache doesn't hold once,
    and its answers are stored before anything reads them. Null texts have a
    null embedding and aren't encoded; an empty text is a text. ``rows`` must
    not have the columns content_key and embedding.
    """
    if {KEY, "embedding"} & set(rows.columns):
        raise ValueError("rows have a column content_key or embedding")
    keyed = rows.withColumn(KEY, content_key(F.col(text)))
    wanted = keyed.where(F.col(text).isNotNull()).groupBy(KEY).agg(F.min(text).alias("text"))
    if cache.version():
        wanted = wanted.join(cache.read().select(KEY), KEY, "left_anti")
    missing = kept(wanted.withColumn("__step", F.pmod(cache.bucket(cache.buckets), F.lit(steps))))
    present = {r[0] for r in missing.select("__step").distinct().collect()}
    encoded = 0
    for step in sorted(present) or ([] if cache.version() else [0]):
        part = missing.where(F.col("__step") == step).select(KEY, "text")
        encoded += cache.upsert(encode(part).select(KEY, "embedding")).rows
    return keyed.join(cache.read(), KEY, "left").drop(KEY), encoded
