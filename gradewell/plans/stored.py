"""Queries that go through stored tables and streams (OP-006, 114, 11O, 11P, 142, 14C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.text import content_key
from gradewell.operators import vector_cache
from gradewell.operators.pairing import top_by
from gradewell.plans.catalog import register
from gradewell.session import table
from gradewell.sources import files
from gradewell.sources.bucketed import BucketTable
from gradewell.streaming import budget
from gradewell.streaming.events import read_events


@register("op_11o_stored_upsert", "SELECT doc_id, CASE WHEN toxic = 1 THEN quality + 10 ELSE quality END AS quality, toxic FROM labels")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are stored, and those of toxic documents replaced; no version has an invalid row."""

    def check(rows: DataFrame) -> None:
        bad = rows.where("toxic NOT IN (0, 1) OR quality NOT IN (0, 1, 10, 11)").count()
        if bad:
            raise ValueError(f"{bad} rows are invalid")

    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    stored = BucketTable(spark, files.shared_folder(spark), ["doc_id"])
    stored.upsert(rows, check)
    stored.upsert(rows.where("toxic = 1").withColumn("quality", F.col("quality") + 10), check)
    return stored.read()


_NAMED_SQL = "SELECT doc_id, text, ('0x' || left(md5(text), 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM documents WHERE text IS NOT NULL"


@register(
    "op_142_stored_cache",
    f"WITH t AS ({_NAMED_SQL}), first AS (SELECT DISTINCT text FROM t WHERE doc_id % 2 = 0), again AS (SELECT count(DISTINCT text) AS n FROM t WHERE text NOT IN (SELECT text FROM first)) SELECT doc_id, vec_id, (SELECT count(*) FROM first) AS encoded_first, again.n AS encoded_then, 0::BIGINT AS encoded_last FROM t, again",
)
def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are looked up, then all, then all again: each distinct text is encoded once."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()

    def encode(misses: DataFrame) -> DataFrame:
        """A text's vector is one of the table's, by a digest."""
        return misses.withColumn("vec_id", F.conv(F.left(F.md5("text"), F.lit(8)), 16, 10).cast("long") % n).join(vectors, "vec_id").select("content_key", "embedding")

    cache = vector_cache.open_cache(spark, files.shared_folder(spark))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    encoded = [vector_cache.read_through(rows, "text", cache, encode) for rows in (docs.where("doc_id % 2 = 0"), docs, docs)]
    found = encoded[-1][0]
    # the vector is looked up again, by its components
    named = vectors.groupBy(F.xxhash64("embedding").alias("h")).agg(F.min("vec_id").alias("least"))
    wanted = vectors.select("vec_id", F.xxhash64("embedding").alias("h"))
    own = found.select("doc_id", F.xxhash64("embedding").alias("h"), (F.conv(F.left(F.md5("text"), F.lit(8)), 16, 10).cast("long") % n).alias("vec_id"))
    checked = own.join(wanted.withColumnRenamed("h", "expected"), "vec_id", "left").join(named, "h", "left")
    answer = F.when(F.col("h") == F.col("expected"), F.col("vec_id")).otherwise(F.col("least"))
    return checked.select("doc_id", answer.alias("vec_id"), *[F.lit(k).cast("long").alias(name) for name, (_, k) in zip(("encoded_first", "encoded_then", "encoded_last"), encoded, strict=True)])


@register(
    "op_114_stream_budget",
    "WITH done AS (SELECT user_id, event_id FROM events WHERE event_id % 10 = 0), had AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM done) WHERE k <= 2) SELECT user_id, event_id, event_type FROM (SELECT e.user_id, e.event_id, event_type, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS k FROM events e LEFT JOIN (SELECT user_id, count(*) AS n FROM had GROUP BY user_id) h ON h.user_id = e.user_id WHERE e.event_id NOT IN (SELECT event_id FROM had)) WHERE k <= 6 - n",
)
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six events a user over three arrivals of a stream, counting up to two that were produced before."""
    rows, root = table(spark, sf_dir, "events"), files.shared_folder(spark)
    done = top_by(rows.where("event_id % 10 = 0").select("user_id", "event_id"), ["user_id"], 2, "event_id")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [None, *[low + (high - low) * k // 3 for k in (1, 2)], None] if low is not None else []
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        arrived = F.lit(True) if first is None else F.col("event_id") > first
        rows.where(arrived if end is None else arrived & (F.col("event_id") <= end)).write.mode("append").parquet(f"{root}/in")
        budget.append_within_budget(read_events(spark, f"{root}/in", 1_000_000), "user_id", "event_id", 6, f"{root}/out", f"{root}/checkpoint", done).awaitTermination()
    return spark.read.schema("user_id long, event_id long, event_type string").json(f"{root}/out")
