"""Per-user score trajectories (OP-09F, 110, 111, 117) on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.plans.catalog import register
from gradewell.session import table


def trajectories(rows: DataFrame, keys: list[str], ts: str, seq: str, score: str) -> DataFrame:
    """One row per key: attempts in time order (missing times first, ties by ``seq``)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts).isNotNull().alias("timed"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col(score).alias("score"))))
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("n_submissions"), ordered.alias("steps"), F.max(score).alias("max_pts"))
        .select(
            *keys,
            "n_submissions",
            F.element_at("steps", 1)["ts"].alias("first_at"),
            F.element_at("steps", -1)["ts"].alias("last_at"),
            F.transform("steps", lambda s: s["score"]).alias("pts_progression"),
            F.element_at("steps", -1)["score"].alias("final_pts"),
            "max_pts",
        )
    )


@register(
    "op_09f_user_trajectories",
    """
    SELECT user_id, event_type, count(*) AS n_submissions,
           arg_min(ts, (ts, event_id)) AS first_at, arg_max(ts, (ts, event_id)) AS last_at,
           array_to_string(list(CAST(round(value * 100) AS BIGINT) ORDER BY ts NULLS FIRST, event_id), ',') AS pts_progression,
           round(arg_max(value, (ts, event_id)), 6) AS final_pts, round(max(value), 6) AS max_pts
    FROM events GROUP BY user_id, event_type
    """,
)
def user_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trajectories(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "value")
    cents = F.transform("pts_progression", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return found.withColumns({"pts_progression": F.array_join(cents, ","), "final_pts": F.round("final_pts", 6), "max_pts": F.round("max_pts", 6)})
