"""Session construction shared by the bench, the tests and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(master: str | None = None, app: str = "gradewell", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with AQE; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package whatever their working folder is."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])
    return spark


def with_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session beside ``spark`` with its settings, and with those given where it has none; ``spark`` stays as it is."""
    other = spark.newSession()
    for key, value in {**settings, **spark.conf.getAll}.items():
        if other.conf.get(key, None) != value:
            other.conf.set(key, value)
    return other


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
