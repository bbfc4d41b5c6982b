"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset and Spark is local, a folder of this machine."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


#: Roots of this process's scratch tables.
_ROOTS: list[str] = []


class Scratch:
    """Written tables of one run of an operator: they cut the lineage and outlive lost executors.

    What only the operator reads, it drops. What its lazy result reads stays
    until the result's owner, who alone knows when it has been read, calls
    ``clear``; ``corpus_pipeline.run`` does between its stages.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it again."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A place in the list of scratch tables, for ``clear``."""
    return len(_ROOTS)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables that were made since a mark: no result that reads them may be wanted any more."""
    while len(_ROOTS) > since:
        _delete(spark, _ROOTS.pop())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sheltered(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with plain names for all columns but those that are needed, and what gives a result of them its names back.

    So columns may have any name: with dots, like an operator's own, or several alike.
    """
    inner = [c if c in needed else f"kept_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda found: found.select(*inner).toDF(*docs.columns)
