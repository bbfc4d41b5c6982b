"""Zip archives, nested ones too, as tables (OP-007 to 010): a Python data source whose filters act on member names."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "archive string, inner string, member string, size long, payload binary"


def members(data: bytes, archive: str, wanted: str = ".*", most: int = 1 << 40, payload: bool = True, inner: str | None = None) -> Iterator[tuple]:
    """Members of an archive and of the archives in it whose path matches and whose size is at most ``most``; with ``inner`` only of inner archives of that name."""
    pattern = re.compile(wanted)
    with zipfile.ZipFile(io.BytesIO(data)) as outer:
        for info in outer.infolist():
            if info.is_dir():
                continue
            if info.filename.lower().endswith(".zip"):
                if inner and not re.search(inner, info.filename.rsplit("/", 1)[-1]):
                    continue
                with zipfile.ZipFile(io.BytesIO(outer.read(info))) as nested:
                    for m in nested.infolist():
                        if not m.is_dir() and m.file_size <= most and pattern.search(m.filename):
                            yield archive, info.filename, m.filename, m.file_size, nested.read(m) if payload else None
            elif not inner and info.file_size <= most and pattern.search(info.filename):
                yield archive, None, info.filename, info.file_size, outer.read(info) if payload else None


def members_of(archives: DataFrame, wanted: str = ".*", most: int = 1 << 40, payload: bool = True, inner: str | None = None) -> DataFrame:
    """``archives`` (path, content): one task reads whole files, a member is a row. ``MEMBERS``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = list(members(bytes(data), name, wanted, most, payload, inner))
                yield pd.DataFrame(rows, columns=["archive", "inner", "member", "size", "payload"])

    return archives.select("path", "content").mapInPandas(run, MEMBERS)


def read_archives(spark: SparkSession, path: str, wanted: str = ".*", most: int = 1 << 40, payload: bool = True) -> DataFrame:
    """Archives in any store."""
    return members_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path), wanted, most, payload)


def extract_once(archives: DataFrame, target: str) -> bool:
    """Write all members below ``target`` unless a complete extraction is there; whether anything was written."""
    from gradewell.sources.files import exists

    if exists(archives.sparkSession, f"{target}/_SUCCESS"):
        return False
    members_of(archives).write.mode("overwrite").parquet(target)
    return True


def extracted(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(MEMBERS).parquet(target)


def test_inputs(rows: DataFrame) -> DataFrame:
    """pid, test_id, size, payload of members private_tests/<pid>/.../<test_id>.in."""
    parts = F.split(F.replace("member", F.lit("\\"), F.lit("/")), "/")
    named = rows.where(F.col("member").endswith(".in")).withColumn("p", parts).where((F.size("p") >= 3) & (F.col("p")[0] == "private_tests"))
    return named.select(F.col("p")[1].alias("pid"), F.regexp_replace(F.element_at("p", -1), r"\.in$", "").alias("test_id"), "size", "payload")


def zipped(name: Column, text: Column) -> Column:
    """An archive as bytes: a note, and an archive of a test's input and reference inside it."""

    @F.pandas_udf("binary")
    def run(names: pd.Series, texts: pd.Series) -> pd.Series:
        def one(n: str, t: str) -> bytes:
            inside, whole = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inside, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"private_tests/p{n}/{n}-small.in", t)
                z.writestr(f"private_tests/p{n}/{n}-small.ref", str(len(t)))
            with zipfile.ZipFile(whole, "w") as z:
                z.writestr(f"tests_{n}.zip", inside.getvalue())
                z.writestr("README.txt", f"item {n}")
            return whole.getvalue()

        return pd.Series([one(n, t) for n, t in zip(names, texts, strict=True)])

    return run(name, text)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Archive]:
        import glob

        return [_Archive(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from members(f.read(), partition.path, self.options.get("members", ".*"), int(self.options.get("maxSize", 1 << 40)), self.options.get("payload", "true") == "true")


class NestedZipSource(DataSource):
    """``spark.read.format("nested_zip")`` over paths that every executor mounts; options members, maxSize, payload."""

    @classmethod
    def name(cls) -> str:
        return "nested_zip"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def test_ids(rows: DataFrame) -> DataFrame:
    """Distinct problem ids of member paths <pid>/input/..., sorted."""
    return rows.where(F.col("member").contains("/")).select(F.split("member", "/")[0].alias("pid")).distinct().orderBy("pid")
