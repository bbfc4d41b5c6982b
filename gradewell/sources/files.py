"""File sources and sinks (OP-001 to 024) in any store that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below the temporary folder only where Spark is local."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str, schema: Schema, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped; a malformed one fails the query, or is left out if ``tolerant``."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> int:
    """Write JSON lines; the number of rows, observed during the write."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return int(seen.get["n"])


def read_document(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Rows that one document or one report may hold.
DOCUMENT_ROWS, REPORT_ROWS = 1_000_000, 100_000


def write_document(df: DataFrame, path: str, pretty: bool = True) -> None:
    """A table as one JSON array; of more than DOCUMENT_ROWS rows it is an error, nothing is left out."""
    whole = df.agg(F.count("*").alias("n"), F.to_json(F.collect_list(F.struct("*")), {"pretty": str(pretty).lower()}).alias("value"))
    if df.limit(DOCUMENT_ROWS + 1).count() > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows for one document")
    whole.select("value").coalesce(1).write.mode("overwrite").text(path)


def read_optional(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """JSON lines, or an empty table if the file isn't there."""
    return read_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = REPORT_ROWS) -> str:
    """A report as a Markdown table; of more than ``most`` rows it is an error, nothing is left out."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one report")
    rows = [df.columns, ["---"] * len(df.columns), *[[str(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def safe_text(content: Column, most: int = 200_000) -> Column:
    """At most so many bytes as text, bad sequences replaced."""
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def read_solutions(spark: SparkSession, root: str) -> DataFrame:
    """A folder of solution folders <year>_<pid>/<anon>_<score>.<ext>: year, pid, anon, score, ext, code. Other files are left out."""
    from gradewell.functions.classify import solution_file

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{cpp,java}").load(root)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("folder"), solution_file(F.element_at(parts, -1)).alias("f"), safe_text(F.col("content")).alias("code"))
    key = F.split("folder", "_", 2)
    return named.where("f IS NOT NULL").select(key[0].alias("year"), key[1].alias("pid"), "f.anon", "f.score", "f.ext", "code")


def kept(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: it is computed once, and lost executors don't take it along."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
