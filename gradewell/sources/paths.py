"""Where things lie: folders, path resolvers and configurations (OP-019, 021, 024)."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The folders of a project below its root.
FOLDERS = ("data", "data/raw", "data/processed", "data/annotations", "data/hints", "data/figures", "data/raw/solutions", "data/raw/statements", "data/raw/tests")


def make_folders(spark: SparkSession, root: str) -> list[str]:
    """Make the project's folders in any store; those that are there stay."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = [f"{root.rstrip('/')}/{name}" for name in FOLDERS]
    for folder in made:
        store.mkdirs(path(folder))
    return made


def resolve(path: str, root: str) -> str:
    """A path as it is if it is absolute or names a store, else below ``root``."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"


def statement_path(year: Column, theme: Column, root: str = "data/raw/statements") -> Column:
    number = F.when(theme == "tema1", "1").otherwise("2")
    return F.concat(F.lit(f"{root}/[PA] Tema "), number, F.lit(" "), year, F.lit(".pdf"))


def solutions_folder(problem_id: Column, root: str = "data/raw/solutions") -> Column:
    """<year>_<theme>_<pid> -> the folder <year>_<pid>; null if the id hasn't three parts."""
    parts = F.split(problem_id, "_", 3)
    return F.when(F.size(parts) == 3, F.concat(F.lit(f"{root}/"), parts[0], F.lit("_"), F.get(parts, F.lit(2))))


def output_stem(kind: str, anon: Column, problem_id: Column) -> Column:
    """The stem of a run's files: its kind, the author and the last part of the problem's id."""
    return F.concat(F.lit(f"{kind}_"), anon, F.lit("_"), F.element_at(F.split(problem_id, "_"), -1))


def parse_config(text: str) -> dict[str, Any]:
    """A YAML configuration; where no YAML reader is installed, JSON, which is YAML."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def flat(config: Any, name: str = "") -> list[tuple[str, str]]:
    """Dotted names and values (as JSON) of a nested configuration, in order."""
    if isinstance(config, dict):
        return [x for k, v in config.items() for x in flat(v, f"{name}.{k}" if name else str(k))]
    return [(name, json.dumps(config, ensure_ascii=False))]


def config_entries(text: Column) -> Column:
    """Array of (name, value) of a configuration's text."""

    @F.pandas_udf("array<struct<name: string, value: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else flat(parse_config(t)))

    return run(text)
