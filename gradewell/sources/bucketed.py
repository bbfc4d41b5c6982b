"""A stored table in buckets of its key: an upsert rewrites the buckets it hits and no other file (OP-11O, 11P, 142).

``<root>/data/<version>/__bucket=<k>`` holds a bucket as the version wrote it,
``<root>/versions/<version>.json`` says which folder is current for each bucket.
A version is staged, checked and then becomes current by one rename; until then,
and if anything fails, readers see the one before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradewell.operators.pairing import not_done
from gradewell.sources.files import exists, kept

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Upserted:
    version: int
    buckets: tuple[int, ...]
    rows: int


class BucketTable:
    """A table at ``root`` with unique ``keys``, dealt over ``buckets`` by their hash; the number is fixed by the first version."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 if nothing was stored yet."""
        folder = f"{self.root}/versions"
        if not exists(self.spark, folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"keys": self.keys, "buckets": self.buckets, "schema": None, "folders": {}}
        text = self.spark.read.text(f"{self.root}/versions/{version:09d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        if found["keys"] != self.keys:
            raise ValueError(f"the table's keys are {found['keys']}")
        return found

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{path}" for k, path in manifest["folders"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows of the current version, which stay readable when later ones are stored."""
        rows = self._rows(self._manifest(self.version()))
        if rows is None:
            raise FileNotFoundError(f"nothing was stored at {self.root}")
        return rows

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def upsert(self, new: DataFrame, check: Callable[[DataFrame], None] | None = None, order: Column | None = None) -> Upserted:
        """Store ``new``: its rows take the place of those with the same keys (null keys are equal), others stay.

        Of several new rows with one key the greatest by ``order`` counts;
        without an order they are an error. ``check`` sees all rows of the
        buckets that change and raises if they mustn't be stored. No new rows
        store nothing, but for the schema of a table that is new.
        """
        version = self.version()
        manifest = self._manifest(version)
        buckets = manifest["buckets"]
        if manifest["schema"] is not None and {f.name: f.dataType for f in new.schema} != {f["name"]: f_.dataType for f, f_ in zip(manifest["schema"]["fields"], StructType.fromJson(manifest["schema"]), strict=True)}:
            raise ValueError("the new rows have other columns than the table")
        if order is not None:
            new = new.groupBy(*self.keys).agg(F.max_by(F.struct(*new.columns), order).alias("__row")).select("__row.*")
        new = kept(new.withColumn(_BUCKET, self.bucket(buckets)))
        if order is None and not new.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("several new rows have one key and no order")
        hit = sorted(r[0] for r in new.select(_BUCKET).distinct().collect())  # at most the number of buckets
        if not hit and version:
            return Upserted(version, (), 0)
        count, rows = new.count(), new.drop(_BUCKET)
        old = self._rows(manifest, hit)
        if old is not None:
            rows = not_done(old, rows, self.keys).unionByName(rows)
        staged = f"data/{version + 1:09d}"
        try:
            if hit:
                dealt = rows.select(*[c.name for c in (StructType.fromJson(manifest["schema"]) if manifest["schema"] else rows.schema)], self.bucket(buckets).alias(_BUCKET))
                dealt.repartition(len(hit), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.root}/{staged}")
            schema = manifest["schema"] or rows.schema.jsonValue()
            folders = manifest["folders"] | {str(k): f"{staged}/{_BUCKET}={k}" for k in hit}
            if check is not None:
                check(self._rows({"schema": schema, "folders": folders}, hit))
            self._publish(version + 1, {"keys": self.keys, "buckets": buckets, "schema": schema, "folders": folders})
        except BaseException:
            if self.version() <= version:  # nobody else has stored a version of this number
                self._fs.delete(self._path(f"{self.root}/{staged}"), True)
            raise
        return Upserted(version + 1, tuple(hit), count)

    def _publish(self, version: int, manifest: dict) -> None:
        """Write the version's file beside its place and move it there, which fails if there is one."""
        target, draft = (self._path(f"{self.root}/versions/{name}") for name in (f"{version:09d}.json", f".{version:09d}.draft"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        sc = self.spark.sparkContext
        rename = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(draft, target, rename)

    def clean(self) -> int:
        """Delete what only earlier versions need: nobody may be reading them any more. The number of folders that went."""
        current = self.version()
        needed = set(self._manifest(current)["folders"].values())
        gone = 0
        for k in range(1, current + 1):
            folder = self._path(f"{self.root}/data/{k:09d}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = s.getPath().getName()
                if name.startswith(_BUCKET) and f"data/{k:09d}/{name}" not in needed:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
            if k < current:
                self._fs.delete(self._path(f"{self.root}/versions/{k:09d}.json"), True)
        return gone
