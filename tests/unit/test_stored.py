"""Stored tables, the cache on them, and streams with budgets."""

import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradewell.functions.text import content_key
from gradewell.operators import vector_cache
from gradewell.sources.bucketed import BucketTable
from gradewell.streaming import budget
from gradewell.streaming.events import EVENTS, read_events


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ["k"], 16)
    t.upsert(spark.createDataFrame([(k, f"v{k}") for k in range(200)] + [(None, "null")], "k long, v string"))
    return t, tmp_path / "t"


def test_upsert_rewrites_only_hit_buckets(spark, stored):
    table, root = stored
    before = files_of(root)
    done = table.upsert(spark.createDataFrame([(5, "new"), (None, "other"), (1000, "more")], "k long, v string"))
    assert done.version == 2 and done.rows == 3 and 1 <= len(done.buckets) <= 3
    assert rows_of(table) == sorted([(k, "new" if k == 5 else f"v{k}") for k in range(200)] + [(None, "other"), (1000, "more")], key=str)
    after = files_of(root)
    assert all(after[f] == at for f, at in before.items())  # names and times
    new = {f.split("__bucket=")[1].split("/")[0] for f in after.keys() - before.keys()}
    assert new == {str(b) for b in done.buckets}


def test_a_reader_keeps_its_version(spark, stored):
    table, root = stored
    old = table.read()
    table.upsert(spark.createDataFrame([(k, "changed") for k in range(200)], "k long, v string"))
    assert old.where("v = 'changed'").isEmpty() and old.count() == 201
    size = len(files_of(root))
    assert table.clean() > 0 and len(files_of(root)) < size
    assert table.read().where("v = 'changed'").count() == 200 and table.version() == 2


def test_failures_leave_the_old_version(spark, stored):
    table, root = stored
    before, files = rows_of(table), files_of(root)

    def check(rows):
        if not rows.where("v = 'bad'").isEmpty():
            raise ValueError("bad row")

    fine, bad = (spark.createDataFrame([(7, v)], "k long, v string") for v in ("fine", "bad"))
    with pytest.raises(ValueError, match="bad row"):
        table.upsert(bad, check)
    with pytest.raises(Exception, match="no number"):
        table.upsert(spark.range(1).select(F.lit(7).cast("long").alias("k"), F.raise_error(F.lit("no number")).cast("string").alias("v")), check)
    with pytest.raises(ValueError, match="one key"):
        table.upsert(fine.union(bad))
    with pytest.raises(ValueError, match="other columns"):
        table.upsert(spark.createDataFrame([(7, 1)], "k long, w int"))
    assert table.version() == 1 and rows_of(table) == before and files_of(root) == files
    table.upsert(fine, check)
    assert table.version() == 2 and table.read().where("k = 7").first()["v"] == "fine"


def test_two_writers_of_one_version(spark, stored):
    table, _ = stored
    other = BucketTable(spark, table.root, ["k"], 16)
    one = spark.createDataFrame([(1, "a")], "k long, v string")

    def meanwhile(rows):
        other.upsert(spark.createDataFrame([(2, "b")], "k long, v string"))

    with pytest.raises(Exception, match="(?i)exist"):
        table.upsert(one, meanwhile)
    assert table.version() == 2 and table.read().where("v = 'b'").count() == 1 and table.read().where("v = 'a'").isEmpty()


def test_order_and_empty_tables(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/e", ["a", "b"], 4)
    with pytest.raises(FileNotFoundError):
        table.read()
    none = spark.createDataFrame([], "a string, b int, n int")
    assert table.upsert(none).version == 1 and table.read().isEmpty()
    assert table.upsert(none).version == 1
    table.upsert(spark.createDataFrame([("x", None, 1), ("x", None, 3), ("x", None, 2), ("x", 0, 9)], "a string, b int, n int"), order=F.col("n"))
    assert rows_of(table) == [("x", 0, 9), ("x", None, 3)]
    with pytest.raises(ValueError, match="keys"):
        BucketTable(spark, table.root, ["b"]).read()


# --- the cache


def encoder(failing=()):
    def encode(misses):
        refused = F.when(F.col("text").isin(*failing), F.raise_error(F.lit("no answer"))) if failing else F.lit(None)
        return misses.select("content_key", F.coalesce(refused.cast("double"), F.length("text").cast("double")).alias("n")).select("content_key", F.array("n").alias("embedding"))

    return encode


def test_the_cache_encodes_each_text_once(spark, tmp_path):
    cache = vector_cache.open_cache(spark, f"file://{tmp_path}/c", 8)
    texts = ["a", "bb", "bb", "", None, *(f"text {k}" for k in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found, encoded = vector_cache.read_through(rows.where("id < 20"), "t", cache, encoder())
    assert encoded == len({t for t in texts[:20] if t is not None})
    found, encoded = vector_cache.read_through(rows, "t", cache, encoder())
    assert encoded == 25
    assert {r["id"]: r["embedding"] for r in found.collect()} == {i: None if t is None else [float(len(t))] for i, t in enumerate(texts)}
    files = files_of(tmp_path / "c")
    again, encoded = vector_cache.read_through(rows, "t", cache, encoder(failing=("a", "bb")))  # would fail if it encoded
    assert encoded == 0 and again.count() == len(texts) and files_of(tmp_path / "c") == files
    with pytest.raises(ValueError, match="embedding"):
        vector_cache.read_through(found, "t", cache, encoder())
    none, encoded = vector_cache.read_through(rows.limit(0), "t", vector_cache.open_cache(spark, f"file://{tmp_path}/n"), encoder())
    assert none.isEmpty() and encoded == 0


def test_an_interrupted_run_loses_nothing(spark, tmp_path):
    cache = vector_cache.open_cache(spark, f"file://{tmp_path}/c", 8)
    rows = spark.createDataFrame([(f"text {k}",) for k in range(60)], "t string")
    # the text of the last step can't be encoded at first
    steps = {r["t"]: r["s"] for r in rows.select("t", F.pmod(F.xxhash64(content_key(F.col("t"))), F.lit(8)).alias("s")).collect()}
    last = max(steps, key=steps.get)
    with pytest.raises(Exception, match="no answer"):
        vector_cache.read_through(rows, "t", cache, encoder(failing=(last,)))
    stored = cache.read().count()
    assert stored == sum(s < steps[last] for s in steps.values()) > 30
    _, encoded = vector_cache.read_through(rows, "t", cache, encoder())
    assert encoded == 60 - stored and cache.read().count() == 60


# --- budgets over a stream


def events(r, n):
    return [(k, None, r.choice([1, 1, 1, 2, 3, None]), "view", float(k), None) for k in range(n)]


@pytest.mark.parametrize("cuts", [(), (1,), (10, 11, 55), (5, 30, 31, 60, 90)])
def test_any_cut_gives_the_rows_of_the_batch_query(spark, tmp_path, cuts):
    rows = events(random.Random(1), 100)
    before = [(1, 0), (1, 3), (2, 999), (None, 500)]
    done = spark.createDataFrame([*before, before[0]], "user_id long, event_id long")
    edges = [0, *cuts, len(rows)]
    target = f"file://{tmp_path}/out"
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        arrived = rows[a:b] + (rows[:b] if k % 2 else [])  # every second time all is delivered again
        spark.createDataFrame(arrived, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.01)
        # each run is a restart from the checkpoint
        budget.append_within_budget(read_events(spark, f"file://{tmp_path}/in"), "user_id", "event_id", 6, target, f"file://{tmp_path}/state", done).awaitTermination()
    ids = defaultdict(list)
    for u, e in before:
        ids[u].append(e)
    want = []
    for e, _, u, *_ in rows:
        if len(ids[u]) < 6 and e not in ids[u]:
            ids[u].append(e)
            want.append((u, e))
    got = [(x["user_id"], x["event_id"]) for x in spark.read.schema(EVENTS).json(target).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
