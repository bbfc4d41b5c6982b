"""Streams over the event table, run to their end."""

import os

import pytest
from pyspark.sql import functions as F

from gradewell.session import table
from gradewell.streaming import events as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    table(spark, SF, "events").repartition(3).write.parquet(path)
    return path


def test_windows(spark, folder, tmp_path):
    q = E.windowed_scores(E.read_events(spark, folder), "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == table(spark, SF, "events").count()


def test_append_new_is_idempotent(spark, folder, tmp_path):
    target = f"file://{tmp_path}/out"
    for k in range(2):  # a second consumer of the same files adds nothing
        E.append_new(E.read_events(spark, folder, 1), target, f"file://{tmp_path}/c{k}", ["event_id"]).awaitTermination()
    assert spark.read.parquet(target).count() == table(spark, SF, "events").count()
