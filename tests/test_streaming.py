"""The sorting writer over several batches, and its refusal of late records."""

import pytest
from pyspark.sql import functions as F

from strandflow.streaming.cursor import sorted_writer, strict


def batches(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "key string, pos long, payload long").coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema("key string, pos long, payload long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def drained(out, folder, name):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)


PARTS = [[("a", 10, 1), ("a", 4, 2), ("b", 7, 3)], [("a", 8, 4), ("a", 30, 5), ("b", 7, 6)], [("a", 500, 7), ("b", 500, 8)]]


def test_records_come_in_order_within_the_window(spark, tmp_path):
    out = drained(sorted_writer(batches(spark, tmp_path, PARTS), "key", "pos", "payload", 6), tmp_path, "in_order").collect()
    for key in "ab":
        pos = [r["pos"] for r in out if r["key"] == key and not r["late"]]
        assert pos == sorted(pos)
    assert {(r["key"], r["pos"]) for r in out} == {("a", 4), ("a", 8), ("a", 10), ("a", 30), ("b", 7)} and not any(r["late"] for r in out)


def test_a_strict_writer_refuses_late_records(spark, tmp_path):
    late = [*PARTS[:2], [("a", 3, 9), ("a", 500, 7)]]
    rows = strict(sorted_writer(batches(spark, tmp_path, late), "key", "pos", "payload", 6), "key", "pos")
    with pytest.raises(Exception, match="out of order at a:3"):
        drained(rows, tmp_path, "refused")
    assert F is not None


def test_rows_of_an_appending_stream_are_not_held_by_the_driver(spark, sf):
    from strandflow import queries as Q

    out = Q.QUERIES["stream_sorted_writer"](spark, sf)
    assert out.inputFiles() and out.count() == spark.read.parquet(f"{sf}/events.parquet").count()
