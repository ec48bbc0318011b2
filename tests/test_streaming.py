"""A stream of very many batches with an early late row."""

import datetime as dt
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewright.streaming import daily


def write_log(folder, batches, late_at=None):
    """One file, and so one batch, for every hour; the late row is of the first day."""
    start = dt.datetime(2024, 1, 1)
    for k in range(batches):
        ts = [start + dt.timedelta(hours=12 * k), start + dt.timedelta(hours=12 * k + 1)]
        kinds = ["a", "b"]
        if k == late_at:
            ts.append(start)
            kinds.append("late")
        path = f"{folder}/part-{k:04d}.parquet"
        pq.write_table(pa.table({"ts": pa.array(ts, pa.timestamp("us")), "kind": kinds}), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # a stream takes files by their times, which are not to tie


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_early_late_row_is_seen_after_a_hundred_batches(spark, tmp_path, few_partitions):
    write_log(tmp_path, 112, late_at=8)
    folder = str(tmp_path)
    every = daily.daily_windows(spark.read.parquet(folder), "ts", "kind")
    with pytest.raises(RuntimeError, match="after their day was final") as error:
        daily.run_to_end(daily.daily_windows(stream(spark, folder), "ts", "kind", "1 hour"), "late", every=every)
    late = spark.read.parquet(re.search(r"counted in (\S+)", str(error.value))[1])
    assert [tuple(r) for r in late.collect()] == [("2024-01-01", "late", 1)]


def test_late_rows_may_be_allowed_and_counts_are_those_of_the_log(spark, tmp_path, few_partitions):
    write_log(tmp_path, 12, late_at=8)
    folder = str(tmp_path)
    got = daily.run_to_end(daily.daily_windows(stream(spark, folder), "ts", "kind", "1 hour"), "allowed", drop_late=True)
    assert got.where("kind = 'late'").isEmpty() and got.agg(F.sum("cnt")).first()[0] == 24
    whole = daily.run_to_end(daily.daily_windows(stream(spark, folder), "ts", "kind"), "whole")
    want = daily.daily_windows(spark.read.parquet(folder), "ts", "kind")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))
