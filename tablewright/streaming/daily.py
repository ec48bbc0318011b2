"""Daily counts of an append-only log as a stream."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from tablewright.plans.durable import scratch_path
from tablewright.plans.types import epoch_micros

MICROS_PER_DAY = 86_400_000_000
#: How long the report of a stream's end may take.
LISTEN_SECONDS = 120


def stream_log(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def daily_windows(log: DataFrame, ts: str, key: str, lateness: str | None = None) -> DataFrame:
    """Rows per day and key.

    With ``lateness`` a day is final once the watermark has passed its end, and its state goes; rows that come later are
    dropped.  Without it, as for the replay of a bounded log, every row counts however late.
    """
    # wall-clock time read as UTC on the way in and out, so days do not depend on the session's time zone
    timed = log.withColumn("_at", F.timestamp_micros(epoch_micros(F.col(ts))))
    timed = timed if lateness is None else timed.withWatermark("_at", lateness)
    counts = timed.groupBy(F.window("_at", "1 day"), key).agg(F.count("*").alias("cnt"))
    day = F.floor(F.unix_micros("window.start") / MICROS_PER_DAY).cast("int")
    return counts.select(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string").alias("date"), key, "cnt")


class _Dropped(StreamingQueryListener):
    """Sums what a watermark drops over all batches of one run; a query itself remembers its last batches only."""

    def __init__(self) -> None:
        self.by_run: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802  names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        self.by_run[run] = self.by_run.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(str(event.runId)).set()

    def total(self, run: str) -> int:
        """The sum, once the end of the run has been heard of: events come in order."""
        if not self._end(run).wait(LISTEN_SECONDS):
            raise RuntimeError("the end of the stream was not reported")
        return self.by_run.get(run, 0)


def run_to_end(counts: DataFrame, name: str, drop_late: bool = False, every: DataFrame | None = None) -> DataFrame:
    """Process everything that is there and return the final counts; rows dropped as late are an error unless allowed.

    Every batch rewrites the days it changed below its own number; the newest number per day and key wins,
    so a batch that runs again after a failure replaces itself.  ``every`` are the counts of the whole log as a batch: with
    them, what came late is kept by day and key in the table ``late`` beside the result.
    """
    spark = counts.sparkSession
    folder = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    listener = _Dropped()
    spark.streams.addListener(listener)
    try:
        query = (
            counts.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        late = listener.total(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    schema = T.StructType([*counts.schema.fields, T.StructField("batch", T.IntegerType())])
    keys = [c for c in counts.columns if c != "cnt"]
    result = spark.read.schema(schema).parquet(f"{folder}/result").groupBy(*keys).agg(F.max_by("cnt", "batch").alias("cnt"))
    if late and every is not None:
        same = [F.col(f"e.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        missed = F.col("e.cnt") - F.coalesce("r.cnt", F.lit(0))
        both = every.alias("e").join(result.alias("r"), same, "left").select(*[f"e.{k}" for k in keys], missed.alias("cnt"))
        both.where("cnt > 0").write.parquet(f"{folder}/late")
    if late and not drop_late:
        kept = f"; they are counted in {folder}/late" if every is not None else ""
        raise RuntimeError(f"rows came after their day was final{kept}")
    return result
