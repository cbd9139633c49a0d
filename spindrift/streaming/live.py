"""Live counters, deduplication and rates over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.scratch import scratch_path


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream; ``path`` is its file or folder. The number of files a
    micro-batch takes bounds what is in flight."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).format("parquet").option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).load(folder)


def hourly_counts(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Effects by hour and event."""
    return log.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour").alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event", "n")


def first_seen(log: DataFrame, within: str = "40 days") -> DataFrame:
    """The first row of each URL; its state is kept as long as the watermark asks."""
    return log.withWatermark("ts", within).dropDuplicatesWithinWatermark(["url"])


def rate_averages(log: DataFrame, alpha: float = 0.2, gate_s: float = 1.0) -> DataFrame:
    """(event, rate, pending): the time-gated moving average by event, as state.

    Rows of a micro-batch are put in order before they are folded in.
    """
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, since, n = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "seq"])
        for now in rows["us"].tolist():
            since = now if since is None else since
            n += 1
            passed = (now - since) / 1e6
            if passed >= gate_s:
                rate, since, n = alpha * (n / passed) + (1 - alpha) * rate, now, 0
        state.update((rate, since, n))
        yield pd.DataFrame({"event": [key[0]], "rate": [rate], "pending": [n]})

    timed = log.select("event", "seq", F.unix_micros("ts").alias("us"))
    return timed.groupBy("event").applyInPandasWithState(update, "event string, rate double, pending long", "rate double, since long, n long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what there is now, batch by batch into a written table; the table.

    In ``complete`` and ``update`` mode the rows of a later batch replace those before of
    the same batch number only, so that a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    where = scratch_path(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{where}/data")


def crawl_rounds(visited_path: str, key: str = "fingerprint"):
    """A foreachBatch sink that admits a batch's unseen keys and appends them to the visited
    table; a batch that is run again overwrites its own part."""
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(visited_path).where(F.col("batch") != number).select(key)
            new = batch.select(key).distinct().join(seen, key, "left_anti")
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            new = batch.select(key).distinct()
        new.write.mode("overwrite").parquet(f"{visited_path}/batch={number}")

    return sink
