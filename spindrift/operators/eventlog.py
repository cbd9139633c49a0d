"""The crawl-event log and everything that is counted over it.

One row is one effect. Counters are predicates over the log, never accumulators, so a
retried task can't count twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: counter -> (the events it counts); the names are those of the reference counters.
COUNTERS: dict[str, tuple[str, ...]] = {
    "requests_enqueued": ("enqueue_ok",),
    "requests_sent": ("fetch_ok", "fetch_failed"),
    "requests_succeeded": ("fetch_ok", "early_response"),
    "requests_failed": ("fetch_failed",),
    "requests_retried": ("retry",),
    "requests_dropped": ("drop",),
    "responses_received": ("fetch_ok", "early_response"),
    "items_scraped": ("parse_ok",),
    "items_processed": ("item_ok",),
    "items_dropped_by_pipeline": ("item_dropped",),
}
ANSWERED = ("fetch_ok", "early_response")
#: The effects that settle a request; only an answer that the chains let pass is a success.
HANDLED = ("fetch_ok", "early_response", "fetch_failed", "retry", "drop", "middleware_error")


def from_events(events: DataFrame) -> DataFrame:
    """The events table as a crawl log: the type and ``props.k`` choose the effect, ``value``
    is the duration in milliseconds, the user is the host."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    event = (
        F.when((kind == "view") & (k % 10 == 9), "early_response").when(kind == "view", "fetch_ok")
        .when((kind == "error") & (k % 3 == 0), "retry").when(kind == "error", "fetch_failed")
        .when((kind == "click") & (k % 7 == 0), "drop").when(kind == "click", "enqueue_ok")
        .when(kind == "signup", "parse_ok").when((kind == "purchase") & (k % 4 == 0), "item_dropped").otherwise("item_ok")
    )
    host = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    status = F.when(k % 5 == 0, 500).when(k % 5 == 1, 404).when(k % 5 == 2, 301).otherwise(200)
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event"), host.alias("host"),
        F.concat(host, F.lit("/"), k.cast("string")).alias("url"), status.cast("int").alias("status"), (k * 100).alias("bytes"),
        F.floor(F.col("value") * 1_000_000).cast("bigint").alias("duration_ns"), (k % 10 == 0).alias("cached"),
    )


def handled(log: DataFrame) -> DataFrame:
    """A row for each request that was handled, with ``failed``: no answer, or one that a chain
    dropped or sent back. A crawl's log marks these rows; other logs have an effect a request."""
    event = F.col("event")
    rows = log.where("settles") if "settles" in log.columns else log.where(event.isin(*HANDLED))
    return rows.withColumn("failed", ~event.isin(*ANSWERED))


def counters(log: DataFrame) -> DataFrame:
    """One row with all counters; zeros for an empty log."""
    event = F.col("event")
    aggs: list[Column] = [F.count_if(event.isin(*events)).alias(name) for name, events in COUNTERS.items()]
    aggs.append(F.count_if(event.isin(*ANSWERED) & F.col("cached")).alias("responses_from_cache"))
    aggs.append(F.coalesce(F.sum(F.when(event == "fetch_ok", F.col("bytes"))), F.lit(0)).cast("bigint").alias("total_bytes_downloaded"))
    return log.agg(*aggs)


def status_counts(log: DataFrame) -> DataFrame:
    return log.where(F.col("event").isin(*ANSWERED)).groupBy("status").agg(F.count("*").alias("n"))


def status_list(log: DataFrame) -> DataFrame:
    """One row: ``200: 5, 404: 1`` in the order of the codes, or ``none``."""
    pairs = status_counts(log).agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["status"].cast("string"), F.lit(": "), x["n"].cast("string"))), ", ")
    return pairs.select(F.when(F.size("p") > 0, text).otherwise("none").alias("statuses"))


def status_lines(log: DataFrame) -> DataFrame:
    """One row: a line ``- **200**: 5`` for each code, in their order, or ``N/A``."""
    pairs = status_counts(log).agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- **"), x["status"].cast("string"), F.lit("**: "), x["n"].cast("string"))), "\n")
    return pairs.select(F.when(F.size("p") > 0, text).otherwise("N/A").alias("statuses"))


def request_times(log: DataFrame) -> DataFrame:
    """(url, duration_ns): the last time recorded for each URL that was fetched."""
    timed = log.where(F.col("event").isin("fetch_ok", "fetch_failed"))
    return timed.groupBy("url").agg(F.max_by("duration_ns", F.struct("ts", "seq")).alias("duration_ns"))


def request_time(log: DataFrame, url: str) -> DataFrame:
    """The last time of one URL: one row, or none."""
    return request_times(log.where(F.col("url") == url))


def since(log: DataFrame, seq: int) -> DataFrame:
    """The log after ``seq``: times and counters start afresh."""
    return log.where(F.col("seq") > seq)


def time_summary(times: DataFrame) -> DataFrame:
    """count, average (whole nanoseconds), fastest and slowest; NULL where there is nothing."""
    return times.agg(
        F.count("*").alias("n"), F.expr("sum(duration_ns) div count(*)").cast("bigint").alias("average_ns"), F.min("duration_ns").alias("fastest_ns"), F.max("duration_ns").alias("slowest_ns")
    )


def parsing_times(log: DataFrame) -> DataFrame:
    """One row for each parse."""
    return log.where("event = 'parse_ok'").select("seq", "duration_ns")


def pipeline_times(processed: DataFrame) -> DataFrame:
    return processed.groupBy("pipeline").agg(F.count("*").alias("n"), F.sum("duration_ns").cast("bigint").alias("total_ns"))


METRICS = {"requests": ("fetch_ok", "fetch_failed"), "responses": ANSWERED, "items": ("parse_ok",)}


def rate_marks(log: DataFrame) -> DataFrame:
    """(metric, ts, seq): the events that the moving averages of requests, responses and items follow."""
    metrics = F.array_compact(F.array(*[F.when(F.col("event").isin(*events), F.lit(name)) for name, events in METRICS.items()]))
    return log.select(F.explode(metrics).alias("metric"), "ts", "seq")


def elapsed(log: DataFrame) -> DataFrame:
    """One row: the seconds from the first to the last event."""
    return log.agg((F.max("ts").cast("double") - F.min("ts").cast("double")).alias("seconds"))
