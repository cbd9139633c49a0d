"""Statistics snapshots and their exports: JSON, Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import formats
from spindrift.operators import eventlog


def snapshot(log: DataFrame) -> DataFrame:
    """One row: counters, times, statuses, elapsed seconds and rates."""
    base = (
        eventlog.counters(log)
        .crossJoin(eventlog.time_summary(eventlog.request_times(log)).select(F.col("n").alias("request_times"), F.col("average_ns").alias("avg_request_ns"), F.col("fastest_ns").alias("fastest_request_ns"), F.col("slowest_ns").alias("slowest_request_ns")))
        .crossJoin(eventlog.time_summary(eventlog.parsing_times(log)).select(F.col("n").alias("parses"), F.col("average_ns").alias("avg_parse_ns"), F.col("fastest_ns").alias("fastest_parse_ns"), F.col("slowest_ns").alias("slowest_parse_ns")))
        .crossJoin(eventlog.status_list(log))
        .crossJoin(eventlog.elapsed(log))
    )
    rates = {f"{c}_per_second": formats.rate(F.col(n), F.col("seconds")) for c, n in (("requests", "requests_sent"), ("responses", "responses_received"), ("items", "items_scraped"))}
    return base.withColumns(rates)


def to_json(snap: DataFrame, pretty: bool = False) -> DataFrame:
    """One row, one string: the snapshot as a JSON object."""
    return snap.select(F.to_json(F.struct(*snap.columns), {"pretty": str(pretty).lower()}).alias("json"))


def _lines(snap_columns: list[tuple[str, Column]], line: str) -> Column:
    return F.concat_ws("\n", *[F.format_string(line, F.lit(name), value.cast("string")) for name, value in snap_columns])


def _fields() -> list[tuple[str, Column]]:
    return [
        ("Requests enqueued", F.col("requests_enqueued")), ("Requests sent", F.col("requests_sent")), ("Requests succeeded", F.col("requests_succeeded")), ("Requests failed", F.col("requests_failed")),
        ("Requests retried", F.col("requests_retried")), ("Requests dropped", F.col("requests_dropped")), ("Responses received", F.col("responses_received")), ("From cache", F.col("responses_from_cache")),
        ("Downloaded", formats.format_bytes(F.col("total_bytes_downloaded"))), ("Items scraped", F.col("items_scraped")), ("Items processed", F.col("items_processed")), ("Items dropped", F.col("items_dropped_by_pipeline")),
        ("Average request", formats.format_ns(F.col("avg_request_ns"))), ("Fastest request", formats.format_ns(F.col("fastest_request_ns"))), ("Slowest request", formats.format_ns(F.col("slowest_request_ns"))),
        ("Average parse", formats.format_ns(F.col("avg_parse_ns"))), ("Statuses", F.col("statuses")), ("Elapsed", formats.format_elapsed(F.col("seconds"))),
        ("Requests a second, overall", F.format_string("%.2f", F.col("requests_per_second"))), ("Requests a second, whole seconds", F.format_string("%.2f", formats.whole_second_rate(F.col("requests_sent"), F.col("seconds")))),
    ]


def to_markdown(snap: DataFrame) -> DataFrame:
    """One row, one string: a table of two columns."""
    return snap.select(F.concat(F.lit("# Crawl statistics\n\n| measure | value |\n| --- | --- |\n"), _lines(_fields(), "| %s | %s |")).alias("markdown"))


def to_text(snap: DataFrame) -> DataFrame:
    return snap.select(F.concat(F.lit("Crawl statistics\n"), _lines(_fields(), "%s: %s")).alias("text"))
