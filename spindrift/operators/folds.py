"""Ordered folds: moving averages, the permit controller, the quota ledger.

A fold needs its rows in a total order. Rows are partitioned by the key of the fold and
sorted within partitions; a task then streams them with the state of one key, so no
group is ever collected to an array, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import eventlog

ENDPOINT_OLD, ENDPOINT_NEW, TARGET_MS = 0.7, 0.3, 1000


def fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], Any], result: Callable[[Any], tuple], schema: str) -> DataFrame:
    """(key, result...) of a fold over each key's rows in ``order``.

    ``schema`` is the DDL of the output, the key first. NULL keys form a group.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    ordered = rows.select(key, *dict.fromkeys([*order, *inputs])).repartition(key).sortWithinPartitions(key, *order).select(key, *inputs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        current, state, begun, out = None, None, False, []
        target = None
        for batch in batches:
            target = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or row[0] != current:
                    if begun:
                        out.append((current, *result(state)))
                    current, state, begun = row[0], start(), True
                state = step(state, row[1:])
            if len(out) > 10_000:
                yield _batch(out, names, target)
                out = []
        if begun:
            out.append((current, *result(state)))
        if out:
            yield _batch(out, names, target)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], key_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c) for c in columns[1:]]], names=names)


def endpoint_average(log: DataFrame) -> DataFrame:
    """(host, avg_ns, samples): the moving average of each host, truncated at every step.

    The first sample starts it; then 0.7 of the old and 0.3 of the new.
    """
    def step(state, row):
        average, n = state
        return (row[0] if not n else int(ENDPOINT_OLD * average + ENDPOINT_NEW * row[0]), n + 1)

    timed = eventlog.handled(log).where("duration_ns IS NOT NULL")
    return fold(timed, "host", ["ts", "seq"], ["duration_ns"], lambda: (0, 0), step, lambda s: s, "host string, avg_ns bigint, samples bigint")


def endpoint_errors(log: DataFrame) -> DataFrame:
    """(host, error_rate): the running mean of failures is the mean of failures. Requests
    that were dropped or sent back are failures, too."""
    return eventlog.handled(log).groupBy("host").agg(F.avg(F.col("failed").cast("double")).alias("error_rate"))


def rate_average(marks: DataFrame, key: str = "metric", alpha: float = 0.2, gate_s: float = 1.0) -> DataFrame:
    """(metric, rate, pending): the time-gated moving average of a rate.

    Events add up until ``gate_s`` has passed since the last update; the rate is then
    blended with the share ``alpha``. The clock starts at a metric's first event; without
    events the rate stays as it is. ``marks`` has the key and ts.
    """
    def step(state, row):
        rate, since, n = state
        now, events = row
        if since is None:
            since = now
        passed = (now - since) / 1e6
        if passed >= gate_s:  # the first of the instant's events makes the update, the others wait for the next
            return (alpha * ((n + 1) / passed) + (1 - alpha) * rate, now, events - 1)
        return (rate, since, n + events)

    # events of one instant are counted before they are shuffled: the fold sees a row an instant
    timed = marks.groupBy(key, F.unix_micros("ts").alias("us")).agg(F.count("*").alias("events"))
    return fold(timed, key, ["us"], ["us", "events"], lambda: (0.0, None, 0), step, lambda s: (s[0], s[2]), f"{key} string, rate double, pending bigint")


def next_permits(permits: int, mean_ms: int | None, error_rate: float | None, low: int, high: int, target_ms: int = TARGET_MS) -> int:
    """One tick of the permit controller; without metrics nothing changes."""
    if mean_ms is None or error_rate is None:
        return permits
    if mean_ms > target_ms:
        permits = max(permits - 1, low)
    elif mean_ms < target_ms // 2:
        permits = min(permits + 1, high)
    if error_rate > 0.1:
        permits = max(permits - 2, low)
    elif error_rate < 0.01:
        permits = min(permits + 1, high)
    return permits


def ticks(log: DataFrame, width: str = "1 day") -> DataFrame:
    """(tick, mean_ms, error_rate) by window: the unweighted means over the hosts' means."""
    timed = eventlog.handled(log).withColumn("tick", F.window("ts", width)["start"])
    hosts = timed.groupBy("tick", "host").agg(F.expr("sum(duration_ns) div count(duration_ns)").alias("ns"), F.avg(F.col("failed").cast("double")).alias("e"))
    return hosts.groupBy("tick").agg(F.expr("(sum(ns) div count(ns)) div 1000000").cast("bigint").alias("mean_ms"), F.round(F.avg("e"), 9).alias("error_rate"))


def permit_series(tick_rows: DataFrame, initial: int, low: int, high: int, target_ms: int = TARGET_MS) -> DataFrame:
    """(tick, permits) after each tick. One controller is one sequence, a row a tick: ticks are
    as many as windows of time, not as events, so one task streams them."""
    ordered = tick_rows.repartition(1).sortWithinPartitions("tick").select("tick", "mean_ms", "error_rate")

    def run(batches):
        permits = initial
        for batch in batches:
            out = []
            for mean, error in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                permits = next_permits(permits, mean, error, low, high, target_ms)
                out.append(permits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["tick", "permits"])

    return ordered.mapInArrow(run, "tick timestamp, permits bigint")


def current_permits(series: DataFrame, initial: int) -> DataFrame:
    """One row: the permits after the last tick of a series, or ``initial`` before any."""
    return series.agg(F.coalesce(F.max_by("permits", "tick"), F.lit(initial)).cast("bigint").alias("permits"))


def scale_workers(depth: int, workers: int, initial: int) -> int:
    """Parser workers after a look at their queue: one more above three responses a worker, up
    to four times the first number; one less below half a response a worker, down to it.
    Spark's dynamic allocation scales tasks; this is the rule for pools outside of it."""
    if depth > 3 * workers and workers < 4 * initial:
        return workers + 1
    return workers - 1 if depth < workers // 2 and workers > initial else workers


def quota_step(state: tuple[int, dict[str, int]], total: int, op: str, component: str, amount: int | None) -> tuple[tuple[int, dict[str, int]], bool]:
    """(state, ok) after one command. A second allocation of a component overwrites what
    is known of its first, so that a release returns only the last."""
    used, held = state
    if op == "allocate":
        if used + (amount or 0) > total:
            return (used, held), False
        return (used + (amount or 0), held | {component: amount or 0}), True
    back = held.get(component, 0)
    return (max(used - back, 0), {c: n for c, n in held.items() if c != component}), True


def available(ledger: DataFrame, total: int) -> DataFrame:
    """One row: what is left after the last command of a ledger."""
    return ledger.agg(F.coalesce(F.max_by("available", "seq"), F.lit(total)).alias("available"))


def allocations(ledger: DataFrame) -> DataFrame:
    """(component, amount) held after the last command that changed each component."""
    last = ledger.where("ok").groupBy("component").agg(F.max_by(F.struct("op", "amount"), "seq").alias("x"))
    return last.where("x.op = 'allocate'").select("component", F.col("x.amount").alias("amount"))


def quota_ledger(commands: DataFrame, total: int) -> DataFrame:
    """(seq, op, component, amount, ok, available) of a command log in the order of seq."""
    ordered = commands.select("seq", "op", "component", F.col("amount").cast("bigint").alias("amount")).repartition(1).sortWithinPartitions("seq")

    def run(batches):
        state: tuple[int, dict[str, int]] = (0, {})
        for batch in batches:
            oks, free = [], []
            for op, component, amount in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                state, ok = quota_step(state, total, op, component, amount)
                oks.append(ok)
                free.append(total - state[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(oks), pa.array(free, pa.int64())], names=["seq", "op", "component", "amount", "ok", "available"])

    return ordered.mapInArrow(run, "seq bigint, op string, component string, amount bigint, ok boolean, available bigint")
