"""Ordered short-circuit chains over requests, responses and items.

A step maps a row to one of ``continue``, ``retry``, ``drop``, ``return`` (an early
response) or ``error``. The first step that doesn't continue decides. A chain compiles
to CASE expressions, whose branches Catalyst evaluates lazily.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("continue", "retry", "drop", "return", "error")


@dataclass(frozen=True)
class Step:
    """A named step; ``when`` lists (condition, action) pairs on requests, ``when_response`` on
    responses. The first condition that holds counts. ``response`` has the columns of the
    step's early responses (status 200 unless given)."""

    name: str
    when: list[tuple[Column, str]] = field(default_factory=list)
    delay_ms: int = 0
    when_response: list[tuple[Column, str]] = field(default_factory=list)
    response: dict[str, Column] = field(default_factory=dict)

    def gives(self, action: str) -> bool:
        return any(a == action for _, a in self.when)

    def action(self, response: bool = False) -> Column:
        out = F.lit("continue")
        for condition, action in reversed(self.when_response if response else self.when):
            if action not in ACTIONS:
                raise ValueError(f"{action} is no action")
            out = F.when(condition, F.lit(action)).otherwise(out)
        return out


def run_chain(rows: DataFrame, steps: list[Step], reverse: bool = False, response: bool = False) -> DataFrame:
    """Adds ``action``, ``decided_by`` (NULL if all continue), ``delay_ms`` and ``trace``, the
    steps that ran. Requests run in the order of registration, responses in reverse."""
    order = list(reversed(steps)) if reverse else list(steps)
    out = rows
    for i, step in enumerate(order):
        out = out.withColumn(f"__a{i}", step.action(response))
    action, by, delay = F.lit("continue"), F.lit(None).cast("string"), F.lit(0).cast("bigint")
    trace = F.lit(",".join(s.name for s in order))
    for i in range(len(order) - 1, -1, -1):
        stops = F.col(f"__a{i}") != "continue"
        action = F.when(stops, F.col(f"__a{i}")).otherwise(action)
        by = F.when(stops, F.lit(order[i].name)).otherwise(by)
        delay = F.when(stops & (F.col(f"__a{i}") == "retry"), F.lit(order[i].delay_ms).cast("bigint")).when(stops, F.lit(0).cast("bigint")).otherwise(delay)
        trace = F.when(stops, F.lit(",".join(s.name for s in order[: i + 1]))).otherwise(trace)
    out = out.withColumns({"action": action, "decided_by": by, "delay_ms": delay, "trace": trace})
    return out.drop(*[f"__a{i}" for i in range(len(order))])


def requeue(decided: DataFrame, round_ms: int, current: str = "round") -> DataFrame:
    """Rows to retry, with the first round in which their delay is over."""
    wait = F.greatest(F.ceil(F.col("delay_ms") / F.lit(float(round_ms))), F.lit(1)).cast("bigint")
    return decided.where(F.col("action") == "retry").withColumn("not_before_round", (F.col(current) + wait).cast("bigint"))


@dataclass(frozen=True)
class Pipeline:
    """An item pipeline: keeps items for which ``keep`` is true; false, NULL or ``fails`` drop them.

    ``state`` is an aggregate over the items that reached it; it is saved with snapshots and
    given to ``restore`` when a crawl resumes. ``close`` is called when the crawl has ended.
    """

    name: str
    keep: Column
    fails: Column | None = None
    state: Column | None = None
    restore: Callable[[dict], None] | None = None
    close: Callable[[], None] | None = None


def run_items(items: DataFrame, pipelines: list[Pipeline]) -> DataFrame:
    """Adds ``dropped_by`` (NULL for survivors) and ``drop_kind`` (``none`` or ``error``)."""
    by, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(pipelines):
        failed = F.coalesce(p.fails, F.lit(False)) if p.fails is not None else F.lit(False)
        gone = failed | ~F.coalesce(p.keep, F.lit(False))
        by = F.when(gone, F.lit(p.name)).otherwise(by)
        kind = F.when(failed, F.lit("error")).when(gone, F.lit("none")).otherwise(kind)
    return items.withColumns({"dropped_by": by, "drop_kind": kind})


def reached(processed: DataFrame, pipelines: list[Pipeline]) -> DataFrame:
    """One row for each item and pipeline that saw it: the base of a pipeline's counts and times."""
    names = F.array(*[F.lit(p.name) for p in pipelines])
    last = F.when(F.col("dropped_by").isNull(), F.size(names)).otherwise(F.array_position(names, F.col("dropped_by")).cast("int"))
    return processed.withColumn("pipeline", F.explode(F.slice(names, F.lit(1), last)))
