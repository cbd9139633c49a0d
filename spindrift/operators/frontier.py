"""The frontier: exact deduplication, capacity, visited bounds, salvage.

All of them are joins, sorts with a limit, or unions on narrow frames; page bodies never
pass through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(offered: DataFrame, visited: DataFrame, key: str = "fingerprint", strict: bool = False) -> DataFrame:
    """Requests whose key hasn't been visited. Repeats among the offered pass, unless ``strict``."""
    new = offered.join(visited.select(key), key, "left_anti")
    return new.dropDuplicates([key]) if strict else new


def duplicates(offered: DataFrame, visited: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The offered requests that are skipped because their key was visited."""
    return offered.join(visited.select(key), key, "left_semi")


def cap(requests: DataFrame, order: list[str], room: int) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): the first ``room`` requests by ``order``, which must be unique.

    The first are found by a sort with limit, not by numbering all rows; the others are
    those after the last of them.
    """
    key = F.struct(*order)
    admitted = requests.orderBy(*order).limit(max(room, 0))
    last = admitted.agg(F.max(key).alias("__last"))
    marked = requests.crossJoin(F.broadcast(last))
    rejected = marked.where(F.col("__last").isNull() | (key > F.col("__last"))).drop("__last")
    return admitted, rejected


def mark_visited(visited: DataFrame, done: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The visited set with the keys of finished requests; keys stay unique."""
    return visited.select(key).unionByName(done.select(key)).distinct()


def lru(accesses: DataFrame, key: str, at: str, size: int) -> DataFrame:
    """The ``size`` keys accessed last (ties: the greater key)."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_access"))
    return last.orderBy(F.desc("last_access"), F.desc(key)).limit(size)


def idle_ttl(accesses: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Keys accessed within ``seconds`` of the latest access of all."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_access"))
    now = accesses.agg(F.max(at).alias("__now"))
    kept = last.crossJoin(F.broadcast(now)).where(F.col("last_access") > F.col("__now") - F.expr(f"INTERVAL {seconds} SECONDS"))
    return kept.drop("__now")


def salvage(frontier: DataFrame, salvaged: DataFrame) -> DataFrame:
    """Requests that couldn't be handed on return to the frontier."""
    return frontier.unionByName(salvaged.select(*frontier.columns))
