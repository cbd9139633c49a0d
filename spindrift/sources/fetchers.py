"""Adapters for downloaders and parsers that are Python functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

FETCHED = "id long, url string, status int, body string, cached boolean, duration_ns long, error string"


def fetch_with(requests: DataFrame, get: Callable[[str], tuple[int, str]], tasks: int) -> DataFrame:
    """Responses to requests (id, url) from a Python function, in ``tasks`` parallel tasks.

    ``get`` returns (status, body); what it raises becomes ``error`` with a NULL status. One
    host goes to one task, so a polite ``get`` can pace itself.
    """
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("unknown"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, url in zip(frame["id"], frame["url"], strict=True):
                begun, status, body, error = time.monotonic_ns(), None, None, None
                try:
                    status, body = get(url)
                except Exception as why:  # a failed download is a row, not a failed job
                    error = f"{type(why).__name__}: {why}"
                rows.append((i, url, status, body, False, time.monotonic_ns() - begun, error))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FETCHED.split(", ")])
            yield out.astype({"status": "Int32"})

    return requests.select("id", "url").repartition(tasks, host).mapInPandas(run, FETCHED)


def parser(parse: Callable[[str, str], tuple[list[str], list[str]]]):
    """A table function for LATERAL joins: (url, body) to rows (kind, value), of kind ``item`` or
    ``request``, from a Python function that returns both lists."""

    @udtf(returnType="kind: string, value: string")
    class Parse:
        def eval(self, url: str, body: str):
            items, requests = parse(url, body)
            for value in items:
                yield "item", value
            for value in requests:
                yield "request", value

    return Parse


def parse_with(responses: DataFrame, parse: Callable[[str, str], tuple[list[str], list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(items, requests) of responses (url, body): the two halves of one tagged output."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, body in zip(frame["url"], frame["body"], strict=True):
                items, requests = parse(url, body)
                rows += [(url, "item", v) for v in items] + [(url, "request", v) for v in requests]
            yield pd.DataFrame(rows, columns=["url", "kind", "value"])

    tagged = responses.select("url", "body").mapInPandas(run, "url string, kind string, value string")
    return tagged.where("kind = 'item'").drop("kind"), tagged.where("kind = 'request'").drop("kind")
