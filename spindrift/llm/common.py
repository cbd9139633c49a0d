"""Helpers shared by the training-data operators: columns, tokens, rows of batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.scratch import discard, materialize, scratch_path, shared_dir, written  # noqa: F401

#: Word tokens used by the operators that compare or score words.
WORD = re.compile(r"\w+")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add (any letter case)."""
    gone = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def column(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` of ``df`` cast to ``kind``; NULL where the table lacks it."""
    if name.lower() in {c.lower() for c in df.columns}:
        return F.col(f"`{name}`").cast(kind)
    return F.lit(None).cast(kind)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class WordHasher:
    """64-bit hashes of words, equal in every process; recent words are remembered."""

    def __init__(self, limit: int = 250_000) -> None:
        self.known = _Hashes()
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rows_of(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples of the named columns."""
    for part in parts_of(batches, *names):
        yield from part


def parts_of(batches: Iterable, *names: str) -> Iterator[Iterator[tuple]]:
    """As :func:`rows_of`, batch by batch."""
    for batch in batches:
        yield zip(*(batch.column(n).to_pylist() for n in names), strict=True)
