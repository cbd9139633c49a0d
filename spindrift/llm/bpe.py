"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that ends its BPE
encoding. An automaton over the vocabulary lists the tokens that end at each
position; of those, the one whose predecessor (the stored last token of the prefix
before it) is *compatible* is stored. Two tokens are compatible if undoing the
merges that made them never meets a merge across their border that BPE would have
made first. Following the back-pointers from the end emits the exact ids, without
a merge loop; time is linear in the text times the tokens that end at a position.

Vocabulary files are read from a path that is a parameter; they aren't part of the
repository. Pieces are split by the vocabulary's pattern, and the ids of recent
pieces are remembered (the memory is bounded and never changes a result).

Defined results
---------------
* NULL text: NULL ids and NULL n_tokens. Empty text: no ids, 0.
* Strings of special tokens are ordinary text. Very long texts and pieces are encoded
  whole. Repeated rows are encoded each. Empty table: no rows.
* Columns named like the added ones are replaced; NULLs elsewhere are carried along.
* Decoding ids that aren't in the vocabulary raises an error; ids whose bytes aren't
  UTF-8 decode with replacement characters; NULL ids decode to NULL.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 250_000


class Bpe:
    """Encoder and decoder of one vocabulary of byte sequences and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.checked: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for data, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(data) == 1:
                self.halves[rank] = (rank, rank)
            else:
                for cut in range(1, len(data)):
                    left, right = ranks.get(data[:cut]), ranks.get(data[cut:])
                    if left in self.halves and right in self.halves and self._fits(left, right):
                        self.halves[rank] = (left, right)
                        self.merged[(left, right)] = rank
                        break
                else:
                    continue  # no sequence of merges makes this token
            automaton.add_word(data.decode("latin-1"), (rank, len(data)))
        automaton.make_automaton()
        self.endings = automaton.iter

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two adjacent tokens."""
        merged, halves, bound = self.merged.get, self.halves, 1 << 62
        while True:
            if merged((left, right), bound) < bound:
                return False
            undo_left = left > right
            for _ in range(2):  # undo the later merge; at a single byte, turn to the other side
                if undo_left:
                    bound, left = left, halves[left][1]
                    if left != bound:
                        break
                else:
                    bound, right = right + 1, halves[right][0]
                    if right + 1 != bound:
                        break
                undo_left = not undo_left
            else:
                return True

    def _compatible(self, left: int, right: int) -> bool:
        known = self.checked.get((left, right))
        if known is None:
            if len(self.checked) > REMEMBERED:
                self.checked.clear()
            known = self.checked[(left, right)] = self._fits(left, right)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        last: list[int] = [-1] * (len(data) + 1)
        size: list[int] = [0] * (len(data) + 1)
        for at, (token, length) in self.endings(data.decode("latin-1")):
            end = at + 1
            start = end - length
            if not size[end] and (start == 0 or (size[start] and self._compatible(last[start], token))):
                last[end], size[end] = token, length
        out, end = [], len(data)
        while end:
            if not size[end]:
                raise ValueError("the vocabulary lacks single bytes of this text")
            out.append(last[end])
            end -= size[end]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        parts = self.find(text)
        known = self.pieces
        try:
            return list(chain.from_iterable(map(known.__getitem__, parts)))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for part in set(parts):
                if part not in known:
                    known[part] = self.encode_piece(part)
            return list(chain.from_iterable(map(known.__getitem__, parts)))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    """The vocabulary in a file of lines ``base64-bytes rank``; once a process."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def _encoded(texts: list[str | None], bpe: Bpe) -> tuple[pa.Array, pa.Array]:
    ids = [None if t is None else bpe.encode(t) for t in texts]
    counts = np.fromiter((len(i) if i is not None else 0 for i in ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.array(np.fromiter(chain.from_iterable(i for i in ids if i is not None), np.int32, int(offsets[-1])))
    missing = np.fromiter((i is None for i in ids), bool, len(ids))
    arrays = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), values) if missing.any() else pa.ListArray.from_arrays(pa.array(offsets), values)
    return arrays, pa.array(counts.astype(np.int32), mask=missing)


def _slices(batch: pa.RecordBatch, text_at: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about ``limit`` bytes of text, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)).astype(np.int64)
    marks = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.diff(marks, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(lengths)), strict=True):
        yield batch.slice(int(a), int(b - a))


def bpe_encode(df: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", keep_text: bool = False, check: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``n_tokens``; without the text unless ``keep_text``.

    ``check`` adds ``round_trip``: whether decoding gives the text again. A map over
    the rows, without shuffle; only columns that are kept leave the JVM.
    """
    added = ["ids", "n_tokens", *(["round_trip"] if check else [])]
    base = without(df, *[a for a in added if a != text.lower()])
    names = base.columns
    at = [c.lower() for c in names].index(text.lower())
    kept = [i for i in range(len(names)) if keep_text or i != at]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    plain = {names[i]: f"c{i}" for i in range(len(names))}
    renamed = base.toDF(*[plain[n] for n in names]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    schema = ", ".join([f"c{i} {'string' if i == at else kinds[names[i]]}" for i in kept] + ["ids array<int>", "n_tokens int"] + (["round_trip boolean"] if check else []))

    def encode(batches):
        bpe = load(vocabulary, pattern)
        for whole in batches:
            for batch in _slices(whole, at):
                texts = batch.column(at).to_pylist()
                ids, counts = _encoded(texts, bpe)
                arrays = [batch.column(i) for i in kept] + [ids, counts]
                if check:
                    flat, offsets = np.asarray(ids.values), np.asarray(ids.offsets)
                    arrays.append(pa.array([None if t is None else bpe.decode(flat[a:b].tolist()) == t for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in kept] + added)

    return renamed.mapInArrow(encode, schema).toDF(*[names[i] for i in kept], *added)


def bpe_decode(df: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of ``ids`` as column ``out`` (replaced if there)."""
    base = without(df, out) if out.lower() != ids.lower() else df
    names = base.columns
    at = [c.lower() for c in names].index(ids.lower())
    kinds = [f.dataType.simpleString() for f in base.schema.fields]
    schema = ", ".join([f"c{i} {k}" for i, k in enumerate(kinds)] + ["decoded string"])

    def decode(batches):
        bpe = load(vocabulary)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return base.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(decode, schema).toDF(*names, out)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict = {}
