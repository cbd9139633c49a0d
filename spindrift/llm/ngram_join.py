"""N-gram Jaccard join by parity sketches.

A document is the set of its word n-grams. Within a size band every set is hashed
into a sketch of C words of 2^32 bits: an n-gram flips one bit of one word (XOR), so
the Hamming distance of two sketches is at most the symmetric difference of the
sets. Jaccard >= t bounds that difference by D = (1-t)/(1+t) (|a|+|b|), hence at
most D words differ: of any D+1 non-empty words of a document one must recur in its
partner at the same place (pigeonhole), and of any D+s words s must. The sketch is
sparse; a word is kept as the XOR of 64-bit hashes of its set bits, which flips with
the same parity. A document emits D+s of its words as join keys, s by band, those
expected to be rarest by the document frequencies of all n-grams in the corpus; a common
total order of the keys makes this a prefix filter: a pair shares s keys at least.
Documents with fewer non-empty words emit all words, empty ones too, which covers pairs
of such documents.

1. Sets: one scan writes the n-gram hashes of all documents to chunk files in the shared
   folder, and a narrow table says where each document's set is. Equal sets are one class.
2. Frequencies: each chunk's distinct n-grams go to the reducers packed, some 3 bytes
   each, and come back as a byte of surprise each. They are exact at every size.
3. Keys: each chunk's keys go to the reducers packed, some 6 bytes a key.
4. Cells: sets that share a key meet at the least of them, the centre: m sets give m
   places, not m^2 pairs. Any two sets that share a key have a centre in common. A set
   leaves the cells that it shares its fewest keys with, as long as these are fewer than
   s/2 keys together: of the s keys that a pair shares, one then stays in both.
5. Filter: the sets of a cell are compared by short parity sketches of one bit array, whose
   Hamming distance also bounds the difference. A set with no near partner leaves the cell.
6. Verification: the n-gram hashes of the remaining sets are compared exactly, as bit
   matrices. A pair is counted in the least centre that its sets share, so once.

No pair is ever a row of a shuffle: cells return a number of links and a root for each
set. Large cells are cut into blocks that meet two by two in different tasks. The plan
is the same at every size; nothing is broadcast.

A document joins the band of its own size, and the band above if a partner of that
size is still possible.

Defined results
---------------
* Texts of fewer than n words have their whole word sequence as the only n-gram. NULL
  texts and texts without any word match nothing, not even each other.
* Words are compared in lower case. Repeated rows and equal texts are links of Jaccard 1
  (between different rows of the same doc_id too). A NULL doc_id takes part and shows
  as NULL.
* n-grams are told apart by 40 bits of their hashes and whole sets by 64, which can only
  mistake a pair whose Jaccard is within one n-gram of t (a chance below 1e-6 for sets of
  1,000). Keys of 48 bits only add candidates.
* Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.common import WORD, WordHasher, column, discard, fresh, materialize, mix64, open_path, parts_of, scratch_path, table

N, THRESHOLD = 2, 0.75
#: The ratio of a band's bounds; steps of surprise per bit.
RATIO, STEPS = 2.0, 8
#: The fewer places, the more n-grams a word holds and the rarer it is; small sets need more.
#: SPREAD is in units of (1-t)/(1+t) of a band's lower bound: words of a band differ at most 4
#: such units, so it is above 4 and SHARED, the keys that a pair has in common at least (1 in small bands).
SPREAD, SHARED, SMALL_SPREAD, SMALL_BAND = 5.0, 0.5, 0.9, 6
MOST_PLACES = 1 << 24
#: n-grams and sets of a chunk file; n-grams whose keys (about half as many) one task holds at a time.
CHUNK_GRAMS, CHUNK_SETS, PART_GRAMS = 1_500_000, 1 << 16, 6_000_000
#: Sets and bytes of a block: cells with more are cut into blocks. Columns of a bit matrix at a time.
BLOCK_SETS, BLOCK_BYTES, COLUMNS = 1000, 4_000_000, 1 << 14
GRAM_BYTES = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_set(words: list[str], n: int, hasher: WordHasher) -> np.ndarray:
    """The sorted distinct hashes (40 bits) of a text's n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    h = hasher(words)
    width = min(n, len(words))
    g = h[: len(words) - width + 1] * _ODD + np.uint64(width)
    for i in range(1, width):
        g ^= g >> np.uint64(29)
        g = (g + h[i : len(words) - width + 1 + i]) * _ODD
    g = np.sort((g ^ (g >> np.uint64(32))) & np.uint64(0xFFFFFFFFFF))
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


@lru_cache(maxsize=100_000)
def bands(size: int, t: float) -> list[tuple[int, int]]:
    """(band, D): the bands a set of this size joins, and the most words that may differ there."""
    own = own_band(size)
    ratio = (1 - t) / (1 + t)
    top = np.ceil(RATIO ** (own + 1)) - 1
    largest = np.floor(size / t + 1e-9)
    out = [(own, int(ratio * (size + min(largest, top)) + 1e-9))]
    if largest >= np.ceil(RATIO ** (own + 1)):
        out.append((own + 1, int(ratio * (size + largest) + 1e-9)))
    return out


@lru_cache(maxsize=100_000)
def own_band(size: int) -> int:
    own = int(np.floor(np.log(size) / np.log(RATIO) + 1e-12))
    while RATIO ** (own + 1) <= size:
        own += 1
    while RATIO**own > size:
        own -= 1
    return own


def places(band: int, t: float) -> int:
    """Words of a sketch of this band: more than may differ at Jaccard t, up to 2^24."""
    spread = SPREAD * (1 - t) / (1 + t)
    return min(int(np.ceil((spread if band >= SMALL_BAND else max(spread, SMALL_SPREAD)) * RATIO**band)) + 1, MOST_PLACES)


def shared_keys(band: int, t: float) -> int:
    """Keys that two sets of Jaccard t have in common at least, in the band of the larger one."""
    if band < SMALL_BAND or places(band, t) == MOST_PLACES:
        return 1
    return max(int(SHARED * (1 - t) / (1 + t) * RATIO**band), 1)


def slack(size: Column, t: float) -> Column:
    """Shared keys that a set of this size may leave out of account: less than half of :func:`shared_keys`."""
    # the bands are few; the width of the binary form is the band (RATIO is 2)
    least = [(shared_keys(band, t) - 1) // 2 for band in range(64)]
    return F.element_at(F.array(*[F.lit(v) for v in least]), F.length(F.bin(size)))


def surprise(counts: np.ndarray, sets: int) -> np.ndarray:
    """Steps of surprise at n-grams that ``counts`` of the sets have, uint8."""
    return np.round(STEPS * np.log2((sets + 1.0) / (counts + 0.5))).clip(0, 255).astype(np.uint8)


def sketch_keys(grams: np.ndarray, rarity: np.ndarray, t: float) -> list[np.ndarray]:
    """For each band of a set: its join keys in their common order.

    ``grams`` are 32 bits of the n-grams' hashes, ``rarity`` their surprise. Folding
    hashes can only bring two sets closer, so the bound on differing words holds for them.
    """
    out = []
    wide = grams.astype(np.uint64)
    tail = wide << np.uint64(8) | rarity
    for band, d in bands(len(grams), t):
        count, need = places(band, t), d + shared_keys(band, t)
        v = np.sort((wide % np.uint64(count)) << np.uint64(40) | tail)
        place = v >> np.uint64(40)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        words = np.bitwise_xor.reduceat(mix64((v >> np.uint64(8)) ^ _seed(band)), starts)
        rare = np.add.reduceat(v & np.uint64(255), starts)
        place = place[starts]
        some = words != 0
        if not some.all():
            words, rare, place = words[some], rare[some], place[some]
        key = words
        if len(key) > need:
            # the common order: rarest first, then by the key itself
            order = (np.uint64((1 << 24) - 1) - np.minimum(rare, np.uint64((1 << 24) - 1))) << np.uint64(40) | key >> np.uint64(24)
            key = key[np.argsort(order)[:need]]
        elif len(key) < need:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), place, assume_unique=True)
            key = np.concatenate([key, np.sort(mix64(mix64(_seed(band) ^ np.uint64(1 << 63)) ^ (empty + np.uint64(7))))])
            if count <= d:  # only where places() is at its limit: all words may differ, so such sets all meet
                key = np.concatenate([key, mix64(_seed(band) ^ np.uint64(3 << 62))])
        out.append(key)
    return out


def _seed(band: int) -> np.ndarray:
    return np.array([(band + 1) * 0x100000001B3], np.uint64)


# ---- chunk files ----------------------------------------------------------------------


class Chunk:
    """The sets of a chunk file: sizes, then 32 low and 8 high bits of every n-gram's hash."""

    def __init__(self, path: str) -> None:
        fs, where = open_path(path)
        with fs.open_input_file(where) as f:
            data = f.read()
        count = int(np.frombuffer(data, np.uint64, 1)[0])
        self.sizes = np.frombuffer(data, np.uint32, count, 8)
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])
        total, at = int(self.cuts[-1]), 8 + 4 * count
        self.low = np.frombuffer(data, np.uint32, total, at)
        self.high = np.frombuffer(data, np.uint8, total, at + 4 * total)

    def part(self, pos: int) -> slice:
        return slice(int(self.cuts[pos]), int(self.cuts[pos + 1]))

    def lows(self, spots: list[int]) -> np.ndarray:
        return np.concatenate([self.low[self.part(pos)] for pos in spots])

    def grams(self, pos: int) -> bytes:
        some = self.part(pos)
        return self.low[some].tobytes() + self.high[some].tobytes()

    @staticmethod
    def write(path: str, sets: list[np.ndarray]) -> None:
        fs, where = open_path(path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        flat = np.concatenate(sets)
        with fs.open_output_stream(where, compression=None) as out:
            out.write(np.array([len(sets)], np.uint64).tobytes())
            out.write(np.array([len(s) for s in sets], np.uint32).tobytes())
            out.write(flat.astype(np.uint32).tobytes())
            out.write((flat >> np.uint64(32)).astype(np.uint8).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """The hashes that :meth:`Chunk.grams` packed, sorted."""
    n = len(data) // GRAM_BYTES
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


_FOUND = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("th", pa.int64()), ("sid", pa.int64()), ("num", pa.int64()), ("size", pa.int64()), ("path", pa.string())])


def _sets(rows: DataFrame, n: int, where: str) -> DataFrame:
    """kind 0: (doc_id, th, sid, num, size) of every document; kind 1: num is a chunk, path its
    file.

    A set's number is its task, chunk and place. Every attempt of a task writes files of
    its own, and rows only name those of the attempt that was committed.
    """

    def scan(batches):
        hasher, seen = WordHasher(), {}
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        sets: list[np.ndarray] = []
        held = chunks = 0
        find = WORD.findall

        def closed() -> tuple:
            number = task << 20 | chunks
            path = f"{where}/{number:x}-{attempt}.bin"
            Chunk.write(path, sets)
            return (1, None, None, None, number, None, path)

        for part in parts_of(batches, "doc_id", "th", "text"):
            out = []
            for doc_id, th, text in part:
                grams = gram_set(find(text.lower()), n, hasher) if text else ()
                if not len(grams):
                    out.append((0, doc_id, th, None, None, 0, None))
                    continue
                sid = set_id(grams)
                at = seen.get(sid)
                if at is None:
                    at = (task << 20 | chunks) << 20 | len(sets)
                    if len(seen) < 200_000:
                        seen[sid] = at
                    sets.append(grams)
                    held += len(grams)
                out.append((0, doc_id, th, sid, at, len(grams), None))
                if held >= CHUNK_GRAMS or len(sets) == CHUNK_SETS:
                    out.append(closed())
                    sets, held, chunks = [], 0, chunks + 1
            if out:
                yield _batch(out, _FOUND)
        if sets:
            yield _batch([closed()], _FOUND)

    return rows.mapInArrow(scan, "kind byte, doc_id bigint, th bigint, sid bigint, num bigint, size bigint, path string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---- keys and cells -------------------------------------------------------------------


def _cut(values: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to): the sorted values (32 bits) by equal ranges."""
    part = values.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
    names, starts = np.unique(part, return_index=True)
    yield from zip(names.tolist(), starts.tolist(), np.append(starts[1:], len(values)).tolist(), strict=True)


def packed_counts(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values of 32 bits as steps of 16 (or 32) bits, and their counts up to 255."""
    step = np.diff(values.astype(np.int64), prepend=int(values[0]))
    wide = step >= 0xFFFF
    head = np.array([len(values), values[0]], np.int64)
    return head.tobytes() + np.where(wide, 0xFFFF, step).astype(np.uint16).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + step[wide].astype(np.uint32).tobytes()


def opened_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first = np.frombuffer(data, np.int64, 2).tolist()
    step = np.frombuffer(data, np.uint16, n, 16).astype(np.int64)
    step[step == 0xFFFF] = np.frombuffer(data, np.uint32, offset=16 + 3 * n)
    return (np.cumsum(step) + first).astype(np.uint32), np.frombuffer(data, np.uint8, n, 16 + 2 * n)


def _gram_counts(wanted: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, data): each chunk's distinct n-grams and in how many of its sets they are."""

    def scan(batches):
        for rows in parts_of(batches, "path", "chunk", "spots"):
            for path, number, spots in rows:
                value, count = np.unique(Chunk(path).lows(spots), return_counts=True)
                cut = list(_cut(value, parts))
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([number] * len(cut), pa.int64()), pa.array([packed_counts(value[a:b], count[a:b]) for _, a, b in cut], pa.binary())], names=["part", "chunk", "data"])

    return wanted.mapInArrow(scan, "part int, chunk bigint, data binary")


def _surprises(sets: int):
    """(chunk, part, data): a byte of surprise for each n-gram of the chunk in this part, in order."""

    def run(batches):
        found: dict[int, list] = {}
        for rows in parts_of(batches, "part", "chunk", "data"):
            for part, number, data in rows:
                found.setdefault(part, []).append((number, *opened_counts(data)))
        for part in sorted(found):
            numbers, values, counts = zip(*found.pop(part), strict=True)
            _, at = np.unique(np.concatenate(values), return_inverse=True)
            rare = surprise(np.bincount(at, np.concatenate(counts)), sets)[at]
            ends = np.cumsum([len(v) for v in values]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32()), pa.array([rare[b - len(v) : b].tobytes() for b, v in zip(ends, values, strict=True)], pa.binary())], names=["chunk", "part", "data"])

    return run


def _blobs(wanted: DataFrame, t: float, parts: int) -> DataFrame:
    """(part, data): the keys of the chunks' wanted sets, packed by ranges of the key.

    ``wanted`` (path, chunk, spots, rare) has the bytes of surprise by part. data: the chunk's
    number, the first of the key's upper 16 bits (of 48) and how many keys have this and
    the following values; 32 lower bits and the place of the set by key.
    """

    def scan(batches):
        for rows in parts_of(batches, "path", "chunk", "spots", "rare"):
            for path, number, spots, rare in rows:
                chunk = Chunk(path)
                at = np.unique(chunk.lows(spots), return_inverse=True)[1]
                rarity = np.frombuffer(b"".join(r["data"] for r in rare), np.uint8)[at].astype(np.uint64)
                keys, owners, seen = [], [], 0
                for pos in spots:
                    grams = chunk.low[chunk.part(pos)]
                    for key in sketch_keys(grams, rarity[seen : seen + len(grams)], t):
                        keys.append(key >> np.uint64(16))
                        owners.append(np.full(len(key), pos, np.uint16))
                    seen += len(grams)
                key, owner = np.concatenate(keys), np.concatenate(owners)
                del keys, owners, chunk, at, rarity
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                names, data = [], []
                for part, a, b in _cut((key >> np.uint64(16)).astype(np.uint32), parts):
                    names.append(part)
                    top = (key[a:b] >> np.uint64(32)).astype(np.int64)
                    counts = np.bincount(top - top[0]).astype(np.uint32)
                    data.append(np.array([number, top[0], len(counts)], np.int64).tobytes() + counts.tobytes() + key[a:b].astype(np.uint32).tobytes() + owner[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    return wanted.mapInArrow(scan, "part int, data binary")


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set numbers) of a blob."""
    number, first, values = np.frombuffer(data, np.int64, 3).tolist()
    counts = np.frombuffer(data, np.uint32, values, 24)
    n, at = int(counts.sum()), 24 + 4 * values
    key = np.repeat(np.arange(first, first + values, dtype=np.uint64) << np.uint64(32), counts) | np.frombuffer(data, np.uint32, n, at)
    return key, np.frombuffer(data, np.uint16, n, at + 4 * n).astype(np.int64) | number << 20


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """(a, c, n): sets that share n keys of this part with others of which c is the least."""
    found: dict[int, list] = {}
    for rows in parts_of(batches, "part", "data"):
        for part, data in rows:
            found.setdefault(part, []).append(_opened(data))
    for part in sorted(found):
        key, num = (np.concatenate(x) for x in zip(*found.pop(part), strict=True))
        order = np.lexsort((num, key))
        key, num = key[order], num[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(key)))
        lone = np.repeat(lengths == 1, lengths)
        a, c = num[~lone], np.repeat(num[starts], lengths)[~lone]
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        starts = np.flatnonzero(new) if len(a) else np.empty(0, np.int64)
        if len(starts):
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(c[starts]), pa.array(np.diff(np.append(starts, len(a))))], names=["a", "c", "n"])


def sketch_bytes(size: int) -> int:
    """Bytes of the short sketch of a set: 2 bits per n-gram of its band's lower bound, 32 at least."""
    return max(int(RATIO ** own_band(size)) // 4, 32)


def short_sketch(low: np.ndarray) -> bytes:
    """One array of bits, each the parity of the n-grams at its place."""
    bits = 8 * sketch_bytes(len(low))
    return np.packbits(np.bincount((low * np.uint32(0x9E3779B1)) >> np.uint32(8) & np.uint32(bits - 1), minlength=bits) & 1).tobytes()


def folded(sketch: bytes, width: int) -> np.ndarray:
    """The sketch of the same set with ``width`` bytes; both are powers of two."""
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, width // 8), axis=0) if len(sketch) > width else words


_SPOT = "a bigint, c bigint, size int, weight bigint, smaller binary"


def _shipped(spots: DataFrame, chunks: DataFrame, kind: str, parts: int) -> DataFrame:
    """The sets of each cell with their sketches or n-grams, ordered by cell.

    ``spots`` (a, c, size, weight, smaller): set a is in the cell of c. Cells of many or
    large sets are cut into blocks; i and j name the two blocks that meet, ``side`` which
    of them the set is of.
    """
    cost = F.greatest(F.col("size") / 4, F.lit(32)) if kind == "sketch" else F.col("size") * GRAM_BYTES
    heavy = spots.groupBy("c").agg(F.count("*").alias("m"), F.sum(cost + F.length("smaller") + 40).alias("bytes"))
    heavy = heavy.withColumn("s", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("bytes") / BLOCK_BYTES)).cast("int")).where("s > 1").select("c", "s")
    cut = spots.join(heavy, "c", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("a"), F.col("s")).cast("int"))
    other = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("k"))
    met = other.select("a", "c", "size", "weight", "smaller", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("byte").alias("side"), F.shiftright("a", 20).alias("chunk"))
    placed = met.join(chunks, "chunk").repartition(parts, "chunk").sortWithinPartitions("chunk")
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("size", pa.int32()), ("weight", pa.int64()), ("smaller", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int8()), ("data", pa.binary())])

    def read(batches):
        path, chunk = None, None
        for rows in parts_of(batches, *schema.names[:-1], "path"):
            out, held = [], 0
            for *row, at in rows:
                if at != path:
                    path, chunk = at, Chunk(at)
                pos = row[0] & 0xFFFFF
                data = short_sketch(chunk.low[chunk.part(pos)]) if kind == "sketch" else chunk.grams(pos)
                out.append((*row, data))
                held += len(data)
                if held > 8_000_000:
                    yield _batch(out, schema)
                    out, held = [], 0
            if out:
                yield _batch(out, schema)

    sent = placed.mapInArrow(read, _SPOT + ", i int, j int, side byte, data binary")
    return sent.repartition(parts, "c", "i", "j").sortWithinPartitions("c", "i", "j", "a")


def _cells(batches, rows_at_once: int, bytes_at_once: int) -> Iterator[dict]:
    """Columns of whole cells, many small ones at a time; ``cell`` numbers them from 0."""
    kept: list[dict] = []
    held = size = 0

    def columns(batch: pa.RecordBatch) -> dict:
        out = {n: np.asarray(batch.column(n)) for n in ("a", "c", "size", "weight", "i", "j", "side")}
        return out | {n: batch.column(n).to_pylist() for n in ("smaller", "data")}

    def joined() -> dict:
        return {n: np.concatenate([k[n] for k in kept]) if n not in ("smaller", "data") else [x for k in kept for x in k[n]] for n in kept[0]}

    def numbered(part: dict) -> dict:
        new = np.concatenate([[True], (part["c"][1:] != part["c"][:-1]) | (part["i"][1:] != part["i"][:-1]) | (part["j"][1:] != part["j"][:-1])])
        return part | {"cell": np.cumsum(new) - 1}

    for batch in batches:
        for at in range(0, len(batch), 2000):
            piece = batch.slice(at, 2000)
            kept.append(columns(piece))
            held += len(piece)
            size += sum(map(len, kept[-1]["data"]))
            if held >= rows_at_once or size >= bytes_at_once:
                part = numbered(joined())
                last = int(np.searchsorted(part["cell"], part["cell"][-1]))
                if last:  # the last cell may go on
                    yield {n: x[:last] for n, x in part.items()}
                    kept = [{n: x[last:] for n, x in part.items() if n != "cell"}]
                    held, size = held - last, sum(map(len, kept[0]["data"]))
    if kept:
        yield numbered(joined())


def _pairs_within(part: dict, t: float, step: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a cell that meet and whose sizes allow Jaccard t."""
    cell, sizes, side, across = part["cell"], part["size"].astype(np.int64), part["side"], part["i"] != part["j"]
    ends = np.searchsorted(cell, cell, "right")
    counts = ends - np.arange(len(cell)) - 1
    upto = np.cumsum(counts)
    at = 0
    while at < len(cell):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")), at + 1)
        n = counts[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        good = np.minimum(sizes[i], sizes[j]) >= t * np.maximum(sizes[i], sizes[j]) - 1e-9
        good &= ~across[i] | (side[i] != side[j])
        yield i[good], j[good]
        at = stop


def _first_meeting(part: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs share no lesser centre, where they'd be counted instead."""
    found = part.setdefault("lesser", {})

    def lesser(r: int) -> frozenset:
        out = found.get(r)
        if out is None:
            out = found[r] = frozenset(np.frombuffer(part["smaller"][r], np.int64).tolist())
        return out

    return np.fromiter((lesser(x).isdisjoint(lesser(y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))


def _near(t: float):
    """Spots of the sets that have a partner within the cell by their short sketches."""
    ratio = (1 - t) / (1 + t)

    def run(batches):
        for part in _cells(batches, 40_000, 32_000_000):
            sizes, width = part["size"].astype(np.int64), np.fromiter(map(len, part["data"]), np.int64)
            keep = np.zeros(len(sizes), bool)
            table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, j in _pairs_within(part, t):
                least = np.minimum(width[i], width[j])
                for w in np.unique(least).tolist():
                    if w not in table:
                        rows = np.flatnonzero(width >= w)
                        rows = rows[width[rows] <= w * max(2, int(2 / t))]
                        where = np.full(len(width), -1)
                        where[rows] = np.arange(len(rows))
                        table[w] = where, np.stack([folded(part["data"][r], w) for r in rows.tolist()])
                    where, words = table[w]
                    x, y = i[least == w], j[least == w]
                    close = np.zeros(len(x), bool)
                    most = np.floor(ratio * (sizes[x] + sizes[y]) + 1e-9)
                    some = max(1, 4_000_000 // w)
                    for at in range(0, len(x), some):
                        here = slice(at, at + some)
                        close[here] = np.bitwise_count(words[where[x[here]]] ^ words[where[y[here]]]).sum(1, dtype=np.int64) <= most[here]
                    x, y = x[close], y[close]
                    new = ~(keep[x] & keep[y])  # pairs of sets that stay anyway needn't be looked at
                    x, y = x[new], y[new]
                    first = _first_meeting(part, x, y)
                    keep[x[first]] = keep[y[first]] = True
            rows = np.flatnonzero(keep)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(part["a"][rows]), pa.array(part["c"][rows]), pa.array(part["size"][rows]), pa.array(part["weight"][rows]), pa.array([part["smaller"][r] for r in rows.tolist()], pa.binary())], names=["a", "c", "size", "weight", "smaller"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(m, m) numbers of common elements: n-grams as columns of a bit matrix, so many at a time."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    ids = np.cumsum(new) - 1
    shared = np.bincount(ids) > 1
    take = shared[ids]
    ids, owner = (np.cumsum(shared) - 1)[ids[take]], owner[take]
    out = np.zeros((m, m), np.int64)
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        a, b = np.searchsorted(ids, [low, low + COLUMNS])
        wide = -(-min(COLUMNS, int(ids[-1]) + 1 - low) // 64) * 64
        bits = np.zeros((m, wide), bool)
        bits[owner[a:b], ids[a:b] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, 4_000_000 // (m * words.shape[1]))
        for r in range(0, m, step):
            out[r : r + step] += np.bitwise_count(words[r : r + step, None] & words[None]).sum(2, dtype=np.int64)
    return out


def _links(t: float):
    """(a, root, deg): of each set of a cell the least set it is linked with there, by any
    number of steps, and the weight of the sets it is linked with."""

    def run(batches):
        for a, _, deg, root, _ in _verified(batches, t):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(root), pa.array(deg)], names=["a", "root", "deg"])

    return run


def _pairs(t: float):
    """(a, b, common, jaccard) of the links themselves."""

    def run(batches):
        for *_, pairs in _verified(batches, t):
            if len(pairs[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "common", "jaccard"])

    return run


def _verified(batches, t: float) -> Iterator[tuple]:
    for part in _cells(batches, 20_000, 16_000_000):
        a, sizes, weight = part["a"], part["size"].astype(np.int64), part["weight"]
        sets = [unpacked(d) for d in part["data"]]
        starts = np.flatnonzero(np.diff(part["cell"], prepend=-1))
        firsts, seconds, shared = [], [], []
        for x, y in zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=True):
            common = common_counts(sets[x:y])
            i, j = np.nonzero(np.triu(common / np.maximum(sizes[x:y, None] + sizes[None, x:y] - common, 1) >= t, 1))
            if part["i"][x] != part["j"][x]:
                across = part["side"][x + i] != part["side"][x + j]
                i, j = i[across], j[across]
            firsts.append(i + x)
            seconds.append(j + x)
            shared.append(common[i, j])
        i, j, common = (np.concatenate(v).astype(np.int64) for v in (firsts, seconds, shared))
        once = _first_meeting(part, i, j)
        i, j, common = i[once], j[once], common[once]
        deg = np.zeros(len(a), np.int64)
        np.add.at(deg, i, weight[j])
        np.add.at(deg, j, weight[i])
        root = a.copy()
        while True:
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            if (root == before).all():
                break
        yield a, sizes, deg, root, (np.minimum(a[i], a[j]), np.maximum(a[i], a[j]), common, common / (sizes[i] + sizes[j] - common))


# ---- the join -------------------------------------------------------------------------


def _joined(docs: DataFrame, n: int, t: float, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, links), written tables.

    members: doc_id, th (hash of the text), sid (NULL without words) of each document. sets: sid,
    num, size, weight (documents), first (the least document) of each class of equal
    sets. links: see :func:`_links`, or :func:`_pairs`.
    """
    if not 1 / RATIO <= t <= 1:
        raise ValueError("t must be from 0.5 to 1")
    spark = docs.sparkSession
    where = scratch_path(spark, "ngram-chunks")
    text = column(docs, "text", "string")
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = materialize(_sets(rows, n, where), "ngram-found")
    members = found.where("kind = 0").select("doc_id", "th", "sid")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    sets = found.where("kind = 0 AND sid IS NOT NULL").groupBy("sid").agg(F.min("num").alias("num"), F.first("size").cast("int").alias("size"), F.count("*").alias("weight"), F.min(order).alias("first"))
    sets = materialize(sets, "ngram-classes")
    chunks = found.where("kind = 1").select(F.col("num").alias("chunk"), "path")
    totals = sets.agg(F.count("*").alias("m"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals.s // PART_GRAMS))
    # a chunk has a bounded number of sets
    wanted = sets.groupBy(F.shiftright("num", 20).alias("chunk")).agg(F.collect_list((F.col("num").bitwiseAND(0xFFFFF)).cast("int")).alias("spots"))
    wanted = materialize(wanted.join(chunks, "chunk").select("path", "chunk", "spots"), "ngram-wanted").repartition(parts, "chunk")
    rare = _gram_counts(wanted, parts).repartitionById(parts, "part").mapInArrow(_surprises(totals.m), "chunk bigint, part int, data binary")
    rare = rare.repartition(parts, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("rare"))
    met = _blobs(wanted.join(rare, "chunk"), t, parts).repartitionById(parts, "part").mapInArrow(_meet, "a bigint, c bigint, n bigint")
    cells = met.repartition(parts, "a").groupBy("a", "c").agg(F.sum("n").alias("n")).join(sets.select(F.col("num").alias("a"), "size", "weight").repartition(parts, "a"), "a")
    fewest = Window.partitionBy("a").orderBy("n", "c").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("n").over(fewest)).where(F.col("upto") > slack(F.col("size"), t))
    centres = cells.groupBy("a").agg(F.first("size").alias("size"), F.first("weight").alias("weight"), F.array_sort(F.collect_list("c")).alias("cs"))
    centres = materialize(_few_files(centres), "ngram-centres")
    # the centres of a set are at most its keys
    spots = centres.select("a", "size", "weight", F.posexplode("cs").alias("k", "c"), "cs")
    spots = spots.select("a", "c", "size", "weight", _packed(F.slice("cs", F.lit(1), F.col("k"))).alias("smaller"))
    near = materialize(_shipped(spots, chunks, "sketch", parts).mapInArrow(_near(t), _SPOT).distinct(), "ngram-near")
    sent = _shipped(near, chunks, "grams", parts)
    links = sent.mapInArrow(_pairs(t), "a bigint, b bigint, common bigint, jaccard double") if pairs else sent.mapInArrow(_links(t), "a bigint, root bigint, deg bigint")
    links = materialize(_few_files(links), "ngram-links")
    discard(spark, where)
    return members, sets, links


def _few_files(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as their size needs, not one for each of the parts.

    For each file that a task creates, Hadoop's local file system starts a process (chmod), which
    shares the executor's memory until it runs and may be counted with it again.
    """
    return rows.hint("rebalance", "a")


def _packed(longs: Column) -> Column:
    """An array of bigint as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(longs, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): connected components of the pairs (a, b); the root is the least node.

    Alternating stars: every node hands its larger neighbours to the least node it knows,
    then its smaller ones, until nothing moves. Edges never grow in number, and each
    round is a written table. Pairs with a NULL, repeated ones and those of a node with itself
    don't matter; a node without others isn't in the result. Empty table: no rows.
    """
    edges = materialize(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = materialize(large, "component-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u != v").distinct(), "component-edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)


def _rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, weight, first, root): the component of each class of equal sets."""
    found = components(links.select("a", F.col("root").alias("b")))
    return sets.join(found, sets.num == found.node, "left").select("sid", "num", "weight", "first", F.coalesce("root", "num").alias("root"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    Links are the documents with Jaccard >= t, copies included; ``class_id`` is the least
    doc_id of the documents that links connect with this one (its own id if there
    are none; NULL if none of them has an id).
    """
    members, sets, links = _joined(docs, n, t)
    rooted = _rooted(sets, links)
    degrees = links.groupBy(F.col("a").alias("num")).agg(F.sum("deg").alias("deg"))
    linked = rooted.join(degrees, "num", "left").select("sid", "root", F.col("first.doc_id").alias("id"), (F.col("weight") - 1 + F.coalesce("deg", F.lit(0))).alias("n_links"))
    classes = linked.groupBy("root").agg(F.min("id").alias("class_id"))
    described = materialize(linked.join(classes, "root").select("sid", "class_id", "n_links"), "ngram-described")
    wordless = members.where("sid IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return members.where("sid IS NOT NULL").join(described, "sid").select("doc_id", "class_id", "n_links").unionByName(wordless)


def similar_sets(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the representative's number of each document, and the links of representatives.

    members: doc_id, num (NULL without words). pairs: a, b (numbers, a before b), common, jaccard: as
    many rows as there are links between different sets.
    """
    members, sets, pairs = _joined(docs, n, t, pairs=True)
    return members.join(sets.select("sid", "num"), "sid", "left").select("doc_id", "num"), pairs


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, columns unchanged.

    Groups are the connected components of the join. The document with the least doc_id
    stays (NULL last; ties by the hash of the text; of equal rows one). Documents without
    words stay.
    """
    members, sets, links = _joined(docs, n, t)
    rooted = _rooted(sets, links)
    stay = rooted.groupBy("root").agg(F.min("first").alias("f"), F.sum("weight").alias("m")).where("m > 1").select("root", "f")
    grouped = rooted.join(stay, "root").select("sid", "f")
    rows = members.join(grouped, "sid").groupBy("doc_id", "th", "f").agg(F.count("*").alias("m"))
    d, h = fresh(docs, "d", "h")
    judged = rows.select(F.col("doc_id").alias(d), F.col("th").alias(h), "m", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))).alias("stays"))
    judged = materialize(judged.where("NOT stays OR m > 1"), "ngram-judged")
    text = F.xxhash64(column(docs, "text", "string"))
    same = (column(docs, "doc_id", "bigint").eqNullSafe(F.col(d))) & (text == F.col(h)) & column(docs, "text", "string").isNotNull()
    # a merge join at every size: the rows cross the network once, and no table is sent to all tasks
    kept = docs.join(judged.select(d, h).hint("merge"), same, "left_anti")
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated.select(d, h).hint("merge"), same, "left_semi").withColumns({d: column(docs, "doc_id", "bigint"), h: text})
    return kept.unionByName(again.dropDuplicates([d, h]).drop(d, h))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


_WORDS = "[\\p{L}\\p{N}_]+"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM documents),
g AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM d),
sets AS (SELECT md5(array_to_string(s, '|')) AS k, any_value(s) AS s, len(any_value(s)) AS n, count(*) AS m, min(doc_id) AS first
  FROM g WHERE len(s) > 0 GROUP BY 1),
grams AS (SELECT k, n, unnest(s) AS x FROM sets),
seen AS (SELECT x, count(*) AS df FROM grams GROUP BY x HAVING count(*) > 1),
ranked AS (SELECT k, n, x, row_number() OVER (PARTITION BY k ORDER BY coalesce(df, 1), x) AS nth FROM grams LEFT JOIN seen USING (x)),
prefix AS (SELECT k, n, x FROM ranked WHERE nth <= n - ceil({THRESHOLD}::DOUBLE * n - 1e-9::DOUBLE) + 1),
near AS (SELECT DISTINCT a.k AS a, b.k AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.k < b.k
  AND least(a.n, b.n) >= {THRESHOLD}::DOUBLE * greatest(a.n, b.n)),
pairs AS (SELECT a, b FROM near JOIN sets p ON p.k = a JOIN sets q ON q.k = b
  WHERE len(list_intersect(p.s, q.s))::DOUBLE / (p.n + q.n - len(list_intersect(p.s, q.s))) >= {THRESHOLD}::DOUBLE),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (SELECT k AS k, k AS top FROM sets UNION SELECT e.b, walk.top FROM walk JOIN edges e ON e.a = walk.k),
root AS (SELECT k, min(top) AS root FROM walk GROUP BY k),
class AS (SELECT root, min(first) AS class_id FROM root JOIN sets USING (k) GROUP BY root),
degree AS (SELECT a AS k, sum(m) AS deg FROM edges JOIN sets ON sets.k = b GROUP BY a)
SELECT doc_id, class_id, CAST(m - 1 + coalesce(deg, 0) AS BIGINT) AS n_links
FROM g JOIN sets ON sets.k = md5(array_to_string(g.s, '|')) JOIN root ON root.k = sets.k JOIN class USING (root) LEFT JOIN degree ON degree.k = sets.k
WHERE len(g.s) > 0
UNION ALL SELECT doc_id, doc_id, 0 FROM g WHERE len(s) = 0
"""

QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES = {"op3_ngram_join": ORACLE}
