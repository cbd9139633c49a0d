"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are scaled to length 1, centred and rotated by several learned
rotations (iterative quantisation on a bounded sample, FIT); the signs are the bits. Each
code is split into bytes, and each byte is indexed: with s bytes and radius r, a code
within r of the query has some byte within floor(r / s) of the query's (pigeonhole), so
probing the values that near finds every code within r. Those are checked for their
whole distance and reranked by cosine.

1. Blocks: every row is coded; rows in the order of their codes are written in blocks, so that
   clustered vectors share blocks.
2. Index: a table says which values of which byte occur in which block. Queries probe it
   by an equality join on (byte, value) and so learn which blocks can hold codes within r.
3. Search: within those blocks the probes are repeated on lists by byte and value; what they
   find is checked and reranked, and the k best of a block go on.

Queries are the rows whose vec_id is divisible by ``every``; the index holds all rows. The
radius is learned, too: a hash-chosen, bounded set of vectors (PROBES) is compared with
all vectors exactly, and r is the quantile of the code distances of their true
neighbours. Queries that find fewer than k codes within r are searched again with
the radius at its maximum, so every query gets its k.

On data without structure (independent directions) no radius that reaches the neighbours
excludes much, and the work is that of all queries against all codes; the closer true
neighbours are, the fewer blocks a query meets.

Defined results
---------------
* A vector isn't its own neighbour; equal vectors in other rows are. Ties of the cosine
  are ordered by vec_id (NULL first), then by row.
* NULL or empty embeddings, embeddings with NULL or non-finite entries, and those whose
  length isn't the commonest (ties: the longest) are left out. A vector of length 0 has
  cosine 0 with all. Fewer than k other vectors: all of them.
* Repeated rows each are queries (and found). A NULL vec_id is found, but is no query.
  Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.common import column, materialize, parts_of, table

K, EVERY, ROTATIONS, ITERATIONS, SEED = 10, 50, 4, 30, 5
#: Bounds: vectors that fit the rotations, vectors that set the radius; its quantile.
FIT, PROBES, QUANTILE = 20_000, 256, 0.98
#: Vectors of a block, queries that meet a block at a time.
BLOCK, QUERIES_AT_ONCE = 4096, 20_000


def learn_rotations(sample: np.ndarray, count: int = ROTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): sign((x - mean) @ matrix) are the bits; ``count`` rotations side by side."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    x = sample - mean
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean.astype(np.float32), np.concatenate(out, 1).astype(np.float32)


def encode(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Packed codes, uint8, a multiple of 8 bytes wide."""
    bits = np.packbits((x - mean) @ matrix > 0, axis=1)
    pad = -bits.shape[1] % 8
    return np.pad(bits, ((0, 0), (0, pad))) if pad else bits


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class ByteIndex:
    """Codes by the values of their bytes; lists are bitmaps over the block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.words = codes.view(np.uint64)
        self.lists = []
        values = np.arange(256, dtype=np.uint8)
        for s in range(codes.shape[1]):
            self.lists.append(np.packbits(codes[None, :, s] == values[:, None], axis=1))

    def probed(self, radius: int) -> list[np.ndarray] | None:
        """For each byte and value: the codes with a value within floor(radius / bytes); None if that is all."""
        near = radius // self.codes.shape[1]
        if near >= 8:
            return None
        values = np.arange(256, dtype=np.uint8)
        close = np.bitwise_count(values[:, None] ^ values[None]) <= near
        return [np.stack([np.bitwise_or.reduce(lists[row], 0) for row in close]) for lists in self.lists]

    def within(self, queries: np.ndarray, probed, radius: int) -> np.ndarray:
        """(queries, codes) truth table of codes within the radius."""
        if probed is None:
            found = np.ones((len(queries), len(self.codes)), bool)
        else:
            bits = probed[0][queries[:, 0]].copy()
            for s in range(1, len(probed)):
                bits |= probed[s][queries[:, s]]
            found = np.unpackbits(bits, axis=1, count=len(self.codes)).view(bool)
        if radius < 8 * self.codes.shape[1]:
            words = queries.view(np.uint64)
            distance = np.zeros(found.shape, np.uint16)
            for w in range(words.shape[1]):
                distance += np.bitwise_count(words[:, w, None] ^ self.words[None, :, w])
            found &= distance <= radius
        return found


def near_values(radius: int, width: int) -> np.ndarray:
    """(256, 256) truth table: values of a byte that a radius over ``width`` bytes has to probe."""
    values = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(values[:, None] ^ values[None]) <= radius // width


def search_block(qx: np.ndarray, qc: np.ndarray, own: np.ndarray, bx: np.ndarray, bc: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, base rows, cosines): for each query the k best of the block within the radius, and ties.

    ``own`` is the query's own row in the block, or -1.
    """
    index = ByteIndex(bc)
    probed = index.probed(radius)
    outs = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
    for at in range(0, len(qx), 256):
        x, mine = qx[at : at + 256], own[at : at + 256]
        found = index.within(np.ascontiguousarray(qc[at : at + 256]), probed, radius)
        here = np.flatnonzero(mine >= 0)
        found[here, mine[here]] = False
        i, j = np.nonzero(found)
        cos = np.empty(len(i))
        for a in range(0, len(i), 100_000):
            some = slice(a, a + 100_000)
            cos[some] = np.einsum("ij,ij->i", x[i[some]], bx[j[some]], dtype=np.float64)
        cos = np.round(cos, 6)
        order = np.lexsort((-cos, i))
        i, j, cos = i[order], j[order], cos[order]
        first, last = np.searchsorted(i, np.arange(len(x))), np.searchsorted(i, np.arange(len(x)), "right")
        floor = np.where(last - first > k, cos[np.minimum(first + k - 1, len(cos) - 1)] if len(cos) else 0.0, -2.0)
        good = cos >= floor[i]
        for out, part in zip(outs, (i[good] + at, j[good], cos[good]), strict=True):
            out.append(part)
    return tuple(np.concatenate(o) for o in outs)


def _clean(embeddings: DataFrame) -> DataFrame:
    kind = F.transform(F.col("embedding"), lambda x: x.cast("float"))
    rows = embeddings.select(column(embeddings, "vec_id", "bigint").alias("vec_id"), kind.alias("x"))
    return rows.where("x IS NOT NULL AND size(x) > 0 AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = float('infinity'))")


_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary())])


def _coded(rows: DataFrame, mean, matrix) -> DataFrame:
    """(vec_id, vector, code) of every row, as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = unit(np.asarray(part.column(1).flatten()).astype(np.float32).reshape(len(part), -1))
                code = encode(x, mean, matrix)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "vector", "code"])

    return rows.mapInArrow(run, "vec_id bigint, vector binary, code binary")


def _blocks(coded: DataFrame, total: int, block: int) -> DataFrame:
    """Rows in the order of their codes, in written blocks; rows of one code may fill many."""
    spread = F.xxhash64("vec_id", "vector")
    ordered = coded.withColumn("h", spread).repartitionByRange(max(1, -(-total // (4 * block))), "code", "h").sortWithinPartitions("code", "h")

    def pack(batches):
        task, number = TaskContext.get().partitionId(), 0
        kept: list[tuple] = []

        def row() -> pa.RecordBatch:
            ids, vectors, codes = zip(*kept, strict=True)
            values = [task << 20 | number, len(ids), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(), b"".join(vectors), b"".join(codes)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCKS, strict=True)], schema=_BLOCKS)

        for part in parts_of(batches, "vec_id", "vector", "code"):
            for one in part:
                kept.append(one)
                if len(kept) == block:
                    yield row()
                    kept, number = [], number + 1
        if kept:
            yield row()

    return materialize(ordered.mapInArrow(pack, "block bigint, n int, ids binary, known binary, vectors binary, codes binary"), "ann-blocks")


def _read(batch: pa.RecordBatch, at: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, ids, known, vectors, codes) of a block."""
    number, n, ids, known, vectors, codes = (batch.column(c)[at].as_py() for c in _BLOCKS.names)
    return number, np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(vectors, np.float32).reshape(n, -1), np.frombuffer(codes, np.uint8).reshape(n, -1)


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """(q_block, q_row, vec_id, vector, code) of the rows whose id is divisible by ``every``."""

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                number, ids, known, x, codes = _read(batch, at)
                rows = np.flatnonzero(known & (ids % every == 0))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(rows.astype(np.int32)), pa.array(ids[rows]), pa.array([x[r].tobytes() for r in rows], pa.binary()), pa.array([codes[r].tobytes() for r in rows], pa.binary())], names=["q_block", "q_row", "vec_id", "vector", "code"])

    return blocks.mapInArrow(run, "q_block bigint, q_row int, vec_id bigint, vector binary, code binary")


def _index(blocks: DataFrame) -> DataFrame:
    """(pos, value, block): which values of which byte occur in which block."""

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                number, *_, codes = _read(batch, at)
                pos, value = np.nonzero(np.stack([np.bincount(codes[:, s], minlength=256) for s in range(codes.shape[1])]))
                yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(value.astype(np.int32)), pa.array(np.full(len(pos), number))], names=["pos", "value", "block"])

    return blocks.mapInArrow(run, "pos int, value int, block bigint")


def _routed(queries: DataFrame, index: DataFrame, radius: int, width: int) -> DataFrame:
    """(q_block, q_row, block): the blocks in which some byte has a value that the query probes."""
    spark = queries.sparkSession
    pairs = np.argwhere(near_values(radius, width))
    probes = spark.createDataFrame(pa.table({"asked": pairs[:, 0].astype(np.int32), "value": pairs[:, 1].astype(np.int32)}))  # 256 * 256 rows at most
    # what a query's byte leads to, once for each byte and value: 256 * width values, whatever the queries
    leads = index.join(F.broadcast(probes), "value").select("pos", "asked", "block").distinct()
    octets = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.struct(p.alias("pos"), F.conv(F.hex(F.substring("code", p + 1, F.lit(1))), 16, 10).cast("int").alias("asked")))
    asked = queries.select("q_block", "q_row", F.inline(octets))
    return asked.join(leads, ["pos", "asked"]).select("q_block", "q_row", "block").distinct()


_FOUND = "q_block bigint, q_row int, b_block bigint, b_row int, vec_id bigint, neighbor_id bigint, cosine double"


def _searched(queries: DataFrame, blocks: DataFrame, index: DataFrame, radius: int, width: int, k: int, groups: int) -> DataFrame:
    """The k best of each block for the queries routed to it. ``groups`` of queries meet a block in turn."""
    group = F.pmod(F.xxhash64("q_block", "q_row"), F.lit(groups)).cast("int")
    sent = _routed(queries, index, radius, width).join(queries, ["q_block", "q_row"]).withColumn("g", group)
    there = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.schema([("q_block", pa.int64()), ("q_row", pa.int32()), ("b_block", pa.int64()), ("b_row", pa.int32()), ("vec_id", pa.int64()), ("neighbor_id", pa.int64()), ("cosine", pa.float64())]).empty_table()
        if not len(q) or not len(b):
            return empty
        number, ids, known, x, codes = _read(b.combine_chunks().to_batches()[0], 0)
        qb, qr, qi = (q.column(c).to_numpy() for c in ("q_block", "q_row", "vec_id"))
        qx = np.frombuffer(b"".join(q.column("vector").to_pylist()), np.float32).reshape(len(q), -1)
        qc = np.frombuffer(b"".join(q.column("code").to_pylist()), np.uint8).reshape(len(q), -1)
        i, j, cos = search_block(qx, qc, np.where(qb == number, qr, -1), x, codes, radius, k)
        arrays = [pa.array(qb[i]), pa.array(qr[i].astype(np.int32)), pa.array(np.full(len(i), number)), pa.array(j.astype(np.int32)), pa.array(qi[i]), pa.array(ids[j], mask=~known[j]), pa.array(cos)]
        return pa.Table.from_arrays(arrays, schema=empty.schema)

    return sent.groupBy("block", "g").cogroup(there.groupBy("block", "g")).applyInArrow(run, _FOUND)


def _learned_radius(blocks: DataFrame, sample: np.ndarray, codes: np.ndarray, k: int, quantile: float) -> int:
    """The quantile of code distances between the sample's vectors and their exact k neighbours among all."""

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                *_, x, c = _read(batch, at)
                cos = sample @ x.T
                top = np.argpartition(-cos, min(k, len(x) - 1), axis=1)[:, : k + 1]
                distance = np.bitwise_count(codes[:, None, :] ^ c[top]).sum(2)
                n = top.shape[1]
                yield pa.RecordBatch.from_pydict({"s": np.repeat(np.arange(len(sample)), n), "cos": np.take_along_axis(cos, top, 1).ravel().astype(np.float64), "d": distance.ravel().astype(np.int64)})

    best = blocks.mapInArrow(run, "s bigint, cos double, d bigint")
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("cos")))).where((F.col("r") > 1) & (F.col("r") <= k + 1))
    distances = [r.d for r in ranked.select("d").collect()]  # PROBES * k numbers at most
    return int(np.quantile(distances, quantile, method="higher")) if distances else 8 * codes.shape[1]


def ann_search(embeddings: DataFrame, k: int = K, every: int = EVERY, quantile: float = QUANTILE, block: int = BLOCK) -> DataFrame:
    """(vec_id, rank, neighbor_id, cosine): the k nearest others of every query, ranks from 1."""
    spark = embeddings.sparkSession
    clean = _clean(embeddings)
    dims = clean.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, cosine double")
    rows = clean.where(F.size("x") == dims.d)
    hashed = rows.withColumn("h", F.xxhash64("x")).orderBy("h").limit(FIT).select("x")
    flat = hashed.toArrow().column(0).combine_chunks()
    sample = unit(np.asarray(flat.flatten()).astype(np.float32).reshape(-1, dims.d))
    mean, matrix = learn_rotations(sample)
    blocks = _blocks(_coded(rows, mean, matrix), dims.n, block)
    probes = sample[:PROBES]
    codes = encode(probes, mean, matrix)
    width = codes.shape[1]
    radius = _learned_radius(blocks, probes, codes, k, quantile)
    queries = materialize(_queries(blocks, every), "ann-queries")
    index = materialize(_index(blocks), "ann-index")
    groups = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    found = materialize(_searched(queries, blocks, index, radius, width, k, groups), "ann-found")
    # queries that found fewer than k within the radius are searched among all codes
    enough = found.groupBy("q_block", "q_row").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("q_block", "q_row")
    short = materialize(queries.join(enough, ["q_block", "q_row"], "left_anti"), "ann-short")
    rest = materialize(_searched(short, blocks, index, 8 * width, width, k, groups), "ann-rest")
    whole = found.join(short.select("q_block", "q_row"), ["q_block", "q_row"], "left_anti").unionByName(rest)
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("cosine"), F.asc_nulls_first("neighbor_id"), "b_block", "b_row")
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "cosine")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 50, among all vectors."""
    return ann_search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_ann": op6_ann}
ORACLES: dict = {}
