"""Exact top-k search by BM25 over inverted indexes with block-max WAND.

1. Index: every task turns its documents into shards of bounded size. A shard holds the
   postings (document, frequency) of all its terms in document order, and the lengths
   of its documents. The shards are a table that is written once, whatever the queries.
2. Statistics: number of documents, mean length and the document frequencies of the
   queries' terms are summed over all shards, so that scores don't depend on how documents
   fell into shards. Queries, with these frequencies, are a written table, too.
3. Search: for each shard every query runs block-max WAND. Cursors in document order skip
   every document, and every block of postings, whose summed upper bounds can't reach the
   k-th score found so far. Each shard's k best are merged by rank.

A task reads its shards, and for each the table of queries in batches of bounded size;
neither the index nor the queries are shuffled or pass through the driver.

Defined results
---------------
* Scores are rounded to 6 decimals; ties are ordered by doc_id (NULL first). Only
  documents with at least one term of the query have a score; fewer than k: all of them.
* NULL or empty text: a document of length 0 that counts in the statistics. NULL or
  empty query, or one without words: no rows. NULL ids are carried; repeated rows are
  documents (and queries) each, told apart by their rows.
* A term that a query repeats counts as often. Very long documents are indexed whole.
* Terms are told apart by 64 bits of their hashes.
* Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.common import WORD, WordHasher, column, materialize, open_path, parts_of, table, written

K, K1, B = 10, 1.2, 0.75
#: Tokens of a shard, postings of a block, queries of a batch, postings of a shard that are kept ready.
SHARD_TOKENS, BLOCK, BATCH, READY = 4_000_000, 64, 2000, 3_000_000
END = 1 << 60
_INDEX = pa.schema([("docs", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()), ("dfs", pa.binary()), ("postings", pa.binary()), ("freqs", pa.binary())])
_INDEX_DDL = "docs bigint, tokens bigint, ids binary, known binary, lengths binary, terms binary, dfs binary, postings binary, freqs binary"


class _Builder:
    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = WORD.findall(text.lower()) if text else []
        self.terms.append(self.hasher(words))
        self.docs.append(np.full(len(words), len(self.ids), np.int32))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.tokens += len(words) + 8

    def row(self) -> pa.RecordBatch:
        terms, docs = np.concatenate(self.terms).view(np.int64), np.concatenate(self.docs)
        order = np.argsort(terms, kind="stable")  # documents stay in order
        terms, docs = terms[order], docs[order]
        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(first)
        freqs = np.diff(np.append(at, len(terms)))
        terms, docs = terms[at], docs[at]
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
        dfs = np.diff(np.append(starts, len(terms)))
        known = np.array([i is not None for i in self.ids])
        row = {
            "docs": len(self.ids), "tokens": int(sum(self.lengths)), "ids": np.array([i or 0 for i in self.ids], np.int64).tobytes(), "known": known.tobytes(),
            "lengths": np.array(self.lengths, np.int32).tobytes(), "terms": terms[starts].tobytes(), "dfs": dfs.astype(np.int32).tobytes(),
            "postings": docs.tobytes(), "freqs": freqs.astype(np.int32).tobytes(),
        }
        self.clear()
        return pa.RecordBatch.from_pylist([row], schema=_INDEX)


def build_index(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of an inverted index over all terms of all documents, a written table."""
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))

    def run(batches):
        builder = _Builder()
        for part in parts_of(batches, "doc_id", "text"):
            for doc_id, text in part:
                builder.add(doc_id, text)
                if builder.tokens >= shard_tokens:
                    yield builder.row()
        if builder.ids:
            yield builder.row()

    return materialize(rows.mapInArrow(run, _INDEX_DDL), "bm25-index")


class _Cursor:
    """Postings of one term, with the upper bounds of its blocks."""

    __slots__ = ("docs", "scores", "ends", "tops", "at", "block", "doc", "top", "term")

    def __init__(self, term: int, docs: list[int], scores: list[float], ends: list[int], tops: list[float], top: float) -> None:
        self.term, self.docs, self.scores, self.ends, self.tops, self.top = term, docs, scores, ends, tops, top
        self.at = self.block = 0
        self.doc = docs[0]

    def seek(self, doc: int) -> None:
        """Move to the first posting at or after ``doc``."""
        self.at = at = bisect_left(self.docs, doc, self.at)
        self.doc = self.docs[at] if at < len(self.docs) else END

    def bound(self, doc: int) -> float:
        """The upper bound of the block that would hold ``doc``, without moving the cursor."""
        self.block = block = bisect_left(self.ends, doc, self.block)
        return self.tops[block] if block < len(self.ends) else 0.0


class Shard:
    """One shard with the scores of its postings, ready to search."""

    def __init__(self, row: dict, mean: float, k1: float, b: float) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        lengths = np.frombuffer(row["lengths"], np.int32)
        norm = k1 * (1 - b + b * lengths / mean) if mean else np.full(len(lengths), k1)
        self.docs = np.frombuffer(row["postings"], np.int32)
        freqs = np.frombuffer(row["freqs"], np.int32)
        self.weight = freqs * (k1 + 1) / (freqs + norm[self.docs])
        self.terms = np.frombuffer(row["terms"], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(np.frombuffer(row["dfs"], np.int32).astype(np.int64))])
        self.lists: dict[int, tuple] = {}
        self.ready = 0

    def load(self, idf: dict[int, float]) -> None:
        """Make the postings of these terms ready."""
        if self.ready > READY:
            self.lists.clear()
            self.ready = 0
        if not len(self.terms):
            return
        wanted = np.array([t for t in idf if t not in self.lists], np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        for i in at[self.terms[at] == wanted].tolist():
            term, low, high = int(self.terms[i]), int(self.cuts[i]), int(self.cuts[i + 1])
            d, s = self.docs[low:high], self.weight[low:high] * idf[term]
            starts = np.arange(0, len(d), BLOCK)
            tops = np.maximum.reduceat(s, starts)
            ends = d[np.append(starts[1:], len(d)) - 1]
            self.lists[term] = (d, s, d.tolist(), s.tolist(), ends.tolist(), tops.tolist(), float(s.max()))
            self.ready += len(d)

    def prime(self, terms: list[tuple[int, int]], want: int) -> dict[int, float]:
        """Whole scores of the documents in the query's shortest lists: a first threshold."""
        lists = sorted((self.lists[t] for t, _ in terms), key=lambda x: len(x[0]))
        some: np.ndarray = np.empty(0, np.int32)
        for found in lists:
            if len(some) >= want:
                break
            some = np.union1d(some, found[0][: 8 * want])
        total = np.zeros(len(some))
        for t, times in terms:
            d, s = self.lists[t][:2]
            at = np.minimum(np.searchsorted(d, some), len(d) - 1)
            total += np.where(d[at] == some, s[at], 0.0) * times
        return dict(zip(some.tolist(), total.tolist(), strict=True))

    def search(self, query: list[tuple[int, int]], k: int, best: list[tuple]) -> None:
        """Block-max WAND. ``best`` is a heap of (score, order of the id, ...) of at most k."""
        terms = [(t, times) for t, times in query if t in self.lists]
        if not terms:
            return
        done = self.prime(terms, k)
        for doc, score in done.items():
            self._offer(best, k, score, doc)
        cursors = []
        for t, times in terms:
            _, _, docs, scores, ends, tops, top = self.lists[t]
            if times > 1:
                scores, tops, top = [x * times for x in scores], [x * times for x in tops], top * times
            cursors.append(_Cursor(t, docs, scores, ends, tops, top))
        by_doc = _doc_of
        while True:
            cursors.sort(key=by_doc)
            # scores are compared as rounded; a bound that close to the threshold may still reach it
            need = best[0][0] - 1e-6 if len(best) >= k else -1.0
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c.top
                if total >= need:
                    pivot = i
                    break
            if pivot < 0 or (doc := cursors[pivot].doc) == END:
                return
            while pivot + 1 < len(cursors) and cursors[pivot + 1].doc == doc:
                pivot += 1
            before = cursors[: pivot + 1]
            total = 0.0
            for c in before:
                total += c.bound(doc)
            if total >= need and doc not in done:
                if before[0].doc == doc:
                    self._offer(best, k, self._sum(before, terms), doc)
                    for c in before:
                        c.seek(doc + 1)
                else:
                    for c in before:
                        if c.doc >= doc:
                            break
                        c.seek(doc)
            elif total >= need:
                for c in before:
                    c.seek(doc + 1)
            else:
                # no document before the end of the nearest block can reach the threshold
                skip = cursors[pivot + 1].doc if pivot + 1 < len(cursors) else END
                for c in before:
                    if c.block < len(c.ends):
                        skip = min(skip, c.ends[c.block] + 1)
                for c in before:
                    if c.doc < skip:
                        c.seek(max(skip, doc + 1))

    @staticmethod
    def _sum(cursors: list[_Cursor], terms: list[tuple[int, int]]) -> float:
        found = {c.term: c.scores[c.at] for c in cursors}
        total = 0.0
        for t, _ in terms:  # the same order of addition everywhere
            total += found.get(t, 0.0)
        return total

    def _offer(self, best: list[tuple], k: int, score: float, doc: int) -> None:
        known = bool(self.known[doc])
        i = int(self.ids[doc])
        entry = (round(score, 6), not known, -i if known else 0, i if known else None)
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry[:3] > best[0][:3]:
            heapq.heapreplace(best, entry)


def _doc_of(c: _Cursor) -> int:
    return c.doc


def _terms(queries: DataFrame) -> DataFrame:
    """(q, item_id, term, times) of the queries, a written table; q tells rows apart."""
    rows = queries.select(column(queries, "item_id", "bigint").alias("item_id"), column(queries, "text", "string").alias("text")).where("text IS NOT NULL AND text != ''")

    def run(batches):
        hasher = WordHasher()
        for part in parts_of(batches, "q", "item_id", "text"):
            for q, item, text in part:
                term, times = np.unique(hasher(WORD.findall(text.lower())).view(np.int64), return_counts=True)
                if len(term):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), q)), pa.array([item] * len(term), pa.int64()), pa.array(term), pa.array(times)], names=["q", "item_id", "term", "times"])

    return materialize(rows.withColumn("q", F.monotonically_increasing_id()).mapInArrow(run, "q bigint, item_id bigint, term bigint, times bigint"), "bm25-terms")


def _frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) over all shards, of the terms that some query has."""

    def run(batches):
        for batch in batches:
            for term, df in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(term.as_py(), np.int64)), pa.array(np.frombuffer(df.as_py(), np.int32))], names=["term", "df"])

    every = index.select("terms", "dfs").mapInArrow(run, "term bigint, df int")
    return every.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def search_index(index: DataFrame, queries: DataFrame, k: int = K, k1: float = K1, b: float = B, batch: int = BATCH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query in a written index."""
    terms = _terms(queries)
    totals = index.agg(F.sum("docs").alias("n"), F.sum("tokens").alias("t")).first()
    n, mean = totals.n or 0, (totals.t or 0) / totals.n if totals.n else 0.0
    ready = terms.join(_frequencies(index, terms), "term").groupBy("q", "item_id").agg(F.array_sort(F.collect_list(F.struct("term", "times", "df"))).alias("terms"))
    _, where = written(ready, "bm25-queries")

    def run(batches):
        fs, folder = open_path(where)
        asked = ds.dataset(folder, filesystem=fs, format="parquet", schema=pa.schema([("q", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.int64()), ("times", pa.int64()), ("df", pa.int64())])))]))
        for arrow in batches:
            for at in range(len(arrow)):
                shard = Shard({name: arrow.column(name)[at].as_py() for name in arrow.schema.names}, mean, k1, b)
                for some in asked.to_batches(batch_size=batch):
                    parsed = [[(t["term"], t["times"], t["df"]) for t in row] for row in some.column("terms").to_pylist()]
                    shard.load({t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for row in parsed for t, _, df in row})
                    out = []
                    for q, item, row in zip(some.column("q").to_pylist(), some.column("item_id").to_pylist(), parsed, strict=True):
                        best: list[tuple] = []
                        shard.search([(t, times) for t, times, _ in row], k, best)
                        out += [(q, item, entry[3], entry[0]) for entry in best]
                    if out:
                        numbers, items, ids, scores = zip(*out, strict=True)
                        yield pa.RecordBatch.from_pydict({"q": pa.array(numbers, pa.int64()), "item_id": pa.array(items, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = index.mapInArrow(run, "q bigint, item_id bigint, doc_id bigint, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = K, k1: float = K1, b: float = B, shard_tokens: int = SHARD_TOKENS, batch: int = BATCH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query."""
    return search_index(build_index(docs, shard_tokens), queries, k, k1, b, batch)


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "[\\p{L}\\p{N}_]+"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM benchmark),
qt AS (SELECT q, item_id, term, count(*)::DOUBLE AS times FROM q, unnest(w) AS t(term) GROUP BY ALL),
tf AS (SELECT r, doc_id, len(w)::DOUBLE AS dl, term, count(*)::DOUBLE AS tf FROM d, unnest(w) AS t(term)
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
scored AS (
  SELECT q, item_id, r, any_value(doc_id) AS doc_id,
    round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl / mean))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), stats GROUP BY q, item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored)
WHERE rank <= {K}
"""

QUERIES = {"op2_bm25": op2_bm25}
ORACLES = {"op2_bm25": ORACLE}
