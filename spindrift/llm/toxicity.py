"""Toxic passages by maximal scoring segments with extreme-value calibration.

1. Lexicon: words of a bounded sample of labelled documents, and their prefixes, are
   counted by class. A token's log-odds come from hierarchical Dirichlet priors: the
   prior of a word is its longest prefix, of a prefix the next shorter one, of the
   shortest the share of words in toxic documents. What isn't significantly above
   that share, nor right below something that is, has the score of other words.
2. Calibration: a second, disjoint sample of labelled clean documents gives the
   distribution of token scores, its decay ``lam`` (the positive root of
   sum p(s) exp(lam s) = 1) and, by maximum likelihood over the documents' best
   segments, the constant ``k`` of the extreme-value law
   P(best < x) = exp(-k n exp(-lam x)) for a document of n tokens.
3. Scan: every document is scanned once, in linear time, for all maximal scoring
   segments. Their scores are aggregated to a document by the sum test of the
   extreme-value law; if its p is at most ``p_max``, the segments counted are passages,
   and so is every other segment that is significant by itself (e-value at most ``p_max``).

Defined results
---------------
* NULL or empty text: no passage. Very long documents are scanned whole; their
  length counts in the calibration. Ties: of equal segments the earliest, shortest.
* Repeated rows: passages of each. NULL doc_id is carried. Empty table: no rows.
* Labels without doc_id or class are left out; a doc_id with any toxic label is toxic.
  Without labels of both classes nothing is significant: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import WORD, column, materialize, parts_of, table

#: Bounds of the two labelled samples (documents), which fit lexicon and calibration.
SAMPLE = 12_000
#: Dirichlet mass of a parent, significance (standard deviations) of an entry, and
#: its least count; scores are in steps of half a nat less the drift per token.
MASS, SIGNIFICANT, SUPPORT, STEP, DRIFT, TOP = 2.0, 3.0, 3, 2.0, 2, 20
#: Lengths of the prefixes that words share evidence by.
SHORTEST, LONGEST = 3, 10
P_MAX = 5e-3
SCHEMA = "doc_id bigint, passage int, start_char int, end_char int, n_tokens int, score int, e_value double, doc_p_value double, text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("passage", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("score", pa.int32()), ("e_value", pa.float64()), ("doc_p_value", pa.float64()), ("text", pa.string())])


@dataclass(frozen=True)
class Model:
    scores: dict[str, int]
    lam: float
    k: float

    def score(self, word: str) -> int:
        word = word.lower()
        for key in reversed(_keys(word)):
            found = self.scores.get(key)
            if found is not None:
                return found
        return -DRIFT

    def e_value(self, score: float, n: int) -> float:
        return self.k * n * math.exp(-self.lam * score)


def segments(scores: list[int]) -> list[tuple[int, int, int]]:
    """All maximal scoring segments, (start, end, score), in linear time.

    Candidates are kept with the sums before and up to them. ``back`` links each to
    the nearest earlier candidate with a smaller sum before it, so that a merge jumps
    over those that can't matter again.
    """
    low: list[int] = []
    high: list[int] = []
    spans: list[list[int]] = []
    back: list[int] = []
    total = 0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, lo = i, before
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = back[j]
            if j < 0 or high[j] >= total:
                low.append(lo)
                high.append(total)
                spans.append([start, i + 1])
                back.append(j)
                break
            start, lo = spans[j][0], low[j]
            del low[j:], high[j:], spans[j:], back[j:]
    return [(a, b, h - lo) for (a, b), lo, h in zip(spans, low, high, strict=True)]


class _Scorer:
    def __init__(self, model: Model, limit: int = 250_000) -> None:
        self.model, self.limit, self.known = model, limit, {}

    def __call__(self, text: str) -> list[int]:
        words = WORD.findall(text)
        known = self.known
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for word in set(words):
                if word not in known:
                    known[word] = self.model.score(word)
            return list(map(known.__getitem__, words))


def _sample(labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, toxic, part): two disjoint hash-chosen samples of ``size`` labels, for broadcast."""
    clean = labels.select(column(labels, "doc_id", "bigint").alias("__l"), column(labels, "toxic", "int").alias("__y"))
    one = clean.where("__l IS NOT NULL AND __y IS NOT NULL").groupBy("__l").agg(F.max((F.col("__y") > 0).cast("int")).alias("__y"))
    chosen = one.withColumn("__h", F.xxhash64(F.lit(11), "__l")).orderBy("__h", "__l").limit(2 * size)
    return chosen.select("__l", "__y", F.pmod(F.xxhash64(F.lit(12), "__l"), F.lit(2)).cast("int").alias("__part"))


def _logit(p: float) -> float:
    return math.log(p) - math.log1p(-p)


def _keys(word: str) -> list[str]:
    """The nodes of a word from the root down: its prefixes, then the whole word."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"]


def lexicon(counts: dict[str, tuple[int, int]], root: float) -> dict[str, int]:
    """Scores of the counted nodes (toxic, clean documents).

    A node's prior is what its ancestors say without the node's own counts, so that
    nothing is counted twice down a chain of nested prefixes.
    """
    scores = {}
    for key, (t, c) in counts.items():
        line = [k for k in _keys(key.rstrip("$"))[:-1] if k in counts and k != key] + [key]
        rate = root
        for up, down in zip(line, line[1:], strict=False):
            dt, dc = counts[up][0] - counts[down][0], counts[up][1] - counts[down][1]
            rate = (dt + MASS * rate) / (dt + dc + MASS)
        own = (t + MASS * rate) / (t + c + MASS)
        gap = _logit(own) - _logit(root)
        scores[key] = max(min(round(STEP * gap) - DRIFT, TOP), -DRIFT)
    return scores


def _train_lexicon(rows: DataFrame) -> dict[str, int]:
    """Document frequencies by class of words and prefixes of the first sample.

    Only nodes significantly above the root come to the driver, and the nodes right
    below those, so that a clean word isn't taken for its toxic prefix.
    """
    words = F.array_remove(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+")), "")
    nodes = F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.filter(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.when(F.length(w) >= n, F.substring(w, F.lit(1), n)).otherwise("")), lambda p: p != ""), F.array(F.concat(w, F.lit("$")))))))
    counted = rows.where("__part = 0").select("__y", F.explode(nodes).alias("k")).groupBy("k").agg(F.sum("__y").cast("int").alias("t"), F.sum(1 - F.col("__y")).cast("int").alias("c"))
    counted = materialize(counted, "toxicity-nodes")
    sums = counted.where(F.col("k").endswith("$")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not sums.t or not sums.c:
        return {}
    root = sums.t / (sums.t + sums.c)
    rate = (F.col("t") + MASS * root) / (F.col("t") + F.col("c") + MASS)
    z = (F.log(rate / (1 - rate)) - _logit(root)) / F.sqrt(1 / (F.col("t") + MASS * root) + 1 / (F.col("c") + MASS * (1 - root)))
    above = counted.where((F.col("t") >= SUPPORT) & (z >= SIGNIFICANT))
    parent = F.when(F.col("k").endswith("$"), F.substring("k", F.lit(1), F.least(F.length("k") - 1, F.lit(LONGEST)))).otherwise(F.expr("substring(k, 1, length(k) - 1)"))
    below = counted.where("t + c >= 2").withColumn("up", parent).join(above.select(F.col("k").alias("ak")), F.col("up") == F.col("ak"), "left_semi").select("k", "t", "c")
    found = {r.k: (r.t, r.c) for r in above.unionByName(below).distinct().collect()}
    return lexicon(found, root)


def calibrate(histogram: dict[int, int], bests: list[tuple[int, int]]) -> tuple[float, float]:
    """``lam`` and ``k`` from counts of token scores and (tokens, best score) of clean documents.

    One count more is spread over all positive scores, so that those which a clean
    sample of this size happens not to hold aren't taken for impossible.
    """
    values = np.arange(-DRIFT, TOP + 1)
    counts = np.array([histogram.get(int(v), 0) + (1.0 / TOP if v > 0 else 0.0) for v in values])
    p = counts / counts.sum()
    low, high = 1e-6, 20.0
    if (p * values).sum() >= 0:
        return 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    total = sum(n * math.exp(-low * best) for n, best in bests)
    return low, min(max(len(bests) / total if total else 1.0, 1e-4), 10.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and calibration; both samples hold at most ``sample`` documents or so."""
    plain = docs.select(column(docs, "doc_id", "bigint").alias("__id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    rows = plain.join(F.broadcast(_sample(labels, sample)), F.col("__id") == F.col("__l")).select("__y", "__part", "text")
    scores = _train_lexicon(rows)
    if not scores:
        return Model({}, 0.0, 1.0)
    draft = Model(scores, 0.0, 1.0)

    def counted(batches):
        scorer = _Scorer(draft)
        for part in parts_of(batches, "text"):
            out: dict[tuple[int, int, int], int] = {}
            for (text,) in part:
                found = scorer(text)
                n, best = len(found), max((s for _, _, s in segments(found)), default=0)
                out[(1, n, best)] = out.get((1, n, best), 0) + 1
                for value, count in zip(*np.unique(found, return_counts=True), strict=True) if found else ():
                    out[(0, int(value), 0)] = out.get((0, int(value), 0), 0) + int(count)
            if out:
                yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in out], "a": [k[1] for k in out], "b": [k[2] for k in out], "n": list(out.values())}, schema=pa.schema([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    found = rows.where("__part = 1 AND __y = 0").select("text").mapInArrow(counted, "kind int, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    lam, k = calibrate({r.a: r.n for r in found if r.kind == 0}, [(r.a, r.b) for r in found if r.kind == 1 for _ in range(r.n)])
    return Model(scores, lam, k)


def document_test(scores: list[int], n: int, model: Model) -> tuple[float, int]:
    """(p, r): the sum test of the document's segments, best first, and how many count.

    The sum of the r best normalised scores has the tail
    exp(-t) t^(r-1) / (r! (r-1)!); a factor of 2 for each further segment pays for
    the choice of r.
    """
    base, best, kept, total = math.log(model.k * n), 1.0, 0, 0.0
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        total += model.lam * score - base
        if total <= r:
            continue
        log_p = -total + (r - 1) * (math.log(total) + math.log(2)) - math.lgamma(r + 1) - math.lgamma(r)
        if log_p < math.log(best):
            best, kept = max(math.exp(max(log_p, -700.0)), 1e-300), r
    return best, kept


def passages_of(text: str, model: Model, scorer, p_max: float) -> tuple[float, list[tuple[int, int, int, int, float]]]:
    """p of the text, and (start_char, end_char, n_tokens, score, e_value) of what is toxic in it."""
    scores = scorer(text)
    if not scores or max(scores) <= 0 or not model.lam:
        return 1.0, []
    found = segments(scores)
    p, kept = document_test([s for _, _, s in found], len(scores), model)
    if p > p_max:
        return p, []
    ranked = sorted(found, key=lambda x: (-x[2], x[0]))
    chosen = sorted(x for i, x in enumerate(ranked) if i < kept or model.e_value(x[2], len(scores)) <= p_max)
    places = [m.span() for m in WORD.finditer(text)]
    return p, [(places[a][0], places[b - 1][1], len(scores), s, model.e_value(s, len(scores))) for a, b, s in chosen]


def toxic_passages(docs: DataFrame, model: Model, p_max: float = P_MAX) -> DataFrame:
    """Every significant passage of every document; documents without any give no row.

    ``e_value`` is a passage's expected number by chance, ``doc_p_value`` that of the
    document's passages together. A map over the rows: the
    model, whose size is bounded by the sample, goes to the tasks; nothing is shuffled.
    """
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = sent.value
        scorer = _Scorer(model)
        for part in parts_of(batches, "doc_id", "text"):
            out = []
            for doc_id, text in part:
                if not text:
                    continue
                least, found = passages_of(text, model, scorer, p_max)
                if found:
                    out += [(doc_id, i, *f, least, text[f[0] : f[1]]) for i, f in enumerate(found)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return rows.mapInArrow(scan, SCHEMA)


def op1_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_passages(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxic_passages": op1_toxic_passages}
ORACLES: dict = {}
