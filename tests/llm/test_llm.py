"""The training-data operators against SQL, brute force, round trips and held-out data,
and on awkward rows: NULLs, empty and long texts, ties, repeats, empty tables, clashing names."""

import gzip
import math
import random
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import ann, bm25, bpe, chat, mixing, ngram_join, quality, registry, secret_scan, toxicity, warc
from spindrift.llm.common import WORD, WordHasher, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "a text without an id", None, None, 20), (None, None, None, None, None),
    (3, "the very same words here", "en", "s", 24), (3, "the very same words here", "en", "s", 24), (4, "the very same words here", None, "s", 24),
    (5, LONG, "en", "t", len(LONG)), (6, "!!! ??? ...", "en", "t", 11), (7, "ünïcödé \u0000 😀 ퟿ ñ", "de", "", 18),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, None, None), (3, 1, 0), (3, 0, 1), (None, 1, 1), (5, 1, 0), (6, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, data, name):
    assert oracle.compare(spark, registry.QUERIES[name], registry.ORACLES[name], data) > 0


# ---- 1 toxicity ---------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal segments by their definition: the best, then those left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or (total, -(b - a)) > (best[2], -(best[1] - 1 - best[0]))):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments():
    r = random.Random(3)
    for _ in range(400):
        scores = [r.choice([-5, -3, -2, -1, 0, 1, 2, 4]) for _ in range(r.randint(0, 25))]
        assert sorted(s for _, _, s in toxicity.segments(scores)) == sorted(s for _, _, s in brute_segments(scores))
        for a, b, s in toxicity.segments(scores):
            assert sum(scores[a:b]) == s > 0


def test_calibration():
    lam, k = toxicity.calibrate({-2: 10_000, 3: 20}, [(100, 3), (100, 0)])
    counts = {v: (1 / toxicity.TOP if v > 0 else 0) for v in range(-2, toxicity.TOP + 1)}
    counts[-2] += 10_000
    counts[3] += 20
    assert sum(c * math.exp(lam * v) for v, c in counts.items()) / sum(counts.values()) == pytest.approx(1, abs=1e-6)
    assert k == pytest.approx(2 / (100 * math.exp(-3 * lam) + 100), rel=1e-6)


def test_toxic_accuracy(spark):
    """Planted words, seen and unseen endings of a planted stem; clean texts are left alone."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "er", "tion", "th", "ou", "in", "le"]) for _ in range(r.randint(1, 4)))
    docs, marks = [], []
    for i in range(1200):
        words = [word() for _ in range(r.randint(8, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vileword", "zorg" + word()]))
        docs.append((i, " ".join(words), "en", "s", 0))
        if i < 900:
            marks.append((i, 1, int(toxic)))
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    hits = {x.doc_id for x in toxicity.toxic_passages(spark.createDataFrame(docs[900:], DOCS), model).collect()}
    truth = {i for i in range(900, 1200) if i % 6 == 0}
    assert len(hits & truth) >= 0.95 * len(truth) and len(hits - truth) <= 3


def test_toxic_odd(spark, odd, empty, labels, no_labels):
    assert toxicity.toxic_passages(empty, toxicity.train(empty, no_labels)).count() == 0
    assert toxicity.toxic_passages(odd, toxicity.train(odd, no_labels)).count() == 0
    toxicity.toxic_passages(odd, toxicity.train(odd, labels)).collect()
    model = toxicity.Model({"bad$": 12}, 1.0, 0.01)
    rows = spark.createDataFrame([(None, "x bad y"), (1, "x bad y"), (1, "x bad y"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.text) for x in toxicity.toxic_passages(rows, model).collect()) == [(-1, "bad"), (1, "bad"), (1, "bad")]


def test_passages_by_brute_force():
    """The document's sum test, tried for every number of segments, and each segment's own e-value."""
    r = random.Random(4)
    for lam, k in ((0.3, 0.1), (0.9, 0.4)):
        model = toxicity.Model({"bad$": 9, "worse$": 20, "meh$": 1}, lam, k)
        for _ in range(60):
            words = [r.choices(["fine", "bad", "worse", "meh"], [40, 3, r.choice([0, 2]), 3])[0] for _ in range(r.randint(1, 400))]
            text = " ".join(words)
            scores = [model.score(w) for w in words]
            found = sorted(brute_segments(scores), key=lambda x: (-x[2], x[0]))
            n, tails = len(words), []
            for m in range(1, len(found) + 1):
                x = sum(lam * s - math.log(k * n) for *_, s in found[:m])
                if x > m:
                    tails.append((math.exp(-x) * x ** (m - 1) * 2 ** (m - 1) / (math.factorial(m) * math.factorial(m - 1)), m))
            p, m = min(tails, default=(1.0, 0))
            want = {f for i, f in enumerate(found) if p <= toxicity.P_MAX and p < 1 and (i < m or k * n * math.exp(-lam * f[2]) <= toxicity.P_MAX)}
            got_p, got = toxicity.passages_of(text, model, toxicity._Scorer(model), toxicity.P_MAX)
            assert got_p == pytest.approx(min(p, 1.0))
            places = [x.span() for x in WORD.finditer(text)]
            assert sorted((a, b, s) for a, b, _, s, _ in got) == sorted((places[a][0], places[b - 1][1], s) for a, b, s in want)


def test_weaker_passage_beside_a_strong_one():
    model = toxicity.Model({"bad$": 20, "ill$": 15}, 0.3, 0.1)
    words = ["fine"] * 200 + ["bad"] * 75 + ["fine"] * 800 + ["ill"] * 3 + ["fine"] * 100
    _, found = toxicity.passages_of(" ".join(words), model, toxicity._Scorer(model), toxicity.P_MAX)
    assert [s for _, _, _, s, _ in found] == [1500, 45]


# ---- 2 search -----------------------------------------------------------------------------


def brute_bm25(docs, query, k):
    texts = [(i, Counter(WORD.findall((t or "").lower()))) for i, t in docs]
    mean = sum(sum(c.values()) for _, c in texts) / len(texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for i, c in texts:
        score, hit = 0.0, False
        for w, times in sorted(Counter(WORD.findall(query.lower())).items()):
            if c[w]:
                hit = True
                idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                score += times * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        if hit:
            out.append((round(score, 6), i))
    return sorted(out, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]


@pytest.mark.parametrize("shard", [50, 400, 10**6])
def test_bm25_brute(spark, shard):
    r = random.Random(shard)
    vocabulary = [f"w{int(60 * r.random() ** 2)}" for _ in range(400)]
    docs = [(i if i % 17 else None, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs += docs[:20] + [(900, None)]
    queries = [(q, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))) for q in range(25)]
    got = defaultdict(list)
    for x in bm25.bm25_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string"), k=7, shard_tokens=shard, batch=3).orderBy("item_id", "rank").collect():
        got[x.item_id].append((x.score, x.doc_id))
    for q, text in queries:
        want = brute_bm25(docs, text, 7)
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert [i for _, i in got[q]] == [i for _, i in want]


def test_bm25_batches_read_one_index(spark):
    """The index is built by one pass over the texts; any batches and other queries read the same table."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choices("abcdefghij", k=r.randint(1, 40)))) for i in range(200)], "doc_id long, text string").withColumns({"terms": F.lit(1), "q": F.lit(2)})
    queries = spark.createDataFrame([(i, " ".join(r.choices("abcdefghijk", k=4))) for i in range(9)], "item_id long, text string").withColumns({"term": F.lit(1), "df": F.lit(2)})
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    index = bm25.build_index(docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string"), 300)
    whole = sorted(map(tuple, bm25.search_index(index, queries).collect()))
    assert len(whole) == 90 and sorted(map(tuple, bm25.search_index(index, queries, batch=2).collect())) == whole
    assert sorted(map(tuple, bm25.bm25_search(docs, queries).collect())) == whole and passes.value == 200


def test_bm25_odd(spark, odd, empty):
    queries = spark.createDataFrame([(1, "lorem words"), (2, None), (3, ""), (4, "..."), (None, "same same"), (5, "nowhere")], "item_id long, text string")
    got = bm25.bm25_search(odd, queries, k=2).collect()
    assert {x.item_id for x in got} == {1, None}
    assert [x.doc_id for x in got if x.item_id is None] == [3, 3]
    assert bm25.bm25_search(empty, queries).count() == 0
    assert bm25.bm25_search(odd, queries.where("item_id = 2")).count() == 0


# ---- 3 near duplicates --------------------------------------------------------------------


def brute_sets(docs, n):
    h = WordHasher()
    return [(i, frozenset(ngram_join.gram_set(WORD.findall((x or "").lower()), n, h).tolist())) for i, x in docs]


def brute_links(docs, n, t):
    """Jaccard of all pairs of different sets, and (doc_id, class_id, n_links) of every document."""
    sets = brute_sets(docs, n)
    pairs, group, links = set(), list(range(len(sets))), [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) / len(x | y) >= t:
                if x != y:
                    pairs.add((frozenset((x, y)), round(len(x & y) / len(x | y), 9)))
                links[a], links[b] = links[a] + 1, links[b] + 1
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for (i, _), g in zip(sets, group, strict=True):
        if i is not None:
            least[g] = i if least[g] is None else min(i, least[g])
    return pairs, Counter((i, least[g], k) for (i, _), g, k in zip(sets, group, links, strict=True))


def joined(frame, *args):
    return Counter((x.doc_id, x.class_id, x.n_links) for x in ngram_join.ngram_jaccard_join(frame, *args).collect())


def near_copies(r, groups, most=5):
    docs = []
    for i in range(groups):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 5, 9, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, most])):
            copy = list(words)
            for _ in range(int(len(copy) * r.choice([0, 0.02, 0.05, 0.15]) + r.random())):
                copy[r.randrange(len(copy))] = f"w{r.randint(0, 400)}"
            docs.append((len(docs) if r.random() > 0.03 else None, " ".join(copy)))
    return docs + docs[:5] + [(1000, None), (1001, ""), (1002, "...")]


@pytest.mark.parametrize(("n", "t"), [(1, 0.5), (2, 0.8), (3, 0.6), (2, 1.0)])
def test_join_brute(spark, n, t):
    docs = near_copies(random.Random(int(10 * n + 100 * t)), 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    pairs, rows = brute_links(docs, n, t)
    assert joined(frame, n, t) == rows
    _, found = ngram_join.similar_sets(frame, n, t)
    assert Counter(round(x.jaccard, 9) for x in found.collect()) == Counter(j for _, j in pairs)


def test_join_in_blocks(spark, monkeypatch):
    """Cells that are cut into blocks, several chunk files and parts: the same rows."""
    docs = near_copies(random.Random(77), 12, most=40)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute_links(docs, 2, 0.75)[1]
    assert joined(frame) == want
    for name, value in (("BLOCK_SETS", 3), ("CHUNK_GRAMS", 500), ("PART_GRAMS", 300), ("COLUMNS", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    assert joined(frame) == want


@pytest.mark.parametrize("join", [joined, lambda frame: ngram_join.similar_sets(frame)[1].count()])
def test_join_writes_few_files(spark, monkeypatch, join):
    """The number of files written follows the size of a table, not the number of parts."""
    docs = near_copies(random.Random(31), 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    files, plain = {}, ngram_join.materialize

    def counted(rows, name):
        out = plain(rows, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    monkeypatch.setattr(ngram_join, "PART_GRAMS", 100)
    found = join(frame)
    assert found == (brute_links(docs, 2, 0.75)[1] if join is joined else len(brute_links(docs, 2, 0.75)[0]))
    assert max(files[name] for name in ("ngram-centres", "ngram-near", "ngram-links")) <= 4, files


def test_join_drops_no_pair_with_shared_passages(spark):
    """Large sets leave cells of few shared keys; pairs at the threshold stay, whatever passages others share."""
    r = random.Random(12)
    passages = [[f"p{k}x{j}" for j in range(60)] for k in range(6)]
    docs = []
    for i in range(60):
        words = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([130, 200, 500, 900, 1500]))]
        for p in r.sample(passages, 3):
            at = r.randrange(len(words))
            words[at:at] = p
        docs.append((10 * i, " ".join(words)))
        for k in range(r.choice([0, 1, 2])):
            copy = list(words)
            for at in r.sample(range(len(copy)), int(len(copy) * r.choice([0.05, 0.065, 0.07, 0.075]))):
                copy[at] = f"x{r.randint(0, 10**6)}"
            docs.append((10 * i + k + 1, " ".join(copy)))
    assert ngram_join.shared_keys(9, 0.75) > 10
    pairs, rows = brute_links(docs, 2, 0.75)
    assert any(j < 0.77 for _, j in pairs)
    assert joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == rows


def test_packed_counts():
    r = np.random.default_rng(4)
    for top in (500, 1 << 31, (1 << 32) - 1):
        v = np.unique(r.integers(top + 1, size=400).astype(np.uint32))
        n = r.integers(1, 300, size=len(v))
        values, counts = ngram_join.opened_counts(ngram_join.packed_counts(v, n))
        assert values.tolist() == v.tolist() and counts.tolist() == np.minimum(n, 255).tolist()


def test_common_counts():
    r = np.random.default_rng(3)
    for m in (2, 3, 17):
        sets = [np.unique(r.integers(300, size=r.integers(1, 400))).astype(np.uint64) for _ in range(m)]
        assert ngram_join.common_counts(sets).tolist() == [[len(np.intersect1d(x, y)) if x is not y else common for y, common in zip(sets, row, strict=True)] for x, row in zip(sets, ngram_join.common_counts(sets).tolist(), strict=True)]


def test_short_sketch_bounds_the_difference():
    r = np.random.default_rng(9)
    for size in (5, 130, 900, 5000):
        a = np.unique(r.integers(1 << 32, size=size).astype(np.uint32))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], r.integers(1 << 32, size=size // 4).astype(np.uint32)]))
        x, y = ngram_join.short_sketch(a), ngram_join.short_sketch(b)
        w = min(len(x), len(y))
        assert np.bitwise_count(ngram_join.folded(x, w) ^ ngram_join.folded(y, w)).sum() <= len(np.setxor1d(a, b))


def test_sketch_bounds_the_difference():
    """Differing words never outnumber the differing n-grams, and similar sets share the keys they must."""
    r = np.random.default_rng(2)
    for size in (3, 17, 120, 900, 4090, 9000):
        for _ in range(30):
            a = np.unique(r.integers(1 << 63, size=size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * 0.95)], r.integers(1 << 63, size=int(len(a) * 0.05)).astype(np.uint64)]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ka, kb = (set(np.concatenate(ngram_join.sketch_keys(x.astype(np.uint32), x >> np.uint64(3) & np.uint64(31), 0.8)).tolist()) for x in (a, b))
            assert j < 0.8 or len(ka & kb) >= ngram_join.shared_keys(ngram_join.own_band(max(len(a), len(b))), 0.8)


def test_join_default_threshold(spark):
    """The registered threshold holds the near copies of Jaccard 0.75 to 0.8."""
    r = random.Random(6)
    docs = []
    for i in range(30):
        words = [f"w{r.randint(0, 5000)}" for _ in range(200)]
        copy = list(words)
        for at in r.sample(range(0, 200, 2), 13):
            copy[at] = f"x{r.randint(0, 5000)}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    pairs, rows = brute_links(docs, ngram_join.N, 0.75)
    assert len(pairs) == 30 and all(0.75 <= j < 0.8 for _, j in pairs)
    assert joined(spark.createDataFrame(docs, "doc_id long, text string")) == rows


@pytest.mark.parametrize("t", [0.5, 0.65, 0.75, 0.8, 0.95])
def test_sketch_has_more_words_than_differ(t):
    for size in range(1, 5000):
        assert all(d < ngram_join.places(band, t) for band, d in ngram_join.bands(size, t))


def test_join_odd(spark, odd, empty):
    assert joined(empty) == Counter()
    got = joined(odd.withColumns({"th": F.lit(1), "sid": F.lit(2), "A": F.lit(3)}))
    assert got == Counter([(1, 1, 0), (2, 2, 0), (None, None, 0), (None, None, 0), (3, 3, 2), (3, 3, 2), (4, 3, 2), (5, 5, 0), (6, 6, 0), (7, 7, 0)])


def test_components_odd(spark):
    rows = [(1, 2), (2, 3), (2, 3), (5, 5), (None, 7), (9, 8)]
    got = ngram_join.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert sorted((x.node, x.root) for x in got) == [(2, 1), (3, 1), (9, 8)]


def test_keep_one(spark, odd, empty):
    assert ngram_join.keep_one(empty).count() == 0
    clash = odd.withColumns({"_d": F.lit(1), "_H": F.lit(2), "sid": F.lit(3), "stays": F.lit(4), "m": F.lit(5)})
    for frame in (odd, clash):
        kept = ngram_join.keep_one(frame)
        assert kept.columns == frame.columns
        assert Counter(x.doc_id for x in kept.collect()) == Counter([1, 2, None, None, 3, 5, 6, 7])
    chain = [(i, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 100))) for i in range(30)]
    rows = spark.createDataFrame(chain, "doc_id long, text string")
    assert [x.doc_id for x in ngram_join.keep_one(rows).collect()] == [0]


def test_keep_one_default_threshold(spark):
    """Copies with 5 to 7 % of their words changed, one at a time, fall in the original's group."""
    r = random.Random(8)
    docs = []
    for i in range(8):
        words = [f"w{r.randint(0, 100_000)}" for _ in range(300)]
        docs.append((10 * i, " ".join(words)))
        for k, share in enumerate((0.05, 0.06, 0.07)):
            copy = list(words)
            for at in r.sample(range(1, 299, 2), int(300 * share)):
                copy[at] = f"x{r.randint(0, 100_000)}"
            docs.append((10 * i + k + 1, " ".join(copy)))
    assert any(0.75 <= j < 0.8 for _, j in brute_links(docs, ngram_join.N, 0.7)[0])
    kept = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [10 * i for i in range(8)]


# ---- 4 secrets ----------------------------------------------------------------------------


def test_secrets_held_out():
    tagger = secret_scan.Tagger(secret_scan.train())
    right = wrong = missed = 0
    r = random.Random(991)
    for _ in range(800):
        text, spans = secret_scan.sentence(r)
        got = set(tagger.secrets(text))
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right > 0.95 * (right + wrong) and right > 0.95 * (right + missed)


def test_field_is_fitted_in_a_task_once(spark, monkeypatch):
    one = secret_scan.fitted(spark, sentences=60, steps=3)
    assert secret_scan.fitted(spark, sentences=60, steps=3) is one
    here = secret_scan.train(sentences=60, steps=3)
    assert one.names == here.names and np.allclose(one.weights, here.weights) and np.allclose(one.trans, here.trans)


def test_pruned_decoding_is_viterbi():
    model = secret_scan.train()
    tagger = secret_scan.Tagger(model)
    r = random.Random(17)
    for _ in range(200):
        tokens = secret_scan.TOKEN.findall(secret_scan.sentence(r)[0])
        rows = np.stack([model.rows(t) for t in tokens])
        e = secret_scan.emissions(rows, model.files[secret_scan.file_class(len(tokens), sum(t in secret_scan._MARKS for t in tokens), sum(any(c.isdigit() for c in t) for t in tokens))])
        tags, spans, begun = secret_scan.viterbi(e, model.trans, model.start, np.zeros(3)), [], -1
        for i, tag in enumerate([*tags, 2]):
            if begun >= 0 and tag != 1:
                spans.append((begun, i))
                begun = -1
            if tag == 0 or (tag == 1 and begun < 0):
                begun = i
        assert spans == tagger.spans(tokens)


def test_viterbi_brute():
    from itertools import product

    r = np.random.default_rng(4)
    for _ in range(30):
        e, t, a, z = r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3)
        score = lambda y: a[y[0]] + z[y[-1]] + sum(e[i, y[i]] for i in range(5)) + sum(t[x, w] for x, w in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert tuple(secret_scan.viterbi(e, t, a, z)) == max(product(range(3), repeat=5), key=score)


def test_secrets_odd(spark, odd, empty):
    assert secret_scan.secret_spans(empty).count() == 0 and secret_scan.redact_secrets(empty).count() == 0
    key = "AKIA" + "S6E5CWPN23E276HE"
    rows = odd.unionByName(spark.createDataFrame([(8, f"an er {key} tion", "en", "s", 31), (8, f"an er {key} tion", "en", "s", 31), (None, f'x token = "{"0123456789abcdef" * 2}"', "en", "s", 1)], DOCS))
    got = secret_scan.secret_spans(rows).collect()
    assert sorted((x.doc_id or -1, x.secret) for x in got) == [(-1, "0123456789abcdef" * 2), (8, key), (8, key)]
    done = secret_scan.redact_secrets(rows.withColumns({"c0": F.lit(1), "C1X": F.lit("x")}))
    assert done.columns == [*rows.columns, "c0", "C1X"]
    texts = Counter(x.text for x in done.collect())
    assert texts["an er [SECRET] tion"] == 2 and texts[LONG] == 1 and texts[None] == 2
    assert {x.n_chars for x in done.where("doc_id = 8").collect()} == {len("an er [SECRET] tion")}


# ---- 5 chat -------------------------------------------------------------------------------


def test_chat_windows(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(40), None]:
        if r.random() < 0.5:
            rows.append((c, 0, "system", "s " * r.randint(1, 30)))
        rows += [(c, t, r.choice(["user", "assistant", None, "system"]), "w " * r.choice([0, 3, 40, 200, 900])) for t in range(1, r.randint(2, 15))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] is not None, x[2] or "", x[3])):
        turns[c].append((role or "user", text))
    seen = defaultdict(list)
    for w in chat.chat_windows(frame).orderBy("conv_id", "window_no").collect():
        own = turns[w.conv_id]
        lead = 0
        while lead < len(own) and own[lead][0] == "system":
            lead += 1
        first = max(w.first_pos, lead)
        chosen = own[:lead] + own[first - w.n_history : w.last_pos + 1]
        assert w.text == "".join(chat.render(*t) for t in chosen)
        assert w.n_tokens == sum(len(t.split()) + chat.OVERHEAD for _, t in chosen)
        assert w.n_tokens <= chat.BUDGET or (w.over_budget and first == w.last_pos)
        marked = [w.text[int(a) : int(b)] for a, b in (x.split("-") for x in w.targets.split(",") if x)]
        assert marked == [t + "<|end|>\n" for role, t in own[first : w.last_pos + 1] if role == "assistant"]
        seen[w.conv_id] += range(first, w.last_pos + 1)
    for c, own in turns.items():
        lead = next((i for i, t in enumerate(own) if t[0] != "system"), len(own))
        assert seen[c] == list(range(lead, len(own)))


def test_chat_odd(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.chat_windows(spark.createDataFrame([], schema)).count() == 0
    got = chat.chat_windows(spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 0, "system", "only")], schema).withColumn("tokens", F.lit(9))).orderBy("conv_id").collect()
    assert [(x.conv_id, x.n_tokens, x.targets) for x in got] == [(1, 8, ""), (2, 5, "")]


def test_chat_counts_texts_without_spaces(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "字" * 500) for t in range(6)]
    got = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window_no").collect()
    assert [(x.first_pos, x.last_pos, x.n_tokens) for x in got] == [(i, i, 379) for i in range(6)]


def test_chat_very_many_turns(spark):
    turns = spark.range(60_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'one two three' AS text")
    got = chat.chat_windows(turns).agg(F.max("last_pos"), F.sum(F.col("last_pos") - F.col("first_pos") + 1), F.max("n_tokens")).first()
    assert got[0] == 59_999 and got[1] == 60_000 and got[2] <= chat.BUDGET


def test_chat_sql_on_odd_rows(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 3, None]), r.randint(0, 4), r.choice(["user", "assistant", "system", None]), r.choice(["", None, "a b c", "w " * 150, "v " * 600])) for _ in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    oracle.compare(spark, chat.op5_chat_windows, chat.ORACLE, str(tmp_path))


# ---- 6 neighbours -------------------------------------------------------------------------


def test_ann_recall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 32)).astype(np.float32)
    x[700:900] = x[:200] + 0.1 * r.normal(size=(200, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(dict)
    for row in ann.ann_search(frame, k=10, every=1, block=256).collect():
        got[row.vec_id][row.neighbor_id] = row.cosine
    u = ann.unit(x)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, 1)[:, :10]
    assert all(len(v) == 10 for v in got.values()) and len(got) == 1500
    assert np.mean([len(set(top[i].tolist()) & set(got[i])) / 10 for i in range(1500)]) >= 0.9
    assert max(abs(cos[i, j] - c) for i, v in got.items() for j, c in v.items()) < 1e-5


def test_byte_index_is_exact():
    r = np.random.default_rng(6)
    codes = r.integers(0, 256, (300, 8)).astype(np.uint8)
    index = ann.ByteIndex(codes)
    queries = codes[:40] ^ (r.random((40, 8)) < 0.2).astype(np.uint8)
    distance = np.bitwise_count(queries[:, None] ^ codes[None]).sum(2)
    for radius in (0, 3, 9, 20, 28, 64):
        assert (index.within(queries, index.probed(radius), radius) == (distance <= radius)).all()


def test_ann_odd(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.ann_search(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0])]
    wide = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in ("x", "code", "block", "value", "h", "q_row")})
    got = ann.ann_search(wide, k=2, every=1).collect()
    assert Counter(x.vec_id for x in got) == Counter({1: 4, 7: 2}) and any(x.neighbor_id is None for x in got)
    assert {x.vec_id for x in ann.ann_search(wide, k=2, every=7).collect()} == {7} and ann.ann_search(wide, every=5).count() == 0
    assert all(x.neighbor_id == 1 and x.cosine == 1 for x in got if x.vec_id == 1 and x.rank == 1)
    assert ann.ann_search(spark.createDataFrame(rows[:1], schema), every=1).count() == 0


def test_ann_on_clusters(spark):
    """Clustered vectors: all neighbours, a part of the blocks, and no product of tables."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 64))
    shares = []
    for size in (25, 100):
        x = (np.repeat(centres, size, 0) + 0.05 * r.normal(size=(40 * size, 64))).astype(np.float32)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
        got = defaultdict(list)
        for row in ann.ann_search(frame, every=50, block=100).orderBy("vec_id", "rank").collect():
            got[row.vec_id].append(row.neighbor_id)
        u = ann.unit(x.astype(np.float64))
        cos = u @ u.T
        np.fill_diagonal(cos, -2)
        assert sorted(got) == list(range(0, 40 * size, 50))
        assert np.mean([len(set(np.argsort(-cos[i])[:10].tolist()) & set(v)) / 10 for i, v in got.items()]) >= 0.95
        mean, matrix = ann.learn_rotations(ann.unit(x))
        blocks = ann._blocks(ann._coded(ann._clean(frame), mean, matrix), len(x), 100)
        queries, index = ann._queries(blocks, 50), ann._index(blocks)
        routed = ann._routed(queries, index, 20, 32)
        shares.append(routed.count() / (queries.count() * blocks.count()))
        plan = ann._searched(queries, blocks, index, 20, 32, 10, 1)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert ann._routed(queries, index, 256, 32).count() == queries.count() * blocks.count()
    assert shares[1] < 0.5 and shares[1] < 0.6 * shares[0]


# ---- 7 quality ----------------------------------------------------------------------------


def test_quality_odd(spark, odd, empty, labels, no_labels):
    assert quality.quality_filter(empty, labels).count() == 0 and quality.quality_scores(empty, no_labels).count() == 0
    assert quality.quality_filter(odd, no_labels).count() == len(ODD)
    assert quality.quality_scores(odd, labels).count() == len(ODD)
    wide = odd.withColumns({"n": F.lit(1), "g": F.lit(2), "p_site": F.lit("x"), "S": F.lit(3)})
    assert quality.quality_filter(wide, labels).columns == wide.columns


def test_quality_private_names(spark, odd, labels):
    names = ["__t", "__w", "__f0", "__b0", "__b3", "__c0", "__src", "__llr", "__id", "s", "m1", "llr", "kept"]
    wide = odd.withColumns({c: F.lit(c) for c in names})
    kept = quality.quality_filter(wide, labels)
    assert kept.columns == wide.columns and all(x[c] == c for x in kept.collect() for c in names)
    assert kept.count() == quality.quality_filter(odd, labels).count()


def test_quality_held_out(spark, data):
    """Half of some 400 labels fit the classifier; the other half judge it."""
    data = f"{data.rsplit('/', 1)[0]}/sf0.01"
    docs, marks = table(spark, data, "documents"), table(spark, data, "labels")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    scores = quality.quality_scores(docs, marks.where(part == 0))
    judged = marks.where(part == 1).join(scores, "doc_id").select("quality", (F.col("p_quality") >= 0.5).alias("kept")).collect()
    assert sum(x.kept for x in judged if x.quality == 1) >= 0.97 * sum(x.quality == 1 for x in judged)
    assert sum(x.kept == (x.quality == 1) for x in judged) >= 0.9 * len(judged)


def test_sparse_sites_shrink(spark):
    rows = [("big", "en", 1.0)] * 200 + [("bad", "en", 0.05)] * 200 + [("one", "en", 0.0)]
    sites = quality.site_posteriors(spark.createDataFrame(rows, "source string, lang string, p double").withColumn("p", F.col("p").cast("decimal(18,9)")))
    rate = {x["__ps"]: x.host_rate for x in sites.collect()}
    assert rate["bad"] < 0.1 < rate["one"] < rate["big"]


# ---- 8 BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    model = bpe.load()
    return model, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def test_bpe_exact(reference, spark, data):
    model, other = reference
    r = random.Random(6)
    texts = [x.text for x in table(spark, data, "documents").collect()]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for letters in ("ab", "aAbB 12\n\té😀ñ'", "the ing and", " \n\t") for _ in range(300)]
    for text in [*texts, "<|endoftext|>", "abcd" * 20_000]:
        ids = model.encode(text)
        assert ids == other.encode_ordinary(text)
        assert model.decode(ids) == text


def test_bpe_other_vocabulary():
    import tiktoken

    model = bpe.load("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    for text in ("Grüße aus Köln, où est la bibliothèque? ñandú 12345", "日本語テキスト", "привет мир"):
        assert model.encode(text) == other.encode_ordinary(text) and model.decode(model.encode(text)) == text


def test_bpe_merges_by_brute_force():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"aa": 260, b"aab": 261}
    model, r = bpe.Bpe(ranks), random.Random(1)

    def merge(data):
        parts = [bytes([b]) for b in data]
        while True:
            pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
            if not pairs:
                return tuple(ranks[p] for p in parts)
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(2000):
        piece = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        assert model.encode_piece(piece) == merge(piece.encode())


def test_bpe_odd(spark, odd, empty):
    assert bpe.bpe_encode(empty).count() == 0
    wide = odd.withColumns({"IDS": F.lit("old"), "c1": F.lit(5)})
    done = bpe.bpe_encode(wide, keep_text=True, check=True)
    assert done.columns == [*odd.columns, "c1", "ids", "n_tokens", "round_trip"]
    for x in done.collect():
        assert (x.ids is None and x.n_tokens is None and x.round_trip is None) if x.text is None else (x.round_trip and len(x.ids) == x.n_tokens)
    back = bpe.bpe_decode(bpe.bpe_encode(odd.select("doc_id", "text"))).collect()
    assert Counter(x.text for x in back) == Counter(r[1] for r in ODD)


# ---- 9 mixing -----------------------------------------------------------------------------


def test_mixing_rates(spark):
    rows = [(i, "x" * 100, "en", "big" if i % 10 else "small", 100) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    copies = Counter((x.source, x.doc_id) for x in mixing.poisson_mix(docs, weights=weights).collect())
    for source, rate, count in (("small", 5.0, 600), ("big", 5 / 9, 5400)):
        counts = [copies[(source, i)] for i in range(6000) if (i % 10 == 0) == (source == "small")]
        assert len(counts) == count
        assert np.mean(counts) == pytest.approx(rate, abs=4 * math.sqrt(rate / count))
        assert np.var(counts) == pytest.approx(rate, rel=0.25)


def test_mixing_odd(spark, odd, empty):
    assert mixing.poisson_mix(empty).count() == 0
    done = mixing.poisson_mix(odd.withColumns({"MIX_COPY": F.lit(9), "cdf": F.lit("x"), "rate": F.lit(1)}))
    assert done.columns == [*odd.columns, "cdf", "rate", "mix_copy", "mix_key"]
    rows = done.collect()
    assert rows == mixing.poisson_mix(odd.withColumns({"MIX_COPY": F.lit(9), "cdf": F.lit("x"), "rate": F.lit(1)})).collect()
    assert all(x.mix_copy >= 0 for x in rows)


def test_mixing_private_names(spark, odd):
    names = ["__id", "__src", "__cdf", "__rs", "__u", "__n", "cdf", "c0", "c1"]
    done = mixing.poisson_mix(odd.withColumns({c: F.lit(c) for c in names})).collect()
    assert all(x[c] == c for x in done for c in names)
    assert Counter((x.doc_id, x.text, x.mix_key) for x in done) == Counter((x.doc_id, x.text, x.mix_key) for x in mixing.poisson_mix(odd).collect())


def test_mixing_sql_on_odd_rows(spark, odd, tmp_path):
    odd.where("text IS NULL OR NOT contains(text, char(0))").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    oracle.compare(spark, mixing.op9_poisson_mix, mixing.ORACLE, str(tmp_path))


# ---- 10 WARC ------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>one</p>"), (1, "http://a/1", "<p>one</p>"), (None, None, None), (2, "http://a/2\nx", ""), (3, "http://a/3", "é" * 300_000), (4, "u", "WARC/1.0\r\n\r\nnot a record")]


def test_warc_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("path", F.lit(1))
    index = warc.normalize(warc.write_monolithic(frame.coalesce(1), f"file://{tmp_path}/in"), f"file://{tmp_path}/out").orderBy("record_no").collect()
    assert [x.record_no for x in index] == list(range(6)) and {x.status for x in index} == {"ok"}
    whole = b""
    for x, page in zip(index, PAGES, strict=True):
        header, block = warc.record(*page)
        record = warc.read_record(x.warc_file, x.offset, x.length)
        assert record == header + block + b"\r\n\r\n" and x.block_length == len(block)
        whole += record
    target = index[0].warc_file.removeprefix("file://")
    assert gzip.open(target).read() == whole == gzip.open(index[0].source_file.removeprefix("file://")).read()
    assert len(open(target + ".idx").readlines()) == 6


def test_warc_damage(spark, tmp_path):
    good = b"".join(h + b + b"\r\n\r\n" for h, b in (warc.record(i, "u", "x" * 500) for i in range(3)))
    cases = {
        "cut": (gzip.compress(good[:-600]), ["ok", "ok", "truncated"]), "torn": (gzip.compress(good)[:-30], None), "plain": (good, ["malformed"]), "junk": (gzip.compress(good + b"hello"), ["ok"] * 3 + ["malformed"]),
        "empty": (b"", []), "members": (gzip.compress(good[:700]) + gzip.compress(good[700:]), ["ok"] * 3),
    }
    for name, (data, want) in cases.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
        rows = list(warc.normalize_file(str(tmp_path / f"{name}.warc.gz"), str(tmp_path / "out"), name))
        assert want is None or [x["status"] for x in rows] == want, name
        for x in rows:
            if x["status"] == "ok":
                assert warc.read_record(x["warc_file"], x["offset"], x["length"]).startswith(b"WARC/1.0")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.normalize(warc.write_monolithic(none, f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


def test_warc_goes_on_after_a_bad_record(tmp_path):
    good = [b"".join((*warc.record(i, "u", "x" * 300), b"\r\n\r\n")) for i in range(3)]
    bad = {
        "superscript": good[1].replace(b"Content-Length: 300", "Content-Length: 30²".encode()), "none": good[1].replace(b"Content-Length", b"Content-Size"),
        "huge": good[1].replace(b"Content-Length: 300", b"Content-Length: " + b"9" * 5000), "junk": b"nothing of this kind\r\n" * 50_000, "version": good[1].replace(b"WARC/1.0", b"CRAW/1.0"),
    }
    for name, middle in bad.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(good[0] + middle + good[2]))
        rows = list(warc.normalize_file(str(tmp_path / f"{name}.warc.gz"), str(tmp_path / "out"), name))
        assert [(x["record_no"], x["status"]) for x in rows] == [(0, "ok"), (1, "malformed"), (2, "ok")], name
        assert [warc.read_record(x["warc_file"], x["offset"], x["length"]) for x in rows if x["status"] == "ok"] == [good[0], good[2]]


def test_warc_long_url(tmp_path):
    pages = [(1, "data:" + "x" * (2 << 20), "a"), (2, "u", "b"), (3, "v", "c")]
    data = b"".join(h + b + b"\r\n\r\n" for h, b in (warc.record(*p) for p in pages))
    for name, tail in (("whole", b""), ("junk", b"WARC/" + b"x" * (2 << 20))):
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(data + tail))
        rows = list(warc.normalize_file(str(tmp_path / f"{name}.warc.gz"), str(tmp_path / "out"), name))
        assert [x["status"] for x in rows] == ["ok"] * 3 + ["malformed"] * bool(tail)
        assert [x["target_uri"] for x in rows[:3]] == [u for _, u, _ in pages]


# ---- the pipeline -------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, data):
    """Each stage's decisions, found again from its own input."""
    docs = table(spark, data, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "bpe"]
    good = {x.doc_id for x in quality.quality_scores(docs, table(spark, data, "labels")).where("p_quality >= 0.5").select("doc_id").collect()}
    texts = {x.doc_id: x.text for x in docs.collect() if x.doc_id in good}
    classes = brute_links(list(texts.items()), ngram_join.N, ngram_join.THRESHOLD)[1]
    kept = {i: texts[i] for i, first, _ in classes if i == first}
    assert 0 < len(kept) < len(texts)
    tagger = secret_scan.Tagger(secret_scan.train())
    masked = {i: secret_scan.redact(t, tagger.secrets(t)) for i, t in kept.items()}
    source = {x.doc_id: x.source for x in docs.collect()}
    sizes = Counter()
    for i, t in masked.items():
        sizes[source[i]] += len(t)
    weight = {s: n**mixing.ALPHA for s, n in sizes.items()}
    want = Counter()
    import hashlib

    for i in masked:
        s = source[i]
        rate = weight[s] / sum(weight.values()) * sum(sizes.values()) / sizes[s]
        u = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        if k:
            want[i] = k
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens"]
    rows = out.collect()
    assert Counter(x.doc_id for x in rows) == want
    model = bpe.load()
    assert all(model.decode(x.ids) == masked[x.doc_id] for x in rows)


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
