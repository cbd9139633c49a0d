"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Document evidence is a log likelihood ratio of bucketed shape features (capitals,
symbols, adjacent repeats, distinct words by length), whose counts come from one
grouped aggregation over all labelled documents. The posterior of every document
is then averaged by host (``source``) and by path (``source`` and ``lang``). Sparse
sites shrink towards their parent: a path towards its host, a host towards the
global rate, with prior strengths found by the method of moments. The decision on
a document adds its own evidence to the posterior of its path without it.

Defined results
---------------
* NULL or empty text: no words; it has the evidence of its buckets like any other
  document. NULL source or lang: a site of its own.
* Labels without doc_id or quality are left out; several labels of one doc_id count
  as their mean, rounded up from one half. Without any labels all evidence is 0 and
  every document is kept.
* Repeated rows are judged (and counted) each. Empty table: no rows. Other columns may
  have any name.
* Evidence is clipped to 12 nats either way, prior strengths to 1..1000 documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import column, materialize, table, without

FEATURES, BUCKETS, SMOOTH, CLIP, KEEP = 4, 128, 0.5, 12.0, 0.5
_UP = "[A-ZÀ-ÖØ-Þ]"
_SYM = "[^\\p{L}\\p{N} \\t\\n\\r.,;:'\"()?-]"
_GAP = "[ \\t\\n\\r]+"


def with_buckets(docs: DataFrame) -> DataFrame:
    """Adds the buckets ``__b0``..``__b3``, integers from 0 to 127, all in built-in expressions.

    ``docs`` has ``text`` and otherwise only columns whose names we chose ourselves.
    """
    t = F.coalesce("text", F.lit(""))
    base = docs.select("*", t.alias("__t"), F.filter(F.split(t, _GAP), lambda w: w != "").alias("__w"))
    n = F.greatest(F.size("__w"), F.lit(1)).cast("double")
    base = base.select(
        "*",
        (F.regexp_count("__t", F.lit(_UP)) / F.greatest(F.length("__t"), F.lit(1)).cast("double")).alias("__f0"),
        (F.regexp_count("__t", F.lit(_SYM)) / n).alias("__f1"),
        (F.size(F.expr("filter(__w, (x, i) -> i > 0 AND x = __w[i - 1])")) / n).alias("__f2"),
        (F.size(F.array_distinct("__w")) / n).alias("__f3"),
        F.least(F.floor(F.log2(n)), F.lit(11)).cast("int").alias("__f4"),
    )
    return base.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.least(F.floor(F.col("__f0") * 20), F.lit(19)).cast("int").alias("__b0"),
        F.least(F.floor(F.col("__f1") * 20), F.lit(19)).cast("int").alias("__b1"),
        F.least(F.floor(F.col("__f2") * 20), F.lit(19)).cast("int").alias("__b2"),
        (F.col("__f4") * 10 + F.least(F.floor(F.col("__f3") * 10), F.lit(9)).cast("int")).alias("__b3"),
    )


def train(features: DataFrame, labels: DataFrame) -> list[list[float]]:
    """Log likelihood ratios by feature and bucket, from all labelled documents.

    The grouped counts are at most FEATURES * BUCKETS rows, whatever the input.
    """
    label = (
        labels.select(column(labels, "doc_id", "bigint").alias("__l"), column(labels, "quality", "double").alias("__q"))
        .where("__l IS NOT NULL AND __q IS NOT NULL")
        .groupBy("__l").agg((F.avg("__q") >= 0.5).cast("int").alias("__good"))
    )
    joined = features.join(label, features["__id"] == label["__l"])
    long = joined.select("__good", F.expr("stack(4, 0, __b0, 1, __b1, 2, __b2, 3, __b3) AS (f, b)"))
    counts = long.groupBy("f", "b").agg(F.sum("__good").alias("good"), F.sum(1 - F.col("__good")).alias("bad")).collect()
    out = [[0.0] * BUCKETS for _ in range(FEATURES)]
    goods, bads = sum(r.good for r in counts if r.f == 0), sum(r.bad for r in counts if r.f == 0)
    if not goods or not bads:
        return out
    found = {(r.f, r.b): r for r in counts}
    for f in range(FEATURES):
        for b in range(BUCKETS):
            r = found.get((f, b))
            g, x = (r.good, r.bad) if r else (0, 0)
            if g + x:
                out[f][b] = math.log((g + SMOOTH) / (goods + SMOOTH * BUCKETS)) - math.log((x + SMOOTH) / (bads + SMOOTH * BUCKETS))
    return out


def evidence(model: list[list[float]]) -> Column:
    """The clipped sum of the four ratios; each is a constant-time array lookup."""
    total = sum((F.element_at(F.array(*[F.lit(v) for v in row]), F.col(f"__b{f}") + 1) for f, row in enumerate(model)), F.lit(0.0))
    return F.greatest(F.least(total, F.lit(CLIP)), F.lit(-CLIP))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(source, lang, n, s, m1, host_rate): what a document of a path is shrunk with.

    ``scored`` has source, lang and the document posterior p (decimal, so that the
    sums don't depend on the order of the rows). One row a path.
    """
    paths = scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("p").cast("double").alias("s"))
    hosts = paths.groupBy(F.col("source").alias("hs")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hsum"))
    total = hosts.agg(F.sum("hn").alias("tn"), (F.sum("hsum") / F.sum("hn")).alias("g"), F.count("*").alias("th"))

    def strength(var: str, units: str) -> Column:
        spread = F.col(var) / F.col("tn") - F.col("g") * (1 - F.col("g")) * F.col(units) / F.col("tn")
        return F.least(F.greatest(F.col("g") * (1 - F.col("g")) / F.greatest(spread, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1000.0))

    between = hosts.crossJoin(total).agg(F.sum(F.col("hn") * F.pow(F.col("hsum") / F.col("hn") - F.col("g"), F.lit(2.0))).alias("vh"))
    joined = paths.join(hosts, F.col("source").eqNullSafe(F.col("hs")))
    within = joined.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hsum") / F.col("hn"), F.lit(2.0))).alias("vp"), F.count("*").alias("tp"))
    prior = total.crossJoin(between).crossJoin(within).select("g", strength("vh", "th").alias("m0"), strength("vp", "tp").alias("m1"))
    return joined.crossJoin(prior).select(
        F.col("source").alias("__ps"), F.col("lang").alias("__pl"), "n", "s", "m1", "g",
        ((F.col("hsum") + F.col("m0") * F.col("g")) / (F.col("hn") + F.col("m0"))).alias("host_rate"),
    )


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[float]]]:
    plain = docs.select(column(docs, "doc_id", "bigint").alias("__id"), column(docs, "source", "string").alias("source"), column(docs, "lang", "string").alias("lang"), column(docs, "text", "string").alias("text"))
    features = materialize(with_buckets(plain).drop("text"), "quality-features")
    model = train(features, labels)
    p = F.round(1 / (1 + F.exp(-evidence(model))), 9).cast("decimal(18,9)")
    return features.select("source", "lang", evidence(model).alias("llr"), p.alias("p"), F.col("__id").alias("doc_id")), model


def _decided(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds p_site, the path's posterior without the row, and p_quality."""
    joined = rows.join(sites, F.col("__src").eqNullSafe(F.col("__ps")) & F.col("__lng").eqNullSafe(F.col("__pl")), "left")
    rest = F.greatest(F.col("s") - F.col("p_document").cast("double"), F.lit(0.0))
    site = F.least(F.greatest((rest + F.col("m1") * F.col("host_rate")) / (F.col("n") - 1 + F.col("m1")), F.lit(1e-6)), F.lit(1 - 1e-6))
    return joined.withColumn("p_site", site).withColumn("p_quality", 1 / (1 + F.exp(-(F.col("__llr") + _logit(F.col("p_site"))))))


def quality_filter(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents whose posterior of being good is at least ``keep``, columns unchanged.

    Features are computed once for the counts (kept without text) and once beside
    the text; the text itself is never shuffled unless the table of paths is too
    large to broadcast.
    """
    scored, model = _scored(docs, labels)
    sites = materialize(site_posteriors(scored), "quality-sites")
    # the columns of docs have other names meanwhile, so none can clash
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner, strict=True)],
        column(docs, "text", "string").alias("text"), column(docs, "source", "string").alias("__src"), column(docs, "lang", "string").alias("__lng"),
    )
    ready = with_buckets(plain).select(*inner, evidence(model).alias("__llr"), F.round(1 / (1 + F.exp(-evidence(model))), 9).cast("decimal(18,9)").alias("p_document"), "__src", "__lng")
    return _decided(ready, sites).where(F.col("p_quality") >= keep).select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner, strict=True)])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, lang, p_document, p_site, p_quality) of every document."""
    scored, _ = _scored(docs, labels)
    scored = materialize(scored, "quality-scores")
    sites = materialize(site_posteriors(scored), "quality-sites")
    rows = scored.select("doc_id", F.col("source").alias("__src"), F.col("lang").alias("__lng"), F.col("llr").alias("__llr"), F.col("p").alias("p_document"))
    out = _decided(rows, sites)
    return out.select("doc_id", F.col("__src").alias("source"), F.col("__lng").alias("lang"), F.col("p_document").cast("double").alias("p_document"), "p_site", "p_quality")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its posteriors and whether it is kept."""
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "source", "lang", *[F.round(c, 5).alias(c) for c in ("p_document", "p_site", "p_quality")], (F.col("p_quality") >= KEEP).alias("kept"))


def _sql_string(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = f"""
WITH words AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
raw AS (
  SELECT doc_id, source, lang, greatest(len(w), 1)::DOUBLE AS n,
    len(regexp_extract_all(t, '{_UP}')) / greatest(length(t), 1)::DOUBLE AS f0,
    len(regexp_extract_all(t, {_sql_string(_SYM)})) / greatest(len(w), 1)::DOUBLE AS f1,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) / greatest(len(w), 1)::DOUBLE AS f2,
    len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE AS f3 FROM words),
features AS (
  SELECT doc_id, source, lang, least(floor(f0 * 20), 19)::INT AS b0, least(floor(f1 * 20), 19)::INT AS b1,
    least(floor(f2 * 20), 19)::INT AS b2, least(floor(log2(n)), 11)::INT * 10 + least(floor(f3 * 10), 9)::INT AS b3 FROM raw),
good AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS y FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
long AS (SELECT y, u.f, u.b FROM features JOIN good USING (doc_id),
  unnest([{{'f': 0, 'b': b0}}, {{'f': 1, 'b': b1}}, {{'f': 2, 'b': b2}}, {{'f': 3, 'b': b3}}]) AS t(u)),
sizes AS (SELECT sum(y)::DOUBLE AS goods, sum(1 - y)::DOUBLE AS bads FROM long WHERE f = 0),
model AS (SELECT f, b, CASE WHEN any_value(goods) > 0 AND any_value(bads) > 0 THEN
    ln((sum(y) + {SMOOTH}::DOUBLE) / (any_value(goods) + {SMOOTH * BUCKETS}::DOUBLE)) - ln((sum(1 - y) + {SMOOTH}::DOUBLE) / (any_value(bads) + {SMOOTH * BUCKETS}::DOUBLE)) ELSE 0 END AS r
  FROM long, sizes GROUP BY f, b),
scored AS (
  SELECT doc_id, source, lang, greatest(least(coalesce(m0.r, 0) + coalesce(m1.r, 0) + coalesce(m2.r, 0) + coalesce(m3.r, 0), {CLIP}::DOUBLE), -{CLIP}::DOUBLE) AS llr
  FROM features LEFT JOIN model m0 ON m0.f = 0 AND m0.b = b0 LEFT JOIN model m1 ON m1.f = 1 AND m1.b = b1
  LEFT JOIN model m2 ON m2.f = 2 AND m2.b = b2 LEFT JOIN model m3 ON m3.f = 3 AND m3.b = b3),
docp AS (SELECT *, round(1 / (1 + exp(-llr)), 9)::DECIMAL(18, 9) AS p FROM scored),
paths AS (SELECT source, lang, count(*) AS n, sum(p)::DOUBLE AS s FROM docp GROUP BY source, lang),
hosts AS (SELECT source, sum(n)::DOUBLE AS hn, sum(s) AS hsum FROM paths GROUP BY source),
total AS (SELECT sum(hn) AS tn, sum(hsum) / sum(hn) AS g, count(*)::DOUBLE AS th FROM hosts),
vh AS (SELECT sum(hn * pow(hsum / hn - g, 2)) AS vh FROM hosts, total),
vp AS (SELECT sum(n * pow(s / n - hsum / hn, 2)) AS vp, count(*)::DOUBLE AS tp FROM paths JOIN hosts ON paths.source IS NOT DISTINCT FROM hosts.source),
prior AS (SELECT g,
    least(greatest(g * (1 - g) / greatest(vh / tn - g * (1 - g) * th / tn, 1e-6::DOUBLE) - 1, 1.0::DOUBLE), 1000.0::DOUBLE) AS m0,
    least(greatest(g * (1 - g) / greatest(vp / tn - g * (1 - g) * tp / tn, 1e-6::DOUBLE) - 1, 1.0::DOUBLE), 1000.0::DOUBLE) AS m1
  FROM total, vh, vp),
sites AS (SELECT paths.source, lang, n, s, m1, (hsum + m0 * g) / (hn + m0) AS host_rate
  FROM paths JOIN hosts ON paths.source IS NOT DISTINCT FROM hosts.source, prior),
placed AS (SELECT doc_id, d.source, d.lang, llr, p::DOUBLE AS p_document,
    least(greatest((greatest(s - p::DOUBLE, 0.0::DOUBLE) + m1 * host_rate) / (n - 1 + m1), 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS p_site
  FROM docp d JOIN sites ON d.source IS NOT DISTINCT FROM sites.source AND d.lang IS NOT DISTINCT FROM sites.lang)
SELECT * FROM (SELECT doc_id, source, lang, round(p_document, 5) AS p_document, round(p_site, 5) AS p_site,
  round(1 / (1 + exp(-(llr + ln(p_site) - ln(1 - p_site)))), 5) AS p_quality,
  1 / (1 + exp(-(llr + ln(p_site) - ln(1 - p_site)))) >= {KEEP}::DOUBLE AS kept FROM placed)
"""

QUERIES = {"op7_quality": op7_quality}
ORACLES = {"op7_quality": ORACLE}
