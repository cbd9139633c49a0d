"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate ``weight * total / size``. A document's
number of copies is a Poisson variate of that mean, found by inverting the
distribution at a uniform number that is hashed from the document and a seed, so
the draw is the same on every run, partitioning and retry. Copies are exploded
and shuffled globally: a hash of (seed, document, copy) picks the partition and
the place in it.

Defined results
---------------
* NULL source: a source of its own. NULL or empty text: size 0; such documents
  are replicated at their source's rate. A source whose size is 0: rate 1.
* NULL doc_id: the draw is hashed from the text instead.
* Repeated rows: each is replicated; equal rows draw equal counts.
* Empty table: no rows. Columns named ``mix_copy`` or ``mix_key`` are replaced; any
  other column is carried along, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import column, materialize, table, without

#: Temperature: the target weight of a source is proportional to size ** ALPHA.
ALPHA = 0.5
SEED = "mix-1"


def _uniform(key: Column, seed: str) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat(F.lit(seed + "|"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, alpha: float = ALPHA, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """(source, rate, cdf): the mean repetition of each source and its Poisson CDF.

    ``weights`` (source, weight) overrides the temperature weights; sources it
    lacks get 0. ``total`` is the size of the mixture in characters (default: the
    size of the corpus). One row a source; nothing is collected.
    """
    sizes = docs.groupBy(column(docs, "source", "string").alias("source")).agg(
        F.coalesce(F.sum(F.length(column(docs, "text", "string"))), F.lit(0)).cast("bigint").alias("size")
    )
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        given = weights.select(F.col("source").cast("string").alias("ws"), F.col("weight").cast("double").alias("w"))
        weighted = sizes.join(given, sizes.source.eqNullSafe(given.ws), "left").drop("ws").fillna(0.0, ["w"])
    sums = weighted.agg(F.sum("w").alias("sw"), F.sum("size").alias("st"))
    size_all = F.col("st").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("size") > 0, F.col("w") / F.col("sw") * size_all / F.col("size")).otherwise(F.lit(1.0))
    rated = weighted.crossJoin(sums).select("source", rate.alias("rate"))
    top = "cast(ceil(rate + 12 * sqrt(rate) + 30) as int)"
    cdf = F.expr(
        f"""CASE WHEN rate > 0 THEN aggregate(sequence(1, {top}),
              named_struct('lp', -rate, 'c', array(exp(-rate))),
              (s, k) -> named_struct('lp', s.lp + ln(rate) - ln(cast(k as double)),
                'c', array_append(s.c, element_at(s.c, -1) + exp(s.lp + ln(rate) - ln(cast(k as double))))),
              s -> s.c) ELSE array(1D) END"""
    )
    return rated.withColumn("cdf", cdf)


def poisson_mix(docs: DataFrame, alpha: float = ALPHA, weights: DataFrame | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled globally.

    Adds ``mix_copy`` (from 0) and ``mix_key`` (the place in the shuffle, a hash).
    One scan for the sizes, one for the rows, one shuffle of the copies.
    """
    rates = materialize(source_rates(docs, alpha, weights, total), "mix-rates")
    base = without(docs, "mix_copy", "mix_key")
    names = base.columns
    ident = F.coalesce(column(docs, "doc_id", "string"), F.concat(F.lit("t:"), F.md5(F.coalesce(column(docs, "text", "string"), F.lit("")))))
    # the columns of docs have other names meanwhile, so none can clash
    inner = [f"c{i}" for i in range(len(names))]
    left = base.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], ident.alias("__id"), column(docs, "source", "string").alias("__src"))
    right = rates.select(F.col("source").alias("__rs"), F.col("cdf").alias("__cdf"))
    joined = left.join(right, left["__src"].eqNullSafe(right["__rs"]), "inner").withColumn("__u", _uniform(F.col("__id"), seed))
    counted = joined.withColumn("__n", F.expr("size(filter(__cdf, c -> c <= __u))")).where("__n > 0")
    copies = counted.select(*inner, "__id", F.explode(F.expr("sequence(0, __n - 1)")).alias("mix_copy"))
    place = F.concat(F.lit(seed + "|s|"), F.col("__id"), F.lit("|"), F.col("mix_copy").cast("string"))
    keyed = copies.withColumn("mix_key", F.conv(F.substring(F.md5(place), 1, 15), 16, 10).cast("bigint"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key").select(*[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)], "mix_copy", "mix_key")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(CAST(size AS DOUBLE), {ALPHA}::DOUBLE) AS w FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0
    THEN w / (SELECT sum(w) FROM weighted) * (SELECT CAST(sum(size) AS DOUBLE) FROM weighted) / size ELSE 1.0 END AS rate
  FROM weighted),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln(CAST(k + 1 AS DOUBLE)), c + exp(lp + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
  FROM cdf WHERE k < CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT)),
drawn AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 't:' || md5(coalesce(text, ''))) AS ident FROM documents),
counted AS (
  SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source
     AND cdf.c <= CAST(('0x' || substr(md5('{SEED}|' || d.ident), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0) AS n
  FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS mix_copy,
  CAST(('0x' || substr(md5('{SEED}|s|' || ident || '|' || CAST(copy AS VARCHAR)), 1, 15)) AS BIGINT) AS mix_key
FROM counted, unnest(range(n)) AS t(copy)
"""

QUERIES = {"op9_poisson_mix": op9_poisson_mix}
ORACLES = {"op9_poisson_mix": ORACLE}
