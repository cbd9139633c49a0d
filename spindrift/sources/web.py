"""The web as tables: pages, their links and items, and a page store to fetch from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import urls

HREF = 'href="([^"]*)"'
TITLE = "<title>([^<]*)</title>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, start_urls: list[str]) -> DataFrame:
    """(seq, url) of the start URLs, in their order."""
    return spark.createDataFrame(list(enumerate(start_urls)), "seq bigint, url string")


def start_requests(seed_urls: DataFrame, strict: bool = True) -> DataFrame:
    """Seeds without fragments. ``strict``: one URL that doesn't parse fails them all
    (an error when the rows are computed); otherwise such seeds are left out."""
    ok = urls.is_url(F.col("url"))
    if not strict:
        return seed_urls.where(ok).withColumn("url", urls.canonical(F.col("url")))
    checked = F.when(ok, urls.canonical(F.col("url"))).otherwise(F.raise_error(F.concat(F.lit("not a URL: "), F.coalesce("url", F.lit("NULL")))))
    return seed_urls.withColumn("url", checked)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): every link of every page, in the order of the page."""
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the item that a page yields."""
    return pages.select("page_id", F.regexp_extract("html", TITLE, 1).alias("title"))


def synthetic_target(href: Column, count: Column) -> Column:
    """A page id for a link: the test pages' links name no page, so a hash picks one."""
    return (F.conv(F.substring(F.md5(href), 1, 8), 16, 10).cast("bigint") % count).cast("bigint")


def edges(pages: DataFrame) -> DataFrame:
    """(src, pos, href, dst) by the synthetic resolver; the page count is a scalar subquery."""
    count = pages.agg(F.count("*").alias("n"))
    return links(pages).crossJoin(F.broadcast(count)).select(F.col("page_id").alias("src"), "pos", "href", synthetic_target(F.col("href"), F.col("n")).alias("dst"))


def fetch(requests: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Requests with the page stored for them: status 200 and body, or NULL if there is none."""
    store = pages.select(F.col(key).alias("__k"), F.col("url").alias("response_url"), F.col("html").alias("body"))
    joined = requests.join(store, requests[key] == store["__k"], "left")
    return joined.withColumn("status", F.when(F.col("__k").isNotNull(), F.lit(200))).drop("__k")
