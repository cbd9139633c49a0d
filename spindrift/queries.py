"""Registered queries over the test tables, and SQL that gives the same rows.

The pages table is the web and the events table stands for a crawl log
(:func:`spindrift.operators.eventlog.from_events`). Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import formats, urls
from spindrift.operators import chains, eventlog, folds, frontier
from spindrift.operators.chains import Pipeline, Step
from spindrift.plans import crawl, report
from spindrift.scratch import scratch_path
from spindrift.sources import snapshots, web
from spindrift.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_EDGES = """RECURSIVE np AS (SELECT count(*) AS n FROM pages),
hrefs AS (SELECT page_id AS src, u.i AS pos, u.h AS href FROM (
  SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages) p, unnest(list_transform(hs, lambda h, i: {'h': h, 'i': i - 1})) AS t(u)),
edges AS (SELECT src, pos, href, CAST(('0x' || substr(md5(href), 1, 8))::BIGINT % (SELECT n FROM np) AS BIGINT) AS dst FROM hrefs)"""
_BFS = _EDGES + """,
walk AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 12),
bfs AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""
_LOG = """k AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
log AS (SELECT event_id AS seq, ts, CASE WHEN event_type = 'view' AND k % 10 = 9 THEN 'early_response' WHEN event_type = 'view' THEN 'fetch_ok'
    WHEN event_type = 'error' AND k % 3 = 0 THEN 'retry' WHEN event_type = 'error' THEN 'fetch_failed'
    WHEN event_type = 'click' AND k % 7 = 0 THEN 'drop' WHEN event_type = 'click' THEN 'enqueue_ok'
    WHEN event_type = 'signup' THEN 'parse_ok' WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'item_dropped' ELSE 'item_ok' END AS event,
  'user-' || user_id AS host, 'user-' || user_id || '/' || k AS url,
  CASE WHEN k % 5 = 0 THEN 500 WHEN k % 5 = 1 THEN 404 WHEN k % 5 = 2 THEN 301 ELSE 200 END AS status, k * 100 AS bytes,
  CAST(floor(value * 1000000) AS BIGINT) AS duration_ns, k % 10 = 0 AS cached FROM k)"""
_HANDLED = "('fetch_ok', 'early_response', 'fetch_failed', 'retry', 'drop')"
_CANON = "regexp_replace(url, '#.*$', '')"
_HOST = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), 'unknown')"


def register(sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return web.read(spark, d, "pages")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.from_events(web.read(spark, d, "events"))


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return crawl.bfs(web.edges(_pages(spark, d)), spark.createDataFrame([(0,)], "id bigint"))


# ---- fixpoint ---------------------------------------------------------------------------


@register(f"WITH {_BFS} SELECT depth, count(*) AS new_pages FROM bfs GROUP BY depth")
def crawl_bfs_depth_counts(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d).groupBy("depth").agg(F.count("*").alias("new_pages"))


@register(f"WITH {_BFS} SELECT id AS page_id, depth FROM bfs")
def crawl_visited_pages(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d).select(F.col("id").alias("page_id"), "depth")



_SEEN = "s AS (SELECT id, page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM walked JOIN pages ON page_id = id)"
_ALLOWED = _EDGES + """,
walk AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 12 AND w.id % 7 <> 3),
walked AS (SELECT id, min(depth) AS depth FROM walk WHERE id % 7 <> 3 GROUP BY id),
refused AS (SELECT DISTINCT id FROM walk WHERE id % 7 = 3)"""


def _managed(spark: SparkSession, d: str) -> crawl.CrawlResult:
    """A crawl with a middleware that refuses some pages, and a pipeline."""
    step = Step("skip", [(F.col("id") % 7 == 3, "drop")])
    plan = crawl.page_crawl(_pages(spark, d)).add_middleware(step).add_pipeline(Pipeline("odd", F.col("page_id") % 5 != 3, state=F.count("*"))).build()
    return plan.run(spark, spark.createDataFrame([(0,)], "id bigint"))


@register(f"""WITH {_ALLOWED}, {_SEEN}, offers AS (SELECT 1 + count(*) AS n FROM edges JOIN walked ON src = id), t AS (SELECT count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS b FROM s),
lost AS (SELECT count(DISTINCT (id, w.depth)) AS n FROM (SELECT e.dst AS id, v.depth + 1 AS depth FROM walked v JOIN edges e ON e.src = v.id WHERE e.dst % 7 = 3) w)
SELECT offers.n AS requests_enqueued, t.n AS requests_sent, t.n AS requests_succeeded, 0::BIGINT AS requests_failed, 0::BIGINT AS requests_retried, lost.n AS requests_dropped, t.n AS responses_received,
  t.n AS items_scraped, (SELECT count(*) FROM s WHERE id % 5 <> 3) AS items_processed, (SELECT count(*) FROM s WHERE id % 5 = 3) AS items_dropped_by_pipeline, 0::BIGINT AS responses_from_cache, b AS total_bytes_downloaded
FROM offers, t, lost""")
def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    """All counters over the log of a whole crawl with middleware and pipeline."""
    return eventlog.counters(_managed(spark, d).log)


@register(f"WITH {_ALLOWED} SELECT id AS page_id, 1::BIGINT AS fetches FROM walked")
def crawl_fetch_once(spark: SparkSession, d: str) -> DataFrame:
    """How often the log has each page downloaded."""
    return _managed(spark, d).log.where("event = 'fetch_ok'").groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("fetches"))


@register(f"WITH {_ALLOWED}, {_SEEN} SELECT 'odd' AS pipeline, count(*) AS seen FROM s")
def crawl_pipeline_state(spark: SparkSession, d: str) -> DataFrame:
    states = _managed(spark, d).states
    return spark.createDataFrame([(n, x["state"]) for n, x in states.items()], "pipeline string, seen bigint")


@register(f"""WITH {_BFS}, visited AS (SELECT * FROM bfs),
sent AS (SELECT count(*) AS n FROM visited)
SELECT 'fetch_ok' AS event, n FROM sent UNION ALL SELECT 'parse_ok', n FROM sent
UNION ALL SELECT 'item_ok', n FROM sent
UNION ALL SELECT 'enqueue_ok', 1 + (SELECT count(*) FROM edges JOIN visited ON src = id)""")
def crawl_log_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of effects of a whole crawl, its items' too; duplicate offers count as enqueued."""
    result = crawl.page_crawl(_pages(spark, d)).build().run(spark, spark.createDataFrame([(0,)], "id bigint"))
    return result.log.groupBy("event").agg(F.count("*").alias("n"))


@register(f"WITH {_BFS} SELECT id AS page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN id % 5 = 3 THEN 'odd' END AS dropped_by FROM bfs JOIN pages ON page_id = id")
def crawl_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of a crawl after its pipeline."""
    plan = crawl.page_crawl(_pages(spark, d)).add_pipeline(Pipeline("odd", F.col("page_id") % 5 != 3)).build()
    return plan.run(spark, spark.createDataFrame([(0,)], "id bigint")).items.select("page_id", "title", "dropped_by")


@register(f"WITH {_BFS} SELECT id AS page_id, depth FROM bfs")
def resume_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds, a snapshot, and the rest of the crawl from it: as if never interrupted."""
    where = scratch_path(spark, "resume")
    seeds = spark.createDataFrame([(0,)], "id bigint")
    pages = _pages(spark, d)
    crawl.page_crawl(pages).with_checkpoint_path(where).max_rounds(2).build().run(spark, seeds)
    result = crawl.page_crawl(pages).with_checkpoint_path(where).build().run(spark, seeds, resume=True)
    return result.visited.select(F.col("id").alias("page_id"), "depth")


@register(f"WITH {_BFS} SELECT 'visited' AS part, id FROM bfs UNION ALL SELECT 'links', dst FROM edges")
def checkpoint_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    where = scratch_path(spark, "snapshot")
    edges = web.edges(_pages(spark, d))
    snapshots.save(spark, where, {"visited": _walk(spark, d).select("id"), "links": edges.select(F.col("dst").alias("id"))}, 1)
    found = snapshots.load(spark, where)
    return found["visited"].select(F.lit("visited").alias("part"), "id").unionByName(found["links"].select(F.lit("links").alias("part"), "id"))


# ---- frontier ---------------------------------------------------------------------------

_OFFERED = _EDGES + """,
pf AS (SELECT page_id, sha256(""" + _CANON + """) AS fingerprint, url FROM pages),
offered AS (SELECT src, pos, dst, fingerprint FROM edges JOIN pf ON page_id = dst),
visited AS (SELECT fingerprint FROM pf WHERE url LIKE 'https://%')"""


def _offered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All links as offered requests, and the pages with https as visited."""
    pages = _pages(spark, d).select("page_id", "url", urls.fingerprint(F.col("url")).alias("fingerprint"))
    edges = web.edges(_pages(spark, d)).select("src", "pos", "dst")
    offered = edges.join(pages.select(F.col("page_id").alias("dst"), "fingerprint"), "dst")
    return offered, pages.where(F.col("url").startswith("https://")).select("fingerprint")


@register(f"WITH {_OFFERED} SELECT src, pos, dst, fingerprint FROM offered o WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.fingerprint = o.fingerprint)")
def frontier_admitted(spark: SparkSession, d: str) -> DataFrame:
    return frontier.admit(*_offered(spark, d)).select("src", "pos", "dst", "fingerprint")


@register(f"WITH {_OFFERED} SELECT DISTINCT fingerprint FROM offered o WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.fingerprint = o.fingerprint)")
def frontier_admitted_strict(spark: SparkSession, d: str) -> DataFrame:
    return frontier.admit(*_offered(spark, d), strict=True).select("fingerprint")


@register(f"WITH {_OFFERED} SELECT src, pos, dst, fingerprint FROM offered o WHERE EXISTS (SELECT 1 FROM visited v WHERE v.fingerprint = o.fingerprint)")
def frontier_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return frontier.duplicates(*_offered(spark, d)).select("src", "pos", "dst", "fingerprint")


@register(f"WITH {_EDGES} SELECT src, pos, dst, CASE WHEN row_number() OVER (ORDER BY src, pos) <= 480 THEN 'admitted' ELSE 'rejected_capacity' END AS outcome FROM edges")
def frontier_capped(spark: SparkSession, d: str) -> DataFrame:
    """A capacity of 500 with 20 pending."""
    admitted, rejected = frontier.cap(web.edges(_pages(spark, d)).select("src", "pos", "dst"), ["src", "pos"], 500 - 20)
    return admitted.withColumn("outcome", F.lit("admitted")).unionByName(rejected.withColumn("outcome", F.lit("rejected_capacity")))


@register(f"WITH {_OFFERED} SELECT fingerprint FROM visited UNION SELECT fingerprint FROM offered")
def visited_marked(spark: SparkSession, d: str) -> DataFrame:
    offered, visited = _offered(spark, d)
    return frontier.mark_visited(visited, offered)


@register(f"WITH {_OFFERED} SELECT src, dst FROM offered WHERE src % 2 = 0 UNION ALL SELECT src, dst FROM offered WHERE src % 2 = 1")
def frontier_salvage(spark: SparkSession, d: str) -> DataFrame:
    offered, _ = _offered(spark, d)
    offered = offered.select("src", "dst")
    return frontier.salvage(offered.where("src % 2 = 0"), offered.where("src % 2 = 1"))


@register("SELECT user_id, max(ts) AS last_access FROM events GROUP BY user_id ORDER BY last_access DESC, user_id DESC LIMIT 50")
def visited_lru_topn(spark: SparkSession, d: str) -> DataFrame:
    return frontier.lru(web.read(spark, d, "events"), "user_id", "ts", 50)


@register("SELECT user_id, max(ts) AS last_access FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS")
def visited_idle_ttl(spark: SparkSession, d: str) -> DataFrame:
    return frontier.idle_ttl(web.read(spark, d, "events"), "user_id", "ts", 86_400)


# ---- URLs, seeds, parsing -----------------------------------------------------------------


@register(f"SELECT page_id, {_CANON} AS canonical FROM pages")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@register(f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))


@register(f"SELECT page_id, sha256({_CANON}) AS fingerprint FROM pages")
def url_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.fingerprint(F.col("url")).alias("fingerprint"))


@register("""WITH s AS (SELECT url FROM pages UNION ALL SELECT substr(url, 9) FROM pages),
v AS (SELECT coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]'), false) AS ok FROM s)
SELECT count(*) AS seeds, count(*) FILTER (NOT ok) AS bad, CASE WHEN bool_and(ok) THEN count(*) ELSE 0 END AS accepted_strict, count(*) FILTER (ok) AS accepted_lenient FROM v""")
def seed_validation(spark: SparkSession, d: str) -> DataFrame:
    """All page URLs, and each without its first 8 characters, as seeds: one bad seed fails
    them all, or only itself."""
    pages = _pages(spark, d)
    found = pages.select("url").unionByName(pages.select(F.expr("substring(url, 9)").alias("url"))).select(urls.is_url(F.col("url")).alias("ok"))
    return found.agg(F.count("*").alias("seeds"), F.count_if(~F.col("ok")).alias("bad"), F.when(F.bool_and("ok"), F.count("*")).otherwise(0).alias("accepted_strict"), F.count_if("ok").alias("accepted_lenient"))


@register(f"SELECT page_id AS seq, {_CANON} AS url FROM pages")
def seed_requests(spark: SparkSession, d: str) -> DataFrame:
    return web.start_requests(_pages(spark, d).select(F.col("page_id").alias("seq"), "url"))


@register(f"WITH {_EDGES} SELECT src AS page_id, pos, href FROM edges")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return web.links(_pages(spark, d))


@register("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return web.titles(_pages(spark, d))


@register(f"WITH {_EDGES} SELECT (SELECT count(*) FROM pages) AS items_scraped, (SELECT count(*) FROM pages WHERE html LIKE '%<title>%') AS items_emitted, (SELECT count(*) FROM edges) AS requests_enqueued, (SELECT count(DISTINCT dst) FROM edges) AS requests_admitted")
def parse_output_counts(spark: SparkSession, d: str) -> DataFrame:
    """items_scraped counts parse outputs, requests_enqueued offers; the others count items
    and distinct targets."""
    pages = _pages(spark, d)
    outputs = pages.agg(F.count("*").alias("items_scraped"), F.count_if(F.contains("html", F.lit("<title>"))).alias("items_emitted"))
    return outputs.crossJoin(web.edges(pages).agg(F.count("*").alias("requests_enqueued"), F.count_distinct("dst").alias("requests_admitted")))


# ---- chains -------------------------------------------------------------------------------


def _steps() -> list[Step]:
    return [
        Step("limit", [(F.col("page_id") % 7 == 3, "retry")], delay_ms=2500),
        Step("robots", [(F.col("host").endswith(".org"), "drop"), (F.col("page_id") % 11 == 4, "error")]),
        Step("cache", [(F.contains("url", F.lit("?")), "return")]),
    ]


_ACT = {
    "limit": "CASE WHEN page_id % 7 = 3 THEN 'retry' ELSE 'continue' END",
    "robots": "CASE WHEN host LIKE '%.org' THEN 'drop' WHEN page_id % 11 = 4 THEN 'error' ELSE 'continue' END",
    "cache": "CASE WHEN contains(url, '?') THEN 'return' ELSE 'continue' END",
}


def _chain_sql(order: list[str]) -> str:
    acts = ", ".join(f"{_ACT[n]} AS a{i}" for i, n in enumerate(order))
    pick = lambda f, last: "CASE " + " ".join(f"WHEN a{i} <> 'continue' THEN {f(i)}" for i in range(len(order))) + f" ELSE {last} END"
    action, by = pick(lambda i: f"a{i}", "'continue'"), pick(lambda i: f"'{order[i]}'", "NULL")
    trace = pick(lambda i: "'" + ",".join(order[: i + 1]) + "'", "'" + ",".join(order) + "'")
    delay = pick(lambda i: f"CASE WHEN a{i} = 'retry' THEN {2500 if order[i] == 'limit' else 0} ELSE 0 END", "0")
    return f"p AS (SELECT page_id, url, {_HOST} AS host FROM pages), a AS (SELECT page_id, {acts} FROM p), c AS (SELECT page_id, {action} AS action, {by} AS decided_by, CAST({delay} AS BIGINT) AS delay_ms, {trace} AS trace FROM a)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", "url", urls.host(F.col("url")).alias("host"))


@register("WITH " + _chain_sql(["limit", "robots", "cache"]) + " SELECT * FROM c")
def request_chain_actions(spark: SparkSession, d: str) -> DataFrame:
    return chains.run_chain(_requests(spark, d), _steps()).select("page_id", "action", "decided_by", "delay_ms", "trace")


@register("WITH " + _chain_sql(["cache", "robots", "limit"]) + " SELECT * FROM c")
def response_chain_actions(spark: SparkSession, d: str) -> DataFrame:
    return chains.run_chain(_requests(spark, d), _steps(), reverse=True).select("page_id", "action", "decided_by", "delay_ms", "trace")


@register("WITH " + _chain_sql(["limit", "robots", "cache"]) + " SELECT page_id, CAST(4 + greatest(ceil(delay_ms / 1000.0), 1) AS BIGINT) AS not_before_round FROM c WHERE action = 'retry'")
def retry_requeue(spark: SparkSession, d: str) -> DataFrame:
    """Retries of round 4, with rounds of a second."""
    decided = chains.run_chain(_requests(spark, d), _steps()).withColumn("round", F.lit(4))
    return chains.requeue(decided, 1000).select("page_id", "not_before_round")


@register(f"WITH {_EDGES}, r AS (SELECT src, pos, CAST(('0x' || substr(md5(href), 1, 8))::BIGINT % ((SELECT n FROM np) * 5 // 4) AS BIGINT) AS page_id FROM hrefs) SELECT src, pos, r.page_id, CASE WHEN p.page_id IS NULL THEN 'failed' ELSE 'succeeded' END AS outcome, octet_length(encode(p.html)) AS bytes, CASE WHEN p.page_id IS NOT NULL THEN 200 END AS status FROM r LEFT JOIN pages p ON p.page_id = r.page_id")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Links resolved to a quarter more pages than there are; those without a page fail."""
    pages = _pages(spark, d)
    count = pages.agg(F.expr("count(*) * 5 div 4").alias("n"))
    requests = web.links(pages).crossJoin(F.broadcast(count)).select(F.col("page_id").alias("src"), "pos", web.synthetic_target(F.col("href"), F.col("n")).alias("page_id"))
    sizes = pages.select("page_id", "url", F.col("html"))
    fetched = web.fetch(requests, sizes)
    return fetched.select("src", "pos", "page_id", F.when(F.col("status").isNull(), "failed").otherwise("succeeded").alias("outcome"), F.octet_length("body").cast("bigint").alias("bytes"), "status")


def _pipelines() -> list[Pipeline]:
    return [Pipeline("length", F.length("title") >= 20), Pipeline("strict", F.col("page_id") % 9 != 2, fails=F.col("page_id") % 10 == 7), Pipeline("accent", ~F.contains("title", F.lit("ñ")))]


_ITEMS = """i AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
x AS (SELECT page_id, title, CASE WHEN NOT length(title) >= 20 THEN 'length' WHEN page_id % 10 = 7 OR page_id % 9 = 2 THEN 'strict' WHEN contains(title, 'ñ') THEN 'accent' END AS dropped_by,
  CASE WHEN NOT length(title) >= 20 THEN 'none' WHEN page_id % 10 = 7 THEN 'error' WHEN page_id % 9 = 2 THEN 'none' WHEN contains(title, 'ñ') THEN 'none' END AS drop_kind FROM i)"""


@register(f"WITH {_ITEMS} SELECT page_id, title FROM x WHERE dropped_by IS NULL")
def item_pipeline_survivors(spark: SparkSession, d: str) -> DataFrame:
    return chains.run_items(web.titles(_pages(spark, d)), _pipelines()).where("dropped_by IS NULL").select("page_id", "title")


@register(f"WITH {_ITEMS} SELECT dropped_by, drop_kind, count(*) AS n FROM x WHERE dropped_by IS NOT NULL GROUP BY ALL")
def item_pipeline_drops(spark: SparkSession, d: str) -> DataFrame:
    return chains.run_items(web.titles(_pages(spark, d)), _pipelines()).where("dropped_by IS NOT NULL").groupBy("dropped_by", "drop_kind").agg(F.count("*").alias("n"))


@register(f"WITH {_ITEMS} SELECT pipeline, count(*) AS n, CAST(sum(length(title) * 1000) AS BIGINT) AS total_ns FROM (SELECT title, unnest(CASE dropped_by WHEN 'length' THEN ['length'] WHEN 'strict' THEN ['length', 'strict'] ELSE ['length', 'strict', 'accent'] END) AS pipeline FROM x) GROUP BY pipeline")
def pipeline_timing(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline takes a microsecond a character of each item it sees."""
    done = chains.run_items(web.titles(_pages(spark, d)), _pipelines())
    return eventlog.pipeline_times(chains.reached(done, _pipelines()).withColumn("duration_ns", F.length("title") * 1000))


# ---- counters and times -------------------------------------------------------------------

_COUNTERS_SQL = ", ".join(f"count(*) FILTER (event IN ({', '.join(repr(e) for e in events)})) AS {name}" for name, events in eventlog.COUNTERS.items())
_COUNTERS_SQL += ", count(*) FILTER (event IN ('fetch_ok', 'early_response') AND cached) AS responses_from_cache, CAST(coalesce(sum(bytes) FILTER (event = 'fetch_ok'), 0) AS BIGINT) AS total_bytes_downloaded"


@register(f"WITH {_LOG} SELECT {_COUNTERS_SQL} FROM log")
def stats_counters(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.counters(_log(spark, d))


@register(f"WITH {_LOG} SELECT status, count(*) AS n FROM log WHERE event IN ('fetch_ok', 'early_response') GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.status_counts(_log(spark, d))


@register(f"WITH {_LOG} SELECT coalesce(string_agg(status || ': ' || n, ', ' ORDER BY status), 'none') AS statuses FROM (SELECT status, count(*) AS n FROM log WHERE event IN ('fetch_ok', 'early_response') GROUP BY status)")
def status_list(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.status_list(_log(spark, d))


@register(f"WITH {_LOG} SELECT coalesce(string_agg('- **' || status || '**: ' || n, chr(10) ORDER BY status), 'N/A') AS statuses FROM (SELECT status, count(*) AS n FROM log WHERE event IN ('fetch_ok', 'early_response') GROUP BY status)")
def status_lines(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.status_lines(_log(spark, d))


_TIMES = _LOG + ", times AS (SELECT url, arg_max(duration_ns, (ts, seq)) AS duration_ns FROM log WHERE event IN ('fetch_ok', 'fetch_failed') GROUP BY url)"
_SUMMARY = "count(*) AS n, CAST(sum(duration_ns) // count(*) AS BIGINT) AS average_ns, min(duration_ns) AS fastest_ns, max(duration_ns) AS slowest_ns"


@register(f"WITH {_TIMES} SELECT url, duration_ns FROM times")
def request_time_last_write(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.request_times(_log(spark, d))


@register(f"WITH {_TIMES} SELECT {_SUMMARY} FROM times")
def request_time_summary(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.time_summary(eventlog.request_times(_log(spark, d)))


@register(f"WITH {_LOG} SELECT {_SUMMARY} FROM log WHERE event = 'parse_ok'")
def parsing_time_summary(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.time_summary(eventlog.parsing_times(_log(spark, d)))


@register(f"WITH {_LOG}, e AS (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us, count(*) FILTER (event IN ('fetch_ok', 'fetch_failed')) AS n FROM log) SELECT round(CASE WHEN us > 0 THEN n / (us / 1e6) ELSE 0 END, 9) AS overall, round(CASE WHEN us >= 1000000 THEN n / floor(us / 1e6) ELSE 0 END, 9) AS whole_seconds FROM e")
def rates_overall(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    both = log.agg(F.count_if(F.col("event").isin("fetch_ok", "fetch_failed")).alias("n")).crossJoin(eventlog.elapsed(log))
    return both.select(F.round(formats.rate(F.col("n"), F.col("seconds")), 9).alias("overall"), F.round(formats.whole_second_rate(F.col("n"), F.col("seconds")), 9).alias("whole_seconds"))


# ---- folds --------------------------------------------------------------------------------


@register(f"""WITH RECURSIVE {_LOG}, o AS (SELECT host, duration_ns, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS r FROM log WHERE event IN {_HANDLED}),
f AS (SELECT host, r, duration_ns AS a FROM o WHERE r = 1 UNION ALL SELECT o.host, o.r, CAST(trunc(0.7::DOUBLE * f.a + 0.3::DOUBLE * o.duration_ns) AS BIGINT) FROM f JOIN o ON o.host = f.host AND o.r = f.r + 1)
SELECT host, arg_max(a, r) AS avg_ns, max(r) AS samples FROM f GROUP BY host""")
def endpoint_ema(spark: SparkSession, d: str) -> DataFrame:
    return folds.endpoint_average(_log(spark, d))


@register(f"WITH {_LOG} SELECT host, round(avg(CASE WHEN event IN ('fetch_ok', 'early_response') THEN 0.0 ELSE 1.0 END), 9) AS error_rate FROM log WHERE event IN {_HANDLED} GROUP BY host")
def endpoint_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return folds.endpoint_errors(_log(spark, d)).withColumn("error_rate", F.round("error_rate", 9))


@register(f"""WITH RECURSIVE {_LOG}, o AS (SELECT host AS metric, epoch_us(ts) AS us, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS r FROM log),
f AS (SELECT metric, r, 0.0::DOUBLE AS rate, us AS since, 1 AS n FROM o WHERE r = 1 UNION ALL
  SELECT o.metric, o.r, CASE WHEN (o.us - f.since) / 1e6 >= 1 THEN 0.2::DOUBLE * ((f.n + 1) / ((o.us - f.since) / 1e6)) + 0.8::DOUBLE * f.rate ELSE f.rate END,
    CASE WHEN (o.us - f.since) / 1e6 >= 1 THEN o.us ELSE f.since END, CASE WHEN (o.us - f.since) / 1e6 >= 1 THEN 0 ELSE f.n + 1 END
  FROM f JOIN o ON o.metric = f.metric AND o.r = f.r + 1)
SELECT metric, round(arg_max(rate, r), 9) AS rate, CAST(arg_max(n, r) AS BIGINT) AS pending FROM f GROUP BY metric""")
def rate_ema(spark: SparkSession, d: str) -> DataFrame:
    """The gated moving average of each host's rate of effects."""
    return folds.rate_average(_log(spark, d).withColumnRenamed("host", "metric")).withColumn("rate", F.round("rate", 9))


@register(f"""WITH RECURSIVE {_LOG}, m AS (SELECT 'requests' AS metric, ts, seq FROM log WHERE event IN ('fetch_ok', 'fetch_failed')
  UNION ALL SELECT 'responses', ts, seq FROM log WHERE event IN ('fetch_ok', 'early_response') UNION ALL SELECT 'items', ts, seq FROM log WHERE event = 'parse_ok'),
o AS (SELECT metric, epoch_us(ts) AS us, row_number() OVER (PARTITION BY metric ORDER BY ts, seq) AS r FROM m),
f AS (SELECT metric, r, 0.0::DOUBLE AS rate, us AS since, 1 AS n FROM o WHERE r = 1 UNION ALL
  SELECT o.metric, o.r, CASE WHEN (o.us - f.since) / 1e6 >= 1 THEN 0.2::DOUBLE * ((f.n + 1) / ((o.us - f.since) / 1e6)) + 0.8::DOUBLE * f.rate ELSE f.rate END,
    CASE WHEN (o.us - f.since) / 1e6 >= 1 THEN o.us ELSE f.since END, CASE WHEN (o.us - f.since) / 1e6 >= 1 THEN 0 ELSE f.n + 1 END
  FROM f JOIN o ON o.metric = f.metric AND o.r = f.r + 1)
SELECT metric, round(arg_max(rate, r), 9) AS rate, CAST(arg_max(n, r) AS BIGINT) AS pending FROM f GROUP BY metric""")
def stats_rate_ema(spark: SparkSession, d: str) -> DataFrame:
    """The gated moving averages of requests, responses and items."""
    return folds.rate_average(eventlog.rate_marks(_log(spark, d))).withColumn("rate", F.round("rate", 9))


@register(f"WITH {_LOG}, e AS (SELECT CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS s FROM log) SELECT (CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END) || printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS elapsed FROM e")
def format_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.elapsed(_log(spark, d)).select(formats.format_elapsed(F.col("seconds")).alias("elapsed"))


_TICKS = _LOG + f""", h AS (SELECT date_trunc('day', ts) AS tick, host, sum(duration_ns) // count(*) AS ns, avg(CASE WHEN event IN ('fetch_ok', 'early_response') THEN 0.0 ELSE 1.0 END) AS e FROM log WHERE event IN {_HANDLED} GROUP BY ALL),
t AS (SELECT tick, CAST((sum(ns) // count(*)) // 1000000 AS BIGINT) AS mean_ms, round(avg(e), 9) AS error_rate, row_number() OVER (ORDER BY tick) AS r FROM h GROUP BY tick)"""


@register(f"""WITH RECURSIVE {_TICKS}, f AS (SELECT 0::BIGINT AS r, 8::BIGINT AS p UNION ALL
  SELECT t.r, CASE WHEN error_rate > 0.1 THEN greatest(q - 2, 1) WHEN error_rate < 0.01 THEN least(q + 1, 20) ELSE q END FROM (
    SELECT t.r, t.error_rate, CASE WHEN mean_ms > 1000 THEN greatest(f.p - 1, 1) WHEN mean_ms < 500 THEN least(f.p + 1, 20) ELSE f.p END AS q FROM f JOIN t ON t.r = f.r + 1) t)
SELECT tick, p AS permits FROM f JOIN t USING (r)""")
def permit_controller(spark: SparkSession, d: str) -> DataFrame:
    return folds.permit_series(folds.ticks(_log(spark, d)), 8, 1, 20).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@register(f"""WITH RECURSIVE {_TICKS}, f AS (SELECT 0::BIGINT AS r, 8::BIGINT AS p UNION ALL
  SELECT t.r, CASE WHEN error_rate > 0.1 THEN greatest(q - 2, 1) WHEN error_rate < 0.01 THEN least(q + 1, 20) ELSE q END FROM (
    SELECT t.r, t.error_rate, CASE WHEN mean_ms > 400 THEN greatest(f.p - 1, 1) WHEN mean_ms < 200 THEN least(f.p + 1, 20) ELSE f.p END AS q FROM f JOIN t ON t.r = f.r + 1) t)
SELECT arg_max(p, r) AS permits FROM f""")
def permits_current(spark: SparkSession, d: str) -> DataFrame:
    """The permits after the last tick, with a target of 400 ms."""
    return folds.current_permits(folds.permit_series(folds.ticks(_log(spark, d)), 8, 1, 20, target_ms=400), 8)


@register("SELECT seq, op, component, CAST(amount AS BIGINT) AS amount, ok, CAST(available AS BIGINT) AS available FROM (VALUES (1, 'allocate', 'a', 30, true, 70), (2, 'allocate', 'b', 80, false, 70), (3, 'allocate', 'a', 20, true, 50), (4, 'release', 'a', NULL, true, 70), (5, 'release', 'c', NULL, true, 70), (6, 'allocate', 'c', 70, true, 0)) AS t(seq, op, component, amount, ok, available)")
def quota_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "allocate", "a", 30), (2, "allocate", "b", 80), (3, "allocate", "a", 20), (4, "release", "a", None), (5, "release", "c", None), (6, "allocate", "c", 70)]
    return folds.quota_ledger(spark.createDataFrame(rows, "seq bigint, op string, component string, amount bigint"), 100)


# ---- formats and reports --------------------------------------------------------------------


@register("SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (((b)::HUGEINT * 100 + 512) // 1024 // 100) || '.' || lpad((((b)::HUGEINT * 100 + 512) // 1024 % 100)::VARCHAR, 2, '0') || ' KB' WHEN b < 1073741824 THEN (((b)::HUGEINT * 100 + 524288) // 1048576 // 100) || '.' || lpad((((b)::HUGEINT * 100 + 524288) // 1048576 % 100)::VARCHAR, 2, '0') || ' MB' ELSE (((b)::HUGEINT * 100 + 536870912) // 1073741824 // 100) || '.' || lpad((((b)::HUGEINT * 100 + 536870912) // 1073741824 % 100)::VARCHAR, 2, '0') || ' GB' END AS formatted FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) * l_linenumber * l_partkey + l_linenumber AS b FROM lineitem)")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint") * F.col("l_linenumber") * F.col("l_partkey") + F.col("l_linenumber")
    return web.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", formats.format_bytes(size).alias("formatted"))


@register(f"WITH {_LOG} SELECT seq, CASE WHEN ns IS NULL THEN 'N/A' WHEN ns < 1000000000 THEN (ns // 1000000) || ' ms' ELSE (((ns)::HUGEINT * 100 + 500000000) // 1000000000 // 100) || '.' || lpad((((ns)::HUGEINT * 100 + 500000000) // 1000000000 % 100)::VARCHAR, 2, '0') || ' s' END AS formatted FROM (SELECT seq, CASE WHEN event = 'drop' THEN NULL ELSE duration_ns * 37 END AS ns FROM log)")
def format_time(spark: SparkSession, d: str) -> DataFrame:
    ns = F.when(F.col("event") != "drop", F.col("duration_ns") * 37)
    return _log(spark, d).select("seq", formats.format_ns(ns).alias("formatted"))


_SNAPSHOT = f"""{_TIMES}, c AS (SELECT {_COUNTERS_SQL} FROM log), t AS (SELECT {_SUMMARY} FROM times), p AS (SELECT {_SUMMARY} FROM log WHERE event = 'parse_ok'),
st AS (SELECT coalesce(string_agg(status || ': ' || n, ', ' ORDER BY status), 'none') AS statuses FROM (SELECT status, count(*) AS n FROM log WHERE event IN ('fetch_ok', 'early_response') GROUP BY status)),
el AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM log)"""


@register(f"""WITH {_SNAPSHOT} SELECT c.*, t.n AS request_times, t.average_ns AS avg_request_ns, t.fastest_ns AS fastest_request_ns, t.slowest_ns AS slowest_request_ns,
  p.n AS parses, p.average_ns AS avg_parse_ns, p.fastest_ns AS fastest_parse_ns, p.slowest_ns AS slowest_parse_ns, statuses, round(seconds, 6) AS seconds,
  round(requests_sent / seconds, 9) AS requests_per_second, round(responses_received / seconds, 9) AS responses_per_second, round(items_scraped / seconds, 9) AS items_per_second FROM c, t, p, st, el""")
def stats_snapshot(spark: SparkSession, d: str) -> DataFrame:
    snap = report.snapshot(_log(spark, d))
    return snap.withColumns({"seconds": F.round("seconds", 6)} | {c: F.round(c, 9) for c in snap.columns if c.endswith("_per_second")})


@register()
def stats_json(spark: SparkSession, d: str) -> DataFrame:
    return report.to_json(report.snapshot(_log(spark, d)))


@register()
def stats_markdown(spark: SparkSession, d: str) -> DataFrame:
    return report.to_markdown(report.snapshot(_log(spark, d)))


@register()
def stats_text(spark: SparkSession, d: str) -> DataFrame:
    return report.to_text(report.snapshot(_log(spark, d)))


# ---- streams ----------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.from_events(live.read_events(spark, f"{d}/events.parquet"))


@register(f"WITH {_LOG} SELECT date_trunc('hour', ts) AS hour, event, count(*) AS n FROM log GROUP BY ALL")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    out = live.drain(live.hourly_counts(_stream(spark, d)), "stream-counters", "complete")
    last = out.agg(F.max("batch").alias("b"))
    return out.join(F.broadcast(last), out.batch == last.b).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event", "n")


@register(f"WITH {_LOG} SELECT DISTINCT url FROM log")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return live.drain(live.first_seen(_stream(spark, d)).select("url"), "stream-dedup", "append").select("url")


@register()
def stream_rate_ema(spark: SparkSession, d: str) -> DataFrame:
    out = live.drain(live.rate_averages(_stream(spark, d)), "stream-rates", "update")
    return out.groupBy("event").agg(F.max_by("rate", "batch").alias("rate"), F.max_by("pending", "batch").alias("pending"))
