"""Closed-form cases and invariants of the crawl operators."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import formats, urls
from spindrift.operators import chains, eventlog, folds, frontier
from spindrift.operators.chains import Pipeline, Step
from spindrift.plans import crawl, report
from spindrift.plans.crawl import ConfigurationError, CrawlBuilder, page_crawl
from spindrift.sources import fetchers, sinks, snapshots, web


@pytest.mark.parametrize(
    ("permits", "mean", "error", "high", "expected"),
    [(5, 100, 0, 10, 7), (10, 1500, 0.5, 20, 7), (10, 1500, 0, 20, 10), (10, 700, 0.05, 20, 10), (10, 500, 0.01, 20, 10), (10, 1000, 0.1, 20, 10), (1, 1500, 0.5, 20, 1), (20, 100, 0, 20, 20), (2, 100, 0.5, 20, 1), (1, 1500, 0, 20, 2), (7, None, None, 20, 7)],
)
def test_permits(permits, mean, error, high, expected):
    assert folds.next_permits(permits, mean, error, 1, high) == expected


def test_quota_refuses_and_returns(spark):
    rows = spark.createDataFrame([(1, "allocate", "component1", 30), (2, "allocate", "component2", 80), (3, "release", "component1", None)], "seq long, op string, component string, amount long")
    assert [(r.ok, r.available) for r in folds.quota_ledger(rows, 100).orderBy("seq").collect()] == [(True, 70), (False, 70), (True, 100)]


def test_endpoint_average_truncates(spark):
    rows = spark.createDataFrame([(1, "a", 100, "fetch_ok"), (2, "a", 200, "fetch_failed"), (3, "a", 300, "fetch_failed")], "seq long, host string, duration_ns long, event string").withColumn("ts", F.timestamp_seconds("seq"))
    assert folds.endpoint_average(rows).collect()[0][1:] in {(181, 3), (180, 3)}
    assert folds.endpoint_errors(rows).collect()[0].error_rate == pytest.approx(2 / 3)


def test_folds_of_nothing(spark):
    log = spark.createDataFrame([], "seq long, ts timestamp, event string, host string, url string, status int, bytes long, duration_ns long, cached boolean")
    assert folds.endpoint_average(log).count() == 0
    assert eventlog.counters(log).first().asDict()["requests_sent"] == 0
    assert eventlog.time_summary(eventlog.request_times(log)).first().asDict() == {"n": 0, "average_ns": None, "fastest_ns": None, "slowest_ns": None}
    assert eventlog.status_list(log).first()[0] == "none"
    assert "| Statuses | none |" in report.to_markdown(report.snapshot(log)).first()[0]


def test_last_write_wins(spark):
    log = spark.createDataFrame([(1, "a", 10), (2, "b", 5), (3, "a", 20)], "seq long, url string, duration_ns long").withColumns({"ts": F.timestamp_seconds("seq"), "event": F.lit("fetch_ok")})
    assert tuple(eventlog.time_summary(eventlog.request_times(log)).first()) == (2, 12, 5, 20)


def test_formats(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1 << 20: "1.00 MB", 1 << 30: "1.00 GB", None: None}
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.format_bytes(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == sizes
    times = {None: "N/A", 999_999_999: "999 ms", 1_000_000_000: "1.00 s"}
    got = spark.createDataFrame([(n,) for n in times], "n long").select("n", formats.format_ns(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == times


def test_formats_just_below_a_half(spark):
    """Quotients that six decimals round up to a whole number; against Python's whole numbers."""
    sizes = [(k * unit - unit // 2 - 1) // 100 + more for unit in (1 << 10, 1 << 20, 1 << 30) for k in (101, 1999, 102_300) for more in (0, 1)] + [(1 << 63) - 1]
    times = [1_004_999_999, 1_004_999_995, 1_004_999_994, 1_005_000_000, 59_994_999_999, (1 << 63) - 1]

    def want(n, steps):
        unit, name = next((u, name) for u, name in steps if n >= u)
        c = (n * 100 + unit // 2) // unit
        return f"{c // 100}.{c % 100:02d} {name}"

    for values, shown, steps in ((sizes, formats.format_bytes, [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]), (times, formats.format_ns, [(10**9, "s")])):
        got = spark.createDataFrame([(n,) for n in values], "n long").select("n", shown(F.col("n"))).collect()
        assert {r[0]: r[1] for r in got} == {n: want(n, steps) for n in values}


def test_chain_order_and_short_circuit(spark):
    rows = spark.createDataFrame([(1,)], "id long")
    free = [Step(n) for n in "ABC"]
    assert chains.run_chain(rows, free).first().trace == "A,B,C"
    assert chains.run_chain(rows, free, reverse=True).first().trace == "C,B,A"
    stops = [Step("A"), Step("B", [(F.col("id") == 1, "drop")]), Step("C")]
    assert chains.run_chain(rows, stops).first()[1:] == ("drop", "B", 0, "A,B")
    assert chains.run_chain(rows, stops, reverse=True).first().trace == "C,B"
    assert chains.run_chain(rows, []).first().action == "continue"


def test_item_chain(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    done = chains.run_items(rows, [Pipeline("p", F.col("item_id") != 2, fails=F.col("item_id") == 3)])
    assert [(r.dropped_by, r.drop_kind) for r in done.orderBy("item_id").collect()] == [(None, None), ("p", "none"), ("p", "error")]


def test_urls(spark):
    cases = [("http://a.b/c#d", "http://a.b/c", "a.b", True), ("nothing", "nothing", "unknown", False), (None, None, "unknown", False)]
    got = spark.createDataFrame([(c[0],) for c in cases], "u string").select(urls.canonical(F.col("u")), urls.host(F.col("u")), urls.is_url(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_one_bad_seed_fails_all(spark):
    rows = web.seeds(spark, ["http://a.b/#x", "bad"])
    assert [r.url for r in web.start_requests(rows, strict=False).collect()] == ["http://a.b/"]
    with pytest.raises(Exception, match="not a URL"):
        web.start_requests(rows).collect()


def test_capacity(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "seq long")
    for room, kept in ((3, 3), (0, 0), (50, 10)):
        admitted, rejected = frontier.cap(rows, ["seq"], room)
        assert (admitted.count(), rejected.count()) == (kept, 10 - kept)


def test_builder_checks(spark, data):
    with pytest.raises(ConfigurationError):
        CrawlBuilder(None).build()
    for change in ("max_concurrent_downloads", "max_parser_workers", "max_concurrent_pipelines"):
        with pytest.raises(ConfigurationError):
            getattr(page_crawl(web.read(spark, data, "pages")), change)(0).build()


def test_crawl_invariants(spark, data):
    plan = page_crawl(web.read(spark, data, "pages")).add_middleware(Step("drop", [(F.col("id") % 7 == 3, "drop")])).build()
    result = plan.run(spark, spark.createDataFrame([(0,), (10_000,)], "id long"))
    ids = [r.id for r in result.visited.collect()]
    assert len(ids) == len(set(ids)) and all(i % 7 != 3 for i in ids)
    events = {r.event: r.n for r in result.log.groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert events["fetch_ok"] == len(ids) == events["parse_ok"] and events["fetch_failed"] == 1 and events["drop"] > 0


def test_snapshot_is_replaced_whole(spark, tmp_path):
    where = f"file://{tmp_path}/s"
    assert snapshots.load(spark, where) is None
    for n in (1, 2):
        snapshots.save(spark, where, {"visited": spark.range(n)}, n, {"cookies": []})
    found = snapshots.load(spark, where)
    assert found["round"] == 2 and found["visited"].count() == 2 and found["extra"] == {"cookies": []}
    (tmp_path / "s" / "manifest.json").write_text("{")
    (tmp_path / "s" / ".manifest.json.crc").unlink(missing_ok=True)
    assert snapshots.load(spark, where) is None


def test_bfs_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in crawl.bfs(none, spark.createDataFrame([(5,)], "id long")).collect()] == [(5, 0)]


def test_llm_is_not_needed():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "spindrift"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def test_responses_are_judged(spark, data):
    """Early responses aren't sent; dropped responses stay counted but aren't visited."""
    first = web.read(spark, data, "pages").where("page_id = 0").first().html
    step = Step("s", [(F.col("id") == 0, "return")], when_response=[(F.col("id") % 5 == 2, "drop")], response={"html": F.lit(first)})
    result = page_crawl(web.read(spark, data, "pages")).add_middleware(step).max_rounds(8).build().run(spark, spark.createDataFrame([(0,)], "id long"))
    events = {r.event: r.n for r in result.log.groupBy("event").agg(F.count("*").alias("n")).collect()}
    ids = {r.id for r in result.visited.collect()}
    assert events["early_response"] == 1 and 0 in ids and all(i % 5 != 2 for i in ids)
    assert events["fetch_ok"] == len(ids) - 1 + events["drop"]


def test_python_adapters(spark, tmp_path):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return 200, f"<{url}>"

    rows = spark.createDataFrame([(1, "http://a/x"), (2, "http://bad/y")], "id long, url string")
    got = fetchers.fetch_with(rows, get, 2).orderBy("id").collect()
    assert [(r.status, r.body, r.error) for r in got] == [(200, "<http://a/x>", None), (None, None, "OSError: no route")]
    parse = lambda url, body: ([body], [url + "/1", url + "/2"])
    responses = spark.createDataFrame([("u", "b")], "url string, body string")
    items, requests = fetchers.parse_with(responses, parse)
    assert [r.value for r in items.collect()] == ["b"] and sorted(r.value for r in requests.collect()) == ["u/1", "u/2"]
    spark.udtf.register("parse_page", fetchers.parser(parse))
    responses.createOrReplaceTempView("responses")
    assert spark.sql("SELECT kind, value FROM responses, LATERAL parse_page(url, body)").count() == 3
    for kind in ("parquet", "json", "csv", "orc", "text"):
        sinks.write(items, f"file://{tmp_path}/{kind}", kind)
        assert spark.read.format(kind).load(f"file://{tmp_path}/{kind}").count() == 1


def test_ledger_reads(spark):
    rows = spark.createDataFrame([(1, "allocate", "a", 30), (2, "allocate", "b", 20), (3, "release", "a", None)], "seq long, op string, component string, amount long")
    ledger = folds.quota_ledger(rows, 100)
    assert folds.available(ledger, 100).first()[0] == 80 and [tuple(r) for r in folds.allocations(ledger).collect()] == [("b", 20)]


def downloads(spark, data, folder, broken=()):
    """A crawl of the pages table whose downloader leaves a file for each request it gets."""
    rows = {r.page_id: (r.url, r.html) for r in web.read(spark, data, "pages").collect()}

    def get(i):
        import uuid

        (folder / f"{i}-{uuid.uuid4().hex}").touch()
        if i in broken:
            raise OSError("no route")
        return 200, rows[i][1]

    def fetch(requests):
        named = requests.select("id", F.col("id").cast("string").alias("url"))
        return fetchers.fetch_with(named, lambda u: get(int(u)), 2).withColumnRenamed("body", "html")

    return page_crawl(web.read(spark, data, "pages")).downloader(fetch)


def test_each_page_is_downloaded_once(spark, data, tmp_path):
    first = web.read(spark, data, "pages").where("page_id = 0").first().html
    closed = []
    plan = downloads(spark, data, tmp_path, broken=(4,)).add_middleware(Step("early", [(F.col("id") == 0, "return")], response={"html": F.lit(first)}))
    plan = plan.add_pipeline(Pipeline("odd", F.col("page_id") % 2 == 1, close=lambda: closed.append("odd"))).max_rounds(4).build()
    result = plan.run(spark, spark.createDataFrame([(0,), (4,)], "id long"))
    events = {r.event: r.n for r in result.log.groupBy("event").agg(F.count("*").alias("n")).collect()}
    got = [int(p.name.split("-")[0]) for p in tmp_path.iterdir()]
    assert 0 not in got and len(got) == events["fetch_ok"] + events["fetch_failed"]
    assert len([i for i in got if i != 4]) == len({i for i in got if i != 4}) == events["fetch_ok"]
    stats = result.stats().first()
    assert stats.requests_sent == len(got) and stats.requests_succeeded == events["fetch_ok"] + 1
    assert stats.items_processed + stats.items_dropped_by_pipeline == stats.items_scraped == result.visited.count() and stats.items_dropped_by_pipeline > 0
    assert stats.fastest_request_ns > 0 and closed == ["odd"]
    assert folds.endpoint_errors(result.log).where("error_rate > 0").count() == 1


def test_crawl_capacity(spark, data):
    """Beyond the bound the last requests by id are rejected; a later offer may admit them."""
    pages = web.read(spark, data, "pages")
    out = {}
    for r in web.edges(pages).collect():
        out.setdefault(r.src, []).append(r.dst)
    seen, live, rejected, offered = set(), [0], 0, 1
    while live:
        seen |= set(live)
        found = [t for i in live for t in out.get(i, [])]
        new = sorted(set(found) - seen)
        live, lost = new[:4], set(new[4:])
        rejected += sum(t in lost for t in found)
        offered += sum(t not in lost for t in found)
    result = page_crawl(pages).max_pending(4).build().run(spark, spark.createDataFrame([(0,)], "id long"))
    assert {r.id for r in result.visited.collect()} == seen
    events = {r.event: r.n for r in result.log.groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert rejected > 0 and events["rejected_capacity"] == rejected and events["enqueue_ok"] == offered


def test_crawl_delays_retries(spark, data):
    step = Step("wait", [(F.col("id") == 0, "retry")], delay_ms=2500)
    result = page_crawl(web.read(spark, data, "pages")).add_middleware(step).max_rounds(3).build().run(spark, spark.createDataFrame([(0,)], "id long"))
    assert [r["round"] for r in result.log.where("event = 'retry'").orderBy("round").collect()] == [0, 3, 6]
    assert result.visited.count() == 0 and [tuple(r) for r in result.frontier.collect()] == [(0, 9)] and result.rounds == 7
    slow = page_crawl(web.read(spark, data, "pages")).round_ms(2500).add_middleware(step).max_rounds(3).build().run(spark, spark.createDataFrame([(0,)], "id long"))
    assert slow.rounds == 3


def test_crawl_stops_and_goes_on(spark, data, tmp_path):
    pages, seeds = web.read(spark, data, "pages"), spark.createDataFrame([(0,)], "id long")
    whole = page_crawl(pages).build().run(spark, seeds)
    told = []
    state = Pipeline("all", F.lit(True), state=F.count("*"), restore=told.append)
    plan = page_crawl(pages).add_pipeline(state).spider_state(longest=F.max(F.length("title"))).with_checkpoint_path(f"file://{tmp_path}/s").with_checkpoint_interval(1)
    part = plan.build().run(spark, seeds, stop=lambda rounds: rounds == 2)
    assert part.stopped and part.rounds == 2 and part.pending > 0 and part.states["all"]["state"] == part.items.count()
    assert plan.build().run(spark, seeds, resume=True, time_limit_s=0).rounds == 2
    rest = plan.build().run(spark, seeds, resume=True)
    assert told and told[0]["state"] == part.states["all"]["state"] and not rest.stopped
    assert sorted(map(tuple, rest.visited.collect())) == sorted(map(tuple, whole.visited.collect())) and rest.items.count() == whole.items.count()
    assert rest.log.count() == whole.log.count() + whole.items.count() * 0 and "longest" in rest.states["spider"]
    again = plan.build().run(spark, seeds)  # a crawl that doesn't resume starts its snapshots afresh
    assert snapshots.load(spark, f"file://{tmp_path}/s")["visited"].count() == again.visited.count()
    assert page_crawl(pages).with_checkpoint_path(f"file://{tmp_path}/s").build().run(spark, seeds, resume=True).visited.count() == whole.visited.count()
    import shutil

    for folder in (tmp_path / "s").glob("snapshot-*"):
        shutil.rmtree(folder)
    assert snapshots.load(spark, f"file://{tmp_path}/s") is None


def test_console_is_the_default_sink(spark, data, capsys):
    plan = page_crawl(web.read(spark, data, "pages"))
    plan._silent = False
    plan.max_rounds(1).build().run(spark, spark.createDataFrame([(0,)], "id long"))
    assert "title" in capsys.readouterr().out
    with pytest.raises(ConfigurationError):
        plan.add_pipeline(Pipeline("a", F.lit(True))).add_pipeline(Pipeline("a", F.lit(True))).build()


def test_rate_of_events_at_one_instant(spark):
    """Equal times, counted before the fold, give what a fold over single events gives."""
    import random

    r = random.Random(3)
    times = sorted(r.choice([0.0, 0.2, 0.9, 1.0, 1.5, 2.5, 2.5, 4.0]) for _ in range(40))
    rate, since, n = 0.0, times[0], 0
    for now in times:
        n += 1
        if now - since >= 1:
            rate, since, n = 0.2 * (n / (now - since)) + 0.8 * rate, now, 0
    rows = spark.createDataFrame([("m", t) for t in times], "metric string, s double").select("metric", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    got = folds.rate_average(rows).first()
    assert got.rate == pytest.approx(rate) and got.pending == n


def test_worker_rule_and_settled_requests(spark):
    assert [folds.scale_workers(d, w, 4) for d, w in ((13, 4), (12, 4), (100, 16), (1, 4), (1, 6), (3, 6))] == [5, 4, 16, 4, 5, 6]
    rows = [("fetch_ok",), ("fetch_failed",), ("drop",), ("retry",), ("early_response",), ("enqueue_ok",)]
    log = spark.createDataFrame(rows, "event string").withColumns({"host": F.lit("h"), "duration_ns": F.lit(5)})
    assert folds.endpoint_errors(log).first().error_rate == pytest.approx(3 / 5)
