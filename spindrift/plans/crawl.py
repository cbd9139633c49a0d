"""The crawl as a fixpoint, its configuration and its builder.

A round takes the frontier, drops what was visited (anti join), runs the request chain,
looks pages up, runs the response chain, parses items and links, and offers the links to
the next round. All of a round sees the visited set as of the end of the round before. The
loop ends when a round admits nothing, or at the cap on rounds.

Each round's frames are written to the shared folder, which cuts the lineage and outlives
executors. Responses are written too, so that each page is downloaded once, and deleted at
the end of their round. Every effect is a row of one log (LOG), over which all counters run.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.operators.chains import Pipeline, Step, requeue, run_chain, run_items
from spindrift.operators.frontier import cap
from spindrift.plans import report
from spindrift.scratch import discard, materialize, written
from spindrift.sources import sinks, snapshots, web

_LOGGER = logging.getLogger("spindrift")


class ConfigurationError(ValueError):
    """A crawl that can't be run as configured."""


@dataclass(frozen=True)
class CrawlConfig:
    """Defaults follow the number of cores; the first four bound work in flight where a downloader
    or parser asks for them, and change no result. ``max_rounds`` ends a crawl with its frontier
    kept. ``max_pending`` bounds the frontier: later requests are rejected (None: no bound).
    ``round_ms`` is the time that a round stands for in delays."""

    max_concurrent_downloads: int = field(default_factory=lambda: max(os.cpu_count() or 1, 16))
    parser_workers: int = field(default_factory=lambda: min(max(os.cpu_count() or 1, 4), 16))
    max_concurrent_pipelines: int = field(default_factory=lambda: min(os.cpu_count() or 1, 8))
    channel_capacity: int = 1000
    max_rounds: int = 100
    max_pending: int | None = None
    round_ms: int = 1000

    def validate(self) -> None:
        for name in ("max_concurrent_downloads", "parser_workers", "max_concurrent_pipelines", "channel_capacity", "max_rounds", "max_pending", "round_ms"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ConfigurationError(f"{name} must be greater than 0")


def bfs(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None, visited: DataFrame | None = None, first_depth: int = 0) -> DataFrame:
    """(id, depth) of all that can be reached from ``seeds`` (id) over ``edges`` (src, dst).

    Semi-naive: only the last round's new rows are joined with the edges. ``visited``
    and ``first_depth`` resume an earlier run whose last rows are the seeds. ``max_rounds``
    asks for the pages up to that depth only; without it the walk ends when nothing is new.
    """
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    links = materialize(links, "bfs-edges")
    new = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(first_depth)), "bfs-round")
    found = _Parts([new] if visited is None else [visited, new], "bfs-visited")
    for depth in count(first_depth + 1) if max_rounds is None else range(first_depth + 1, first_depth + max_rounds + 1):
        offered = new.join(links, new.id == links.src).select(F.col("dst").alias("id")).distinct()
        new = materialize(offered.join(found.whole().select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "bfs-round")
        if new.isEmpty():
            break
        found.add(new)
    return found.whole()


#: The log of a crawl, the same for every downloader; see :mod:`spindrift.operators.eventlog`.
LOG = "round int, seq bigint, ts timestamp, event string, id bigint, url string, host string, status int, bytes bigint, duration_ns bigint, cached boolean, pipeline string, settles boolean"
NO_ITEMS = "page_id bigint, title string, dropped_by string, drop_kind string"


@dataclass(frozen=True)
class CrawlResult:
    visited: DataFrame  # id, depth
    frontier: DataFrame  # id, not_before: admitted but not fetched when the crawl ended
    items: DataFrame  # what the parser found, dropped_by, drop_kind
    log: DataFrame  # LOG
    rounds: int
    states: dict[str, dict] = field(default_factory=dict)  # pipeline (or spider state) -> its aggregate
    stopped: bool = False  # by a stop condition, not because nothing was left

    def stats(self) -> DataFrame:
        """One row: counters, times, statuses and rates of the crawl so far."""
        return report.snapshot(self.log)

    @property
    def pending(self) -> int:
        return self.frontier.count()


@dataclass(frozen=True)
class Crawl:
    """A validated plan; nothing runs before :meth:`run`.

    ``fetch`` maps requests (id) to responses: id, status (NULL: failed) and the body's columns;
    url, bytes, duration_ns and cached go to the log if it gives them. ``parse`` maps responses
    to (items, requests). Responses are written once a round and read from there, so a page is
    downloaded once; they are deleted when the round is over.
    """

    config: CrawlConfig
    parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    fetch: Callable[[DataFrame], DataFrame]
    steps: tuple[Step, ...] = ()
    pipelines: tuple[Pipeline, ...] = ()
    checkpoint_path: str | None = None
    checkpoint_interval: int | None = None
    sink: Callable[[DataFrame], None] | None = None
    spider_state: dict[str, Column] = field(default_factory=dict)

    def run(self, spark: SparkSession, seeds: DataFrame, resume: bool = False, stop: Callable[[int], bool] | None = None, time_limit_s: float | None = None) -> CrawlResult:
        """Crawl from ``seeds`` (id), or go on from the checkpoint if there is one and ``resume``.

        ``stop`` (asked with the number of rounds done), ``time_limit_s`` and an interrupt end
        the crawl between rounds: what wasn't handled stays in the frontier, and the last
        snapshot holds it.
        """
        began = time.monotonic()
        empty = spark.createDataFrame([], "id bigint, depth int")
        visited, items, log = _Parts([empty], "crawl-visited"), _Parts([], "crawl-items"), _Parts([], "crawl-log")
        depth, stopped = 0, False
        saved = snapshots.load(spark, self.checkpoint_path) if resume and self.checkpoint_path else None
        if saved is not None:
            visited, items, log = _Parts([saved["visited"]], "crawl-visited"), _Parts([saved["items"]] if "items" in saved else [], "crawl-items"), _Parts([saved["log"]], "crawl-log")
            frontier, depth = saved["frontier"], saved["round"]
            self._restore(saved["extra"].get("states", {}))
        else:
            asked = materialize(seeds.select(F.col("id").cast("bigint").alias("id")), "crawl-seeds")
            frontier, first = self._enqueue(asked, empty, None, 0, _events)
            log.add(materialize(first, "crawl-log"))
        follows = saved is not None  # whether the last snapshot is this crawl's
        pending = saved is None  # whether log and the rest hold more than the last snapshot
        for _ in range(self.config.max_rounds):
            try:
                if (stop is not None and stop(depth)) or (time_limit_s is not None and time.monotonic() - began >= time_limit_s):
                    stopped = True
                    break
                # requests that were visited meanwhile go; repeats are one request
                live = materialize(frontier.join(visited.whole().select("id"), "id", "left_anti").groupBy("id").agg(F.min("not_before").alias("not_before")), "crawl-live")
                soonest = live.agg(F.min("not_before")).first()[0]
                if soonest is None:
                    frontier = live
                    break
                depth = max(depth, soonest)  # nothing happens until the first delay is over
                frontier = self._round(live, visited, items, log, depth)
                depth += 1
                pending = True
                if self.checkpoint_path and self.checkpoint_interval and depth % self.checkpoint_interval == 0:
                    self._save(spark, visited, frontier, items, log, depth, follows)
                    pending, follows = False, True
            except KeyboardInterrupt:  # the round that was under way counts for nothing
                stopped = True
                break
        frontier = frontier.join(visited.whole().select("id"), "id", "left_anti")
        if self.checkpoint_path and (pending or saved is None):
            self._save(spark, visited, frontier, items, log, depth, follows)
        found = items.whole() if items.parts else spark.createDataFrame([], NO_ITEMS)
        result = CrawlResult(visited.whole(), frontier, found, log.whole(), depth, self.states(found), stopped)
        if self.sink is not None:
            self.sink(found)
        for p in self.pipelines:
            if p.close is not None:
                p.close()
        if _LOGGER.isEnabledFor(logging.INFO):
            _LOGGER.info("%s", report.to_text(result.stats()).first()[0])
        return result

    def _round(self, live: DataFrame, visited: _Parts, items: _Parts, log: _Parts, depth: int) -> DataFrame:
        """One round over the requests that are due; the frontier after it."""
        due, waiting = live.where(F.col("not_before") <= depth).select("id"), live.where(F.col("not_before") > depth)
        decided = materialize(run_chain(due, list(self.steps)), "crawl-decided")
        early = [self._early(step, decided) for step in self.steps if step.gives("return")]
        responses = self.fetch(decided.where("action = 'continue'").select("id")).withColumn("early", F.lit(False))
        for some in early:
            responses = responses.unionByName(some, allowMissingColumns=True)
        for name, kind in (("url", "string"), ("bytes", "bigint"), ("duration_ns", "bigint"), ("cached", "boolean"), ("status", "int")):
            if name not in responses.columns:
                responses = responses.withColumn(name, F.lit(None).cast(kind))
        judged = run_chain(responses, list(self.steps), reverse=True, response=True)
        judged = judged.withColumn("outcome", F.when(F.col("early") | F.col("status").isNotNull(), F.col("action")).otherwise("failed"))
        judged, where = written(judged, "crawl-responses")
        answered = judged.where("outcome = 'continue'")
        found, requests = self.parse(answered)
        free = {"dropped_by": F.lit(None).cast("string"), "drop_kind": F.lit(None).cast("string")}
        found = materialize(run_items(found, list(self.pipelines)) if self.pipelines else found.withColumns(free), "crawl-items")
        requests = materialize(requests.select("id"), "crawl-requests")
        again = _delayed(decided.where("action = 'retry'"), depth, self.config.round_ms).unionByName(_delayed(judged.where("outcome = 'retry'"), depth, self.config.round_ms))
        kept = materialize(waiting.unionByName(again), "crawl-waiting")
        done = materialize(answered.select("id", F.lit(depth).alias("depth")).dropDuplicates(["id"]), "crawl-done")
        # effects of requests that got no response, of responses, of items and of offers
        name = F.when(F.col("action") == "error", "middleware_error").otherwise(F.col("action"))
        unsent = _events(decided.where("action IN ('retry', 'drop', 'error')").withColumn("event", name), depth, settles=F.lit(True))
        last = F.when(F.col("outcome").isin("retry", "drop"), F.col("outcome")).when(F.col("outcome") == "error", "middleware_error")
        kinds = F.array_compact(F.array(F.when(F.col("early"), "early_response").when(F.col("outcome") == "failed", "fetch_failed").otherwise("fetch_ok"), F.coalesce(last, F.when(F.col("outcome") == "continue", "parse_ok"))))
        effects = judged.select("*", last.isNotNull().alias("refused"), F.explode(kinds).alias("event"))
        answer = F.col("event").isin("early_response", "fetch_failed", "fetch_ok")
        effects = _events(effects, depth, settles=F.when(F.col("refused"), ~answer & (F.col("event") != "parse_ok")).otherwise(answer), timed=answer)
        ends = found.withColumn("event", F.when(F.col("dropped_by").isNull(), "item_ok").otherwise("item_dropped"))
        ends = _events(ends, depth, pipeline=F.col("dropped_by"))
        seen = _Parts([*visited.parts, done], "crawl-visited")
        new, offers = self._enqueue(requests, seen.whole(), kept, depth + 1, lambda rows, _: _events(rows, depth))
        log_part = materialize(unsent.unionByName(effects).unionByName(ends).unionByName(offers), "crawl-log")
        discard(live.sparkSession, where)
        # from here on nothing can fail: a round counts as a whole or not at all
        visited.add(done)
        items.add(found)
        log.add(log_part)
        return kept.unionByName(new)

    def _enqueue(self, offered: DataFrame, visited: DataFrame, waiting: DataFrame | None, ready: int, events) -> tuple[DataFrame, DataFrame]:
        """(new requests, events of the offers): duplicates of visited ones count as enqueued but
        aren't; beyond ``max_pending`` the last by id are rejected."""
        fresh = offered.join(visited.select("id"), "id", "left_anti").distinct()
        if waiting is not None:
            fresh = fresh.join(waiting.select("id"), "id", "left_anti")
        fresh = materialize(fresh, "crawl-fresh")
        held = 0 if waiting is None else waiting.select("id").distinct().count()
        named = offered.withColumn("event", F.lit("enqueue_ok"))
        if self.config.max_pending is not None:
            admitted, rejected = cap(fresh, ["id"], self.config.max_pending - held)
            fresh = materialize(admitted, "crawl-admitted")
            refused = rejected.select(F.col("id").alias("rid"))
            named = offered.join(refused, offered.id == refused.rid, "left").select("id", F.when(F.col("rid").isNull(), "enqueue_ok").otherwise("rejected_capacity").alias("event"))
        return fresh.withColumn("not_before", F.lit(ready)), events(named, 0)

    def _early(self, step: Step, decided: DataFrame) -> DataFrame:
        given = {n: c for n, c in step.response.items() if n != "id"}
        rows = decided.where((F.col("action") == "return") & (F.col("decided_by") == step.name))
        status = given.pop("status", F.lit(200))
        return rows.select("id", status.cast("int").alias("status"), F.lit(True).alias("early"), *[c.alias(n) for n, c in given.items()])

    def states(self, items: DataFrame) -> dict[str, dict]:
        """The states of the pipelines that have any, over the items that reached them, and the spider's."""
        out = {}
        for i, p in enumerate(self.pipelines):
            if p.state is not None:
                before = [q.name for q in self.pipelines[:i]]
                reached = items.where(F.col("dropped_by").isNull() | ~F.col("dropped_by").isin(before)) if before else items
                out[p.name] = reached.agg(p.state.alias("state")).first().asDict()
        if self.spider_state:
            out["spider"] = items.agg(*[c.alias(n) for n, c in self.spider_state.items()]).first().asDict()
        return out

    def _restore(self, states: dict[str, dict]) -> None:
        found, unknown = snapshots.match_states([*[p.name for p in self.pipelines], "spider"], states)
        for name in unknown:
            _LOGGER.warning("the snapshot has the state of a pipeline %s, which this crawl lacks", name)
        for p in self.pipelines:
            if p.restore is not None and p.name in found:
                p.restore(found[p.name])

    def _save(self, spark: SparkSession, visited: _Parts, frontier: DataFrame, items: _Parts, log: _Parts, depth: int, follows: bool) -> None:
        states = self.states(items.whole()) if items.parts else {}
        growing = {n: t.unsaved() for n, t in (("visited", visited), ("items", items), ("log", log))}
        snapshots.save(spark, self.checkpoint_path, {"frontier": frontier}, depth, {"states": states}, {n: t for n, t in growing.items() if t is not None}, follows)
        for t in (visited, items, log):
            t.saved()


def _delayed(rows: DataFrame, depth: int, round_ms: int) -> DataFrame:
    """(id, not_before) of rows to retry, by their delay."""
    retried = rows.withColumns({"action": F.lit("retry"), "round": F.lit(depth)})
    return requeue(retried, round_ms).select("id", F.col("not_before_round").cast("int").alias("not_before"))


def _events(rows: DataFrame, depth: int, settles: Column | None = None, pipeline: Column | None = None, timed: Column | None = None) -> DataFrame:
    """Rows with a column ``event`` as rows of LOG. ``seq`` is unique in a round."""
    names = set(rows.columns)
    have = {n: F.col(n) if n in names else F.lit(None) for n in ("url", "status", "bytes", "duration_ns", "cached")}
    ident = F.col("id") if "id" in names else F.col("page_id") if "page_id" in names else F.lit(None)
    if timed is not None:  # bytes and times belong to the answer, not to what followed
        have |= {n: F.when(timed, have[n]) for n in ("bytes", "duration_ns")}
    # every text column may be NULL; times and counters then leave the row out
    host = urls.host(have["url"]) if "url" in names else F.lit("unknown")
    values = {
        "round": F.lit(depth), "seq": F.monotonically_increasing_id(), "ts": F.current_timestamp(), "event": F.col("event"), "id": ident, "url": have["url"], "host": host, "status": have["status"],
        "bytes": have["bytes"], "duration_ns": have["duration_ns"], "cached": F.coalesce(have["cached"].cast("boolean"), F.lit(False)), "pipeline": pipeline if pipeline is not None else F.lit(None),
        "settles": F.coalesce(settles, F.lit(False)) if settles is not None else F.lit(False),
    }
    return rows.select(*[values[n].cast(k).alias(n) for n, k in (c.split(" ") for c in LOG.split(", "))])


class _Parts:
    """A table that grows by a part a round; parts are merged to one written table now and
    then, so that neither plans nor the number of files grow with the rounds."""

    def __init__(self, parts: list[DataFrame], name: str, most: int = 8) -> None:
        self.parts, self.name, self.most, self.new = list(parts), name, most, []

    def unsaved(self) -> DataFrame | None:
        """What was added since :meth:`saved` was called."""
        out = None
        for part in self.new:
            out = part if out is None else out.unionByName(part)
        return out

    def saved(self) -> None:
        self.new = []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        self.new.append(part)
        if len(self.parts) > self.most:
            self.parts = [materialize(self.whole(), self.name)]

    def whole(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


class CrawlBuilder:
    """Fluent configuration of a :class:`Crawl`."""

    def __init__(self, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None) -> None:
        self._parse, self._config = parse, CrawlConfig()
        self._fetch: Callable[[DataFrame], DataFrame] | None = None
        self._steps: list[Step] = []
        self._pipelines: list[Pipeline] = []
        self._path: str | None = None
        self._interval: int | None = None
        self._sink: Callable[[DataFrame], None] | None = None
        self._silent = False
        self._state: dict[str, Column] = {}

    def _set(self, **changes) -> CrawlBuilder:
        self._config = replace(self._config, **changes)
        return self

    def max_concurrent_downloads(self, n: int) -> CrawlBuilder:
        return self._set(max_concurrent_downloads=n)

    def max_parser_workers(self, n: int) -> CrawlBuilder:
        return self._set(parser_workers=n)

    def max_concurrent_pipelines(self, n: int) -> CrawlBuilder:
        return self._set(max_concurrent_pipelines=n)

    def channel_capacity(self, n: int) -> CrawlBuilder:
        return self._set(channel_capacity=n)

    def max_rounds(self, n: int) -> CrawlBuilder:
        return self._set(max_rounds=n)

    def max_pending(self, n: int | None) -> CrawlBuilder:
        return self._set(max_pending=n)

    def round_ms(self, n: int) -> CrawlBuilder:
        return self._set(round_ms=n)

    def sink(self, write: Callable[[DataFrame], None] | None) -> CrawlBuilder:
        """What gets the items at the end; None: nothing. Without pipelines the default is the console."""
        self._sink, self._silent = write, write is None
        return self

    def spider_state(self, **aggregates: Column) -> CrawlBuilder:
        """Named aggregates over all items, which the result and the snapshots hold."""
        self._state |= aggregates
        return self

    def downloader(self, fetch: Callable[[DataFrame], DataFrame]) -> CrawlBuilder:
        self._fetch = fetch
        return self

    def add_middleware(self, step: Step) -> CrawlBuilder:
        self._steps.append(step)
        return self

    def add_pipeline(self, pipeline: Pipeline) -> CrawlBuilder:
        self._pipelines.append(pipeline)
        return self

    def with_checkpoint_path(self, path: str) -> CrawlBuilder:
        self._path = path
        return self

    def with_checkpoint_interval(self, rounds: int) -> CrawlBuilder:
        self._interval = rounds
        return self

    def build(self) -> Crawl:
        self._config.validate()
        if self._parse is None or self._fetch is None:
            raise ConfigurationError("a crawl needs a parse function and a downloader")
        names = [p.name for p in self._pipelines]
        if len(set(names)) < len(names):
            raise ConfigurationError("pipelines need names of their own")
        sink = self._sink if self._sink is not None or self._silent or self._pipelines else sinks.console
        return Crawl(self._config, self._parse, self._fetch, tuple(self._steps), tuple(self._pipelines), self._path, self._interval, sink, dict(self._state))


def page_crawl(pages: DataFrame) -> CrawlBuilder:
    """A crawl of the pages table: ids are fetched from it, titles are items, links are
    resolved by :func:`spindrift.sources.web.synthetic_target`."""
    total = pages.agg(F.count("*").alias("n"))
    store = pages.select(F.col("page_id").alias("__k"), "url", "html", F.lit(200).alias("status"), F.octet_length("html").cast("bigint").alias("bytes"), F.lit(False).alias("cached"))

    def fetch(requests: DataFrame) -> DataFrame:
        return requests.join(store, requests.id == store["__k"], "left").drop("__k")

    def parse(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
        as_pages = fetched.select(F.col("id").alias("page_id"), "html")
        found = web.links(as_pages).crossJoin(F.broadcast(total))
        return web.titles(as_pages), found.select(web.synthetic_target(F.col("href"), F.col("n")).alias("id"))

    return CrawlBuilder(parse).downloader(fetch).sink(None)
