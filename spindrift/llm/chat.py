"""Chat formatting with budgeted, turn-aligned windows.

Turns of a conversation are ordered by (turn, role, text), NULLs first. Prefix
sums of their token counts choose spans of whole turns that fit the budget. Each
window starts with the conversation's system turn, then repeats at most
``history`` turns before it (within ``history_budget`` tokens, and only as many as
leave room for the first new turn), then the new turns. Assistant turns that are
new are targets; system, user and repeated turns are masked, so every assistant
turn is a target exactly once.

Defined results
---------------
* A turn that doesn't fit beside the system turn gets a window of its own, whole,
  with ``over_budget`` true; nothing is ever cut.
* NULL text: empty text. NULL role: ``user``. NULL conv_id: one conversation.
* Only the leading run of system turns is retained; a later one is a normal turn.
  A conversation of system turns alone gives one window without targets.
* Repeated rows and ties of ``turn``: each row is a turn. Empty table: no rows.
  Other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import column, rows_of, table

BUDGET, HISTORY, HISTORY_BUDGET, OVERHEAD = 512, 2, 128, 4
#: A turn costs at least a token for so many bytes of UTF-8, whether or not it has spaces.
TOKEN_BYTES = 4

SCHEMA = "conv_id bigint, window_no int, first_pos int, last_pos int, n_history int, n_tokens bigint, over_budget boolean, text string, targets string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int32()), ("first_pos", pa.int32()), ("last_pos", pa.int32()), ("n_history", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("targets", pa.string())])


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}<|end|>\n"


class _Windows:
    """Windows of one conversation; holds no more than the open window and its history."""

    def __init__(self, conv: int | None, budget: int, history: int, history_budget: int) -> None:
        self.conv, self.budget, self.history, self.history_budget = conv, budget, history, history_budget
        self.system: list[str] = []
        self.system_cost = self.pos = self.number = 0
        self.past: list[tuple[int, str, str, int]] = []  # repeated and new turns of the open window
        self.recent: deque = deque(maxlen=history)
        self.start = self.cost = 0
        self.repeated = 0
        self.opened = False

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        if role == "system" and not self.opened and self.start == 0 and not self.past:
            self.system.append(render(role, text))
            self.system_cost += tokens
            self.pos += 1
            return
        if self.opened and self.cost + tokens > self.budget:
            yield self.close()
        if not self.opened:
            before = list(self.recent)
            used, kept = 0, 0
            for turn in reversed(before):
                if used + turn[3] > self.history_budget or self.system_cost + used + turn[3] + tokens > self.budget:
                    break
                used, kept = used + turn[3], kept + 1
            self.past = before[len(before) - kept :]
            self.repeated, self.cost, self.start, self.opened = kept, self.system_cost + used, self.pos, True
        self.past.append((self.pos, role, text, tokens))
        self.recent.append(self.past[-1])
        self.cost += tokens
        self.pos += 1

    def close(self) -> tuple:
        parts, spans, at = list(self.system), [], sum(map(len, self.system))
        for pos, role, text, _ in self.past:
            piece = render(role, text)
            if role == "assistant" and pos >= self.start:
                spans.append(f"{at + len(role) + 5}-{at + len(piece)}")
            parts.append(piece)
            at += len(piece)
        row = (self.conv, self.number, self.start, self.pos - 1, self.repeated, self.cost, self.cost > self.budget, "".join(parts), ",".join(spans))
        self.number += 1
        self.opened = False
        return row

    def end(self) -> Iterator[tuple]:
        if self.opened:
            yield self.close()
        elif self.system:
            yield (self.conv, 0, 0, self.pos - 1, 0, self.system_cost, self.system_cost > self.budget, "".join(self.system), "")


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET, overhead: int = OVERHEAD) -> DataFrame:
    """Training windows of the conversations, one row each.

    A turn costs its whitespace-separated words, or a token for each TOKEN_BYTES bytes
    if that is more (texts without spaces, links, code), plus ``overhead``. ``first_pos`` and
    ``last_pos`` are the span of new turns (places in the order, from 0); ``targets``
    lists the character spans of ``text`` to train on. One shuffle on conv_id; the
    sorted turns are then streamed, so a long conversation is never held whole.
    """
    turns = conversations.select(
        column(conversations, "conv_id", "bigint").alias("conv_id"), column(conversations, "turn", "bigint").alias("turn"),
        column(conversations, "role", "string").alias("role"), column(conversations, "text", "string").alias("text"),
    ).select("*", (F.coalesce(F.greatest(F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.ceil(F.octet_length("text") / F.lit(float(TOKEN_BYTES)))), F.lit(0)) + overhead).cast("bigint").alias("tokens"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def windows(batches):
        def rows() -> Iterator[tuple]:
            current: _Windows | None = None
            for conv, role, text, tokens in rows_of(batches, "conv_id", "role", "text", "tokens"):
                if current is None or conv != current.conv:
                    if current is not None:
                        yield from current.end()
                    current = _Windows(conv, budget, history, history_budget)
                yield from current.add(role if role is not None else "user", text or "", tokens)
            if current is not None:
                yield from current.end()

        kept: list[tuple] = []
        size = 0
        for row in rows():
            kept.append(row)
            size += len(row[7])
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), _ARROW, strict=True)], schema=_ARROW)
                kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return ordered.mapInArrow(windows, SCHEMA)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
    coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')), (octet_length(encode(coalesce(text, ''))) + {TOKEN_BYTES - 1}) // {TOKEN_BYTES}) + {OVERHEAD} AS tokens
  FROM conversations),
marked AS (
  SELECT *, min(CASE WHEN role <> 'system' THEN pos END) OVER (PARTITION BY conv_id) AS first_other FROM turns),
sysrow AS (
  SELECT conv_id, coalesce(sum(tokens) FILTER (pos < coalesce(first_other, 1000000000)), 0) AS sc, max(pos) AS last,
    coalesce(any_value(first_other), max(pos) + 1) AS f FROM marked GROUP BY conv_id),
summed AS (
  SELECT m.conv_id, pos, role, text, tokens, sum(tokens) OVER (PARTITION BY m.conv_id ORDER BY pos) AS p FROM marked m),
step AS (
  SELECT s.conv_id, 0 AS window_no, s.f AS start_pos, 0 AS hist, s.sc AS sc, s.last AS last FROM sysrow s WHERE s.f <= s.last
  UNION ALL
  SELECT q.conv_id, q.window_no + 1, q.nxt,
    CASE WHEN q.h2 AND {HISTORY} >= 2 THEN 2 WHEN q.h1 THEN 1 ELSE 0 END, q.sc, q.last
  FROM (
    SELECT e.*, a.tokens <= {HISTORY_BUDGET} AND e.sc + a.tokens + n.tokens <= {BUDGET} AS h1,
      a.tokens <= {HISTORY_BUDGET} AND e.sc + a.tokens + n.tokens <= {BUDGET} AND b.tokens IS NOT NULL AND b.pos >= e.f
        AND a.tokens + b.tokens <= {HISTORY_BUDGET} AND e.sc + a.tokens + b.tokens + n.tokens <= {BUDGET} AS h2
    FROM (
      SELECT st.conv_id, st.window_no, st.sc, st.last, sy.f,
        (SELECT min(x.pos) FROM summed x WHERE x.conv_id IS NOT DISTINCT FROM st.conv_id AND x.pos > st.start_pos
           AND st.sc + x.p - coalesce((SELECT y.p FROM summed y WHERE y.conv_id IS NOT DISTINCT FROM st.conv_id AND y.pos = st.start_pos - st.hist - 1), 0) > {BUDGET}) AS nxt
      FROM step st JOIN sysrow sy ON sy.conv_id IS NOT DISTINCT FROM st.conv_id) e
    JOIN summed n ON n.conv_id IS NOT DISTINCT FROM e.conv_id AND n.pos = e.nxt
    JOIN summed a ON a.conv_id IS NOT DISTINCT FROM e.conv_id AND a.pos = e.nxt - 1
    LEFT JOIN summed b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.pos = e.nxt - 2) q),
spans AS (
  SELECT *, coalesce(lead(start_pos) OVER (PARTITION BY conv_id ORDER BY window_no) - 1, last) AS end_pos FROM step
  UNION ALL
  SELECT conv_id, 0, 0, 0, sc, last, last FROM sysrow WHERE f > last),
pieces AS (
  SELECT w.conv_id, w.window_no, w.start_pos, w.end_pos, w.hist, t.pos, t.role, t.tokens,
    '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS piece
  FROM spans w JOIN sysrow s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN summed t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND (t.pos < s.f OR t.pos BETWEEN w.start_pos - w.hist AND w.end_pos)),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, window_no ORDER BY pos) AS upto FROM pieces)
SELECT conv_id, CAST(window_no AS INTEGER) AS window_no, CAST(any_value(start_pos) AS INTEGER) AS first_pos,
  CAST(any_value(end_pos) AS INTEGER) AS last_pos, CAST(any_value(hist) AS INTEGER) AS n_history,
  CAST(sum(tokens) AS BIGINT) AS n_tokens, sum(tokens) > {BUDGET} AS over_budget,
  string_agg(piece, '' ORDER BY pos) AS text,
  coalesce(string_agg(CAST(upto - length(piece) + length(role) + 5 AS BIGINT)::VARCHAR || '-' || CAST(upto AS BIGINT)::VARCHAR, ',' ORDER BY pos)
    FILTER (role = 'assistant' AND pos >= start_pos), '') AS targets
FROM placed GROUP BY conv_id, window_no
"""

QUERIES = {"op5_chat_windows": op5_chat_windows}
ORACLES = {"op5_chat_windows": ORACLE}
