"""Sessions as a process: started by the first event, updated, summarised at checkpoints, ended by their user or by idleness.

One step function makes the rows of both forms. The stream form keeps a key's open session in state with a timer at its idle bound, so a session ends
although nothing follows; the batch form reads each key's rows in time order in one pass and holds one open session.

Events are (key, ts, event_id, kind, text, file). Any event starts a session where none is open. ``prompt`` gives an automatic session its goal,
``checkpoint`` writes a summary entry, ``end`` ends the session; a file counts as modified. A session idle for longer than the bound ends by itself, and
the next event starts a new one. Null keys are a key of their own, events without time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# fixed values: idle bound, goal of an automatic session, files that a summary names, texts and tags
IDLE_SECONDS, AUTOMATIC, NAMED_FILES = 1800, "Auto-started session", 5
ROWS = "key string, row string, at timestamp, started_at timestamp, status string, goal string, summary string, n_files long, files array<string>, tags array<string>"
_STATE = "started long, last long, goal string, files array<string>"


@dataclass
class Open:
    started: int
    last: int
    goal: str = AUTOMATIC
    files: dict[str, None] = field(default_factory=dict)


def _row(key, row: str, at: int, s: Open, status: str, summary: str | None = None, tags: list[str] | None = None) -> dict:
    # an automatic goal is never kept as an outcome
    goal = s.goal if row == "start" or s.goal != AUTOMATIC else None
    return {
        "key": key, "row": row, "at": at, "started_at": s.started, "status": status, "goal": goal, "summary": summary, "n_files": len(s.files),
        "files": list(s.files)[:NAMED_FILES], "tags": tags or [],
    }


def _closed(key, s: Open, at: int, summary: str) -> list[dict]:
    entry = _row(key, "entry", at, s, "completed", summary, ["session-summary", "session-end", str(key)])
    return [_row(key, "end", at, s, "completed", summary), entry]


def expire(key, s: Open, idle: int) -> list[dict]:
    """Rows of a session that idleness ends, dated at its bound."""
    named = f"{len(s.files)} file(s) modified: {', '.join(list(s.files)[:NAMED_FILES])}." if s.files else "No file changes were tracked."
    return _closed(key, s, s.last + idle, f"Auto-expired after {idle // 60_000_000} minutes of inactivity. {named}")


def advance(key, s: Open | None, ts: int, kind: str, text: str | None, file: str | None, idle: int) -> tuple[Open | None, list[dict]]:
    """One event: the session that is open after it, and the rows that it makes. Times are microseconds."""
    out: list[dict] = []
    if s is not None and ts - s.last > idle:
        out += expire(key, s, idle)
        s = None
    if s is None:
        s = Open(ts, ts)
        out.append(_row(key, "start", ts, s, "active"))
    s.last = max(s.last, ts)
    if file:
        s.files.setdefault(file)
    if kind == "prompt" and text and s.goal == AUTOMATIC:
        s.goal = text
    if kind == "checkpoint":
        out.append(_row(key, "entry", ts, s, "active", text, ["session-summary", "session-checkpoint", str(key)]))
    if kind == "end":
        out += _closed(key, s, ts, text or "")
        s = None
    return s, out


def _frame(rows: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
    for c in ("at", "started_at"):
        made[c] = pd.to_datetime(made[c].astype("int64"), unit="us")
    return made


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def session_rows(events: DataFrame, now_micros: int | None = None, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Rows of all sessions; those still open are ended by idleness if their bound lies before ``now_micros``."""
    idle = idle_seconds * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s, begun = None, None, False
        for pdf in frames:
            out: list[dict] = []
            for k, ts, kind, text, file in zip(map(_plain, pdf["key"]), _micros(pdf["ts"]), pdf["kind"], map(_plain, pdf["text"]), map(_plain, pdf["file"]), strict=True):
                if begun and k != key:
                    out += expire(key, s, idle) if s is not None and now_micros is not None and s.last + idle < now_micros else []
                    s = None
                key, begun = k, True
                s, more = advance(k, s, ts, kind, text, file, idle)
                out += more
            yield _frame(out)
        if s is not None and now_micros is not None and s.last + idle < now_micros:
            yield _frame(expire(key, s, idle))

    dealt = events.where("ts is not null").select(F.col("key").cast("string"), "ts", "event_id", "kind", "text", "file").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return dealt.mapInPandas(run, ROWS)


class SessionProcess(StatefulProcessor):
    """The stream form of one key: its open session in state, and a timer at its idle bound."""

    def __init__(self, idle_seconds: int = IDLE_SECONDS):
        self.idle = idle_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", _STATE)

    def _load(self) -> Open | None:
        if not self.held.exists():
            return None
        started, last, goal, files = self.held.get()
        return Open(started, last, goal, dict.fromkeys(files))

    def _save(self, s: Open | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s is None:
            self.held.clear()
            return
        self.held.update((s.started, s.last, s.goal, list(s.files)))
        # past the bound: an event exactly at the bound still belongs to the session
        self.handle.registerTimer((s.last + self.idle) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        s, out = self._load(), []
        for ts, kind, text, file in zip(_micros(pdf["ts"]), pdf["kind"], map(_plain, pdf["text"]), map(_plain, pdf["file"]), strict=True):
            s, more = advance(key[0], s, ts, kind, text, file, self.idle)
            out += more
        self._save(s)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s is not None:
            self._save(None)
            yield _frame(expire(key[0], s, self.idle))

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, lateness: str = "1 minute", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """The same rows from a stream; needs the RocksDB state store provider.

    Within a micro-batch a key's events are put in time order; an event that comes a batch too late extends its session but is not moved before what was told. A row
    is told once its event is read, an end by idleness once the watermark passes the bound.
    """
    timed = events.where("ts is not null").withColumn("key", F.col("key").cast("string")).withWatermark("ts", lateness)
    return timed.groupBy("key").transformWithStateInPandas(SessionProcess(idle_seconds), ROWS, "Append", "EventTime")
