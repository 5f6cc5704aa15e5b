"""Alerts on runs that fall silent, as rows of a stream.

Each unit of work is a small state machine with a processing-time timer.  Its
events are beats: a status, how many rows it has written, and when.  It is

    running    rows still come in, or a status of activity
    stalled    no new beat within the time allowed: the timer alone says so
    complete   the expected rows are there, or its status says it is done
    failed     its status says so

and every change of this phase is one row, with what raised it.  A beat that
is older than the newest one seen changes nothing, a repeated one neither, so
late and out-of-order rows and files read twice raise no alert.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_STATE = StructType([StructField("phase", StringType()), StructField("status", StringType()), StructField("newest", LongType()), StructField("rows", LongType()), StructField("expected", LongType()), StructField("heard", LongType())])
_ALERTS = "unit string, before string, phase string, reason string, rows long, expected long, silent_s double, at timestamp"
DONE, FAILED = ("complete", "done"), ("failed", "error")


class Watch(StatefulProcessor):
    """The state machine of a unit; its state is dropped ``keep_s`` after it has ended."""

    def __init__(self, stall_s: float, keep_s: float):
        self.stall_ms, self.keep_ms = int(stall_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("unit", _STATE)

    def close(self) -> None:
        pass

    def _alert(self, key: tuple, now: int, before: str | None, s: dict, reason: str) -> tuple:
        return key[0], before, s["phase"], reason, s["rows"], s["expected"], (now - s["heard"]) / 1000, pd.Timestamp(now, unit="ms")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["unit", "before", "phase", "reason", "rows", "expected", "silent_s", "at"])
        return out.astype({"rows": "Int64", "expected": "Int64"})

    def _set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.state.get() if self.state.exists() else None
        s = dict(zip(_STATE.names, held)) if held else {"phase": None, "status": None, "newest": None, "rows": 0, "expected": None, "heard": now}
        beats = pd.concat(list(rows)).drop_duplicates().sort_values(["at_ms", "rows"], kind="stable")  # the beats of one unit and one trigger
        alerts, heard = [], False
        for b in beats.itertuples(index=False):
            if b.at_ms is None or (s["newest"] is not None and b.at_ms < s["newest"]):
                continue
            n = s["rows"] if pd.isna(b.rows) else max(s["rows"], int(b.rows))
            same = s["newest"] == b.at_ms and b.status == s["status"] and n == s["rows"]
            if same:
                continue
            heard, s["newest"], s["status"], s["rows"] = True, int(b.at_ms), b.status, n
            s["expected"] = s["expected"] if pd.isna(b.expected) else int(b.expected)
            ended = s["expected"] is not None and n >= s["expected"]
            phase, reason = ("failed", "status") if b.status in FAILED else ("complete", "status") if b.status in DONE else ("complete", "all rows") if ended else ("running", "beat")
            if phase != s["phase"]:
                before, s["phase"] = s["phase"], phase
                alerts.append(self._alert(key, now, before, s, reason))
        if heard:
            s["heard"] = now
            self._set_timer(now + (self.stall_ms if s["phase"] == "running" else self.keep_ms))
        if s["phase"] is not None:
            self.state.update(tuple(s[n] for n in _STATE.names))
        yield self._frame(alerts)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        s = dict(zip(_STATE.names, self.state.get()))
        if s["phase"] == "running":
            s["phase"] = "stalled"
            self.state.update(tuple(s[n] for n in _STATE.names))
            yield self._frame([self._alert(key, now, "running", s, "silence")])
        elif s["phase"] in ("complete", "failed"):
            self.state.clear()
            yield self._frame([])


def watched(beats: DataFrame, stall_s: float, keep_s: float = 86_400.0) -> DataFrame:
    """unit, before, phase, reason, rows, expected, silent_s, at: a row for each change of a unit's phase (append mode).

    ``beats`` (unit, status, rows, expected, at) is a stream; rows and expected
    may be null.  Beats with a null unit or time are left out.  A trigger
    without new beats still lets timers fire, so give the query a processing
    time trigger.  Needs the RocksDB state store (see :func:`state_store`).
    """
    rows = beats.filter("unit IS NOT NULL AND at IS NOT NULL").select("unit", "status", F.col("rows").cast("long").alias("rows"), F.col("expected").cast("long").alias("expected"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))
    return rows.groupBy("unit").transformWithStateInPandas(Watch(stall_s, keep_s), StructType.fromDDL(_ALERTS), "append", "processingTime")


def state_store(spark) -> None:
    """Let the session's streams keep state in RocksDB, which timers and state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def open_issues(alerts: DataFrame) -> DataFrame:
    """unit, phase, reason, since: units whose last alert is a stall or a failure, over a table of alerts."""
    last = alerts.groupBy("unit").agg(F.max_by(F.struct("phase", "reason", "at"), F.struct("at", "phase")).alias("l"))
    return last.filter(F.col("l.phase").isin("stalled", "failed")).select("unit", "l.phase", "l.reason", F.col("l.at").alias("since"))


def issue_changes(before: DataFrame, now: DataFrame, keys: tuple[str, ...] = ("id", "severity")) -> DataFrame:
    """id, change: issues that are new, whose severity changed, or that are gone between two censuses of (id, severity)."""
    key, level = keys
    a, b = before.select(F.col(key).alias("id"), F.col(level).alias("was")), now.select(F.col(key).alias("id"), F.col(level).alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "cleared").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "id", "full").select("id", change.alias("change")).filter("change IS NOT NULL")
