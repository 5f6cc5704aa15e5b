"""Streams of alerts: silence, recovery, repeats, late beats, the end of a unit."""

import json
import time

import pytest

from tallyframe.streaming import alerts, progress

BEAT = "unit string, status string, rows long, expected long, at timestamp"


class Stream:
    """Beats as files, one after another, and the alerts that they raise."""

    def __init__(self, spark, folder, stall_s, keep_s=3600.0):
        alerts.state_store(spark)
        self.spark, self.folder, self.n, self.sent = spark, folder / "in", 0, 0
        self.folder.mkdir()
        beats = spark.readStream.schema(BEAT).json(str(self.folder))
        self.name = f"alerts_{folder.name.replace('-', '_')}"
        self.query = alerts.watched(beats, stall_s, keep_s).writeStream.format("memory").queryName(self.name).outputMode("append").option("checkpointLocation", str(folder / "state")).trigger(processingTime="500 milliseconds").start()

    def send(self, *beats):
        self.n += 1
        hidden = self.folder / f".{self.n}"
        hidden.write_text("".join(json.dumps(dict(zip(("unit", "status", "rows", "expected", "at"), b))) + "\n" for b in beats))
        hidden.rename(self.folder / f"{self.n}.json")
        self.sent += sum(b[0] is not None and b[4] is not None for b in beats)  # the reader leaves out others
        until = time.time() + 60
        while sum(p.numInputRows for p in self.query.recentProgress) < self.sent:  # triggers for timers go on for ever
            assert time.time() < until and self.query.isActive, self.query.exception()
            time.sleep(0.2)

    def seen(self):
        rows = self.spark.table(self.name).orderBy("at", "unit").collect()
        return [(r.unit, r.before, r.phase, r.reason) for r in rows]

    def wait_for(self, *row, seconds=60):
        until = time.time() + seconds
        while row not in self.seen():
            assert time.time() < until and self.query.isActive, (row, self.seen(), self.query.exception())
            time.sleep(0.3)

    def stop(self):
        self.query.stop()


@pytest.fixture
def stream(spark, tmp_path):
    made = []

    def make(*args):
        made.append(Stream(spark, tmp_path, *args))
        return made[-1]

    yield make
    for s in made:
        s.stop()


def test_silence_raises_a_stall_and_a_beat_clears_it(stream):
    s = stream(4.0)
    s.send(("u", "running", 1, 9, "2024-01-01T00:00:00"), ("done", "complete", 9, 9, "2024-01-01T00:00:00"))
    s.wait_for("u", None, "running", "beat")
    s.wait_for("u", "running", "stalled", "silence")  # nothing was sent in between
    s.send(("u", "running", 2, 9, "2024-01-01T00:00:05"))
    s.wait_for("u", "stalled", "running", "beat")
    s.send(("u", "running", 9, 9, "2024-01-01T00:00:06"))
    s.wait_for("u", "running", "complete", "all rows")
    assert s.seen().count(("u", "running", "stalled", "silence")) >= 1
    assert [x for x in s.seen() if x[0] == "done"] == [("done", None, "complete", "status")]


def test_repeats_and_late_beats_raise_nothing(stream):
    s = stream(3600.0)
    s.send(("u", "running", 3, 9, "2024-01-01T00:01:00"), ("v", "failed", None, None, "2024-01-01T00:00:00"), (None, "running", 1, 1, "2024-01-01T00:00:00"), ("w", "running", 1, 1, None))
    s.send(("u", "running", 3, 9, "2024-01-01T00:01:00"), ("v", "failed", None, None, "2024-01-01T00:00:00"))  # both again
    s.send(("u", "failed", 1, 9, "2024-01-01T00:00:30"))  # late: what the unit was before
    s.send(("u", "failed", 4, 9, "2024-01-01T00:03:00"), ("u", "running", 3, 9, "2024-01-01T00:02:00"))  # out of order within a file
    assert sorted(s.seen(), key=str) == sorted([("u", None, "running", "beat"), ("u", "running", "failed", "status"), ("v", None, "failed", "status")], key=str)


def test_state_of_an_ended_unit_expires(stream):
    s = stream(3600.0, 2.0)
    s.send(("u", "complete", 1, 1, "2024-01-01T00:00:00"))
    time.sleep(6)
    s.send(("u", "running", 0, 5, "2023-01-01T00:00:00"))  # an older beat is a new unit now
    s.wait_for("u", None, "running", "beat")


def test_open_issues_and_their_changes(spark):
    rows = [("a", "stalled", "silence", 3), ("a", "running", "beat", 1), ("b", "stalled", "silence", 1), ("b", "running", "beat", 2), ("c", "failed", "status", 5)]
    table = spark.createDataFrame(rows, "unit string, phase string, reason string, at int")
    assert sorted(tuple(r) for r in alerts.open_issues(table).collect()) == [("a", "stalled", "silence", 3), ("c", "failed", "status", 5)]
    issues = lambda *x: spark.createDataFrame(list(x), "id string, severity string")
    got = alerts.issue_changes(issues(("x", "error"), ("y", "warning"), ("z", "error")), issues(("y", "error"), ("z", "error"), ("w", "warning")))
    assert sorted(tuple(r) for r in got.collect()) == [("w", "new"), ("x", "cleared"), ("y", "changed")]


def test_changes_are_in_order_across_chunks(spark, tmp_path):
    folder = tmp_path / "units"
    folder.mkdir()
    lines = [{"unit": "u", "view": "v", "status": "ab"[i // 15_000], "correct": None, "at": f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}"} for i in range(30_000)]
    (folder / "1.json").write_text("".join(json.dumps(x) + "\n" for x in reversed(lines)))  # more than one Arrow chunk, last first
    q = progress.changes(progress.read_units(spark, str(folder))).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("changed").collect()] == [("u", None, "a"), ("u", "a", "b")]
