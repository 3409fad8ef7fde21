"""Stateful review logs across restarts, and claims under replays and races."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.sources.versions import Conflict
from corvane.streaming import claims as K
from corvane.streaming import review_state as R

EVENT = "run_id string, candidate_id string, decision string, reviewed_at timestamp, arrived long"
DAY = datetime(2024, 1, 1)


def events(rng, n, first=0):
    for i in range(first, first + n):
        at = DAY + timedelta(minutes=i + rng.randint(-6, 6), microseconds=rng.randint(0, 3))
        yield (f"r{rng.randint(0, 3)}", rng.choice(("a", "b", "c", None) if i % 17 == 0 else ("a", "b", "c")), rng.choice(("approve", "hold", "reject")), at, i)


def put(spark, rows, folder):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def logged(df):
    return sorted((r.kind, r.run_id, str(r.candidate_id), r.decision, str(r.reviewed_at), r.arrived, r.sequence or 0, r.reason or "") for r in df.collect())


def test_log_over_restarts_is_the_log_of_the_whole(spark, tmp_path):
    rng = random.Random(8)
    rows = list(events(rng, 240))
    rows[100] = (*rows[100][:3], None, 100)
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    for start in (0, 90, 170):
        put(spark, rows[start : {0: 90, 90: 170, 170: 240}[start]], source)
        R.run_review_log(spark.readStream.schema(EVENT).parquet(source), out, mark)
    R.run_review_log(spark.readStream.schema(EVENT).parquet(source), out, mark)  # nothing new
    got = spark.read.parquet(out)
    want = R.review_log_of(spark.createDataFrame(rows, EVENT))
    assert logged(got) == logged(want)
    assert {r.reason for r in got.collect()} == {None, "earlier_than_last", "incomplete"}
    first = got.filter("kind = 'accepted'").orderBy("arrived").first()
    micros = int(first.reviewed_at.timestamp() * 1e6 + 0.5) if first.reviewed_at.tzinfo else round((first.reviewed_at - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert first.event_id == R.event_identity(first.run_id, first.candidate_id, first.decision, 1, micros)
    assert got.filter("kind = 'accepted'").select("event_id").distinct().count() == got.filter("kind = 'accepted'").count()
    # What the state says is what the log says.
    latest = got.filter("kind = 'accepted'").groupBy("run_id", "candidate_id").agg(F.max_by(F.struct("decision", "sequence"), "sequence").alias("l"))
    state = R.latest_from_state(spark, mark)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, latest.select("run_id", "candidate_id", "l.decision", "l.sequence").collect()))


def test_reminders(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    at = lambda minutes: DAY + timedelta(minutes=minutes)
    batches = [
        [("r", "a", "hold", at(0), 0), ("r", "b", "hold", at(1), 1)],
        [("r", "b", "approve", at(5), 2)],
        [("r", "c", "approve", at(60), 3)],
        [("r", "c", "approve", at(61), 4)],
    ]
    for rows in batches:
        put(spark, rows, source)
        R.run_review_log(spark.readStream.schema(EVENT).parquet(source), out, mark, remind_after=600)
    got = [(r.kind, r.candidate_id) for r in spark.read.parquet(out).filter("kind = 'reminder'").collect()]
    assert got == [("reminder", "a")]


class Calls:
    """A state that counts what is asked of it."""

    def __init__(self):
        self.value, self.held, self.calls, self.timers = None, {}, 0, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def updateValue(self, key, value):
        self.held[key], self.calls = value, self.calls + 1

    def registerTimer(self, at):
        self.timers.append(at)


def test_state_is_written_by_candidate_not_by_event():
    """2,001 calls for the events of a run before."""
    import pandas as pd

    rows = [(f"c{i % 5}", "hold" if i % 7 == 0 else "reject", DAY + timedelta(seconds=i // 100), i) for i in range(2000)]
    columns = ["candidate_id", "decision", "reviewed_at", "arrived"]
    log, state = R.ReviewLog(60.0), Calls()
    log.init(state)
    out = pd.concat(log.handleInputRows(("r",), iter([pd.DataFrame(rows[1000:], columns=columns), pd.DataFrame(rows[:1000], columns=columns)]), None))
    assert out["sequence"].tolist() == list(range(1, 2001)) and out["arrived"].tolist() == list(range(2000))
    assert state.calls == 6 and len(state.timers) == 20 and state.value[0] == 2000
    assert {k: v[1] for k, v in state.held.items()} == {(f"c{i}",): 1996 + i for i in range(5)}
    late = [("c0", "hold", DAY, 2000), (None, "hold", DAY, 2001), ("c9", "hold", DAY + timedelta(days=1), 2002), ("c8", "hold", None, 2003)]
    out = pd.concat(log.handleInputRows(("r",), iter([pd.DataFrame(late, columns=columns)]), None))
    assert out["reason"].tolist() == ["earlier_than_last", "incomplete", None, "incomplete"]
    assert out["sequence"].tolist() == [pd.NA, pd.NA, 2001, pd.NA] and out["event_id"].notna().tolist() == [False, False, True, False]


JOBS = [("j1", "queued", 1), ("j2", "queued", 4), ("j3", "running", 2), ("j4", "queued", 1)]


def jobs(spark):
    return lambda: spark.createDataFrame(JOBS, "job_id string, status string, revision long")


def wanted(spark, *rows):
    return spark.createDataFrame([(j, c, DAY + timedelta(minutes=m)) for j, c, m in rows], "job_id string, claimer string, claimed_at timestamp")


def held(log):
    return {r.job_id: (r.status, r.revision, r.claimer) for r in log.state().collect()}


def test_claims_are_won_once(spark, tmp_path):
    log = K.ClaimLog(spark, f"{tmp_path}/claims", jobs(spark))
    assert held(log)["j1"] == ("queued", 1, None)
    log.claim(wanted(spark, ("j1", "x", 5), ("j1", "y", 3), ("j3", "x", 1), ("none", "x", 1), (None, "x", 1)), "s", 0)
    state = held(log)
    assert state == {"j1": ("running", 2, "y"), "j2": ("queued", 4, None), "j3": ("running", 2, None), "j4": ("queued", 1, None)}
    # A replay, even with other rows, changes nothing; a later batch takes only what is free.
    assert log.claim(wanted(spark, ("j2", "x", 1)), "s", 0) is None and held(log) == state
    log.claim(wanted(spark, ("j1", "z", 0), ("j2", "z", 9)), "s", 1)
    assert held(log)["j1"] == ("running", 2, "y") and held(log)["j2"] == ("running", 5, "z")
    assert log.claim(wanted(spark, ("j4", "w", 9)), "other stream", 0).about["batches"] == {"s": 1, "other stream": 0}


def test_race(spark, tmp_path, monkeypatch):
    """A claimer that looked before another published looks again and loses."""
    log = K.ClaimLog(spark, f"{tmp_path}/claims", jobs(spark))
    rival = K.ClaimLog(spark, f"{tmp_path}/claims", jobs(spark))
    plain, calls = log.claims, []

    def slow(upto=None):
        if not calls:
            calls.append(1)
            rival.claim(wanted(spark, ("j1", "rival", 9)), "rival", 0)
        return plain(upto)

    monkeypatch.setattr(log, "claims", slow)
    log.claim(wanted(spark, ("j1", "late", 1), ("j2", "late", 1)), "late", 0)
    monkeypatch.undo()
    assert held(log)["j1"] == ("running", 2, "rival") and held(log)["j2"] == ("running", 5, "late")
    assert log.claims().groupBy("job_id").count().filter("count > 1").count() == 0
    monkeypatch.setattr(rival.versions, "publish", lambda *a, **k: (_ for _ in ()).throw(Conflict("always")))
    with pytest.raises(Conflict, match="attempts"):
        rival.claim(wanted(spark, ("j4", "rival", 1)), "rival", 1, attempts=2)


def test_stream_of_claims(spark, tmp_path):
    log = K.ClaimLog(spark, f"{tmp_path}/claims", jobs(spark))
    source, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    for rows in ([("j1", "x", 1)], [("j1", "y", 0), ("j2", "y", 2)]):
        wanted(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("job_id string, claimer string, claimed_at timestamp").parquet(source)
        stream.writeStream.foreachBatch(log.sink("s")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert held(log)["j1"][2] == "x" and held(log)["j2"][2] == "y"
