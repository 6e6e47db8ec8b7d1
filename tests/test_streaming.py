"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from arcwatch.operators import lifecycle, windows
from arcwatch.sources import logs
from arcwatch.streaming import telemetry

START = datetime(2024, 3, 5, tzinfo=timezone.utc)


@pytest.fixture
def feed(spark, tmp_path):
    def put(name, events):
        lines = []
        for i, (vm, seconds, kind, *rest) in enumerate(events):
            more = rest[0] if rest else {}
            ts = START + timedelta(seconds=seconds)
            lines.append(json.dumps({"vm_id": vm, "ts": ts.isoformat(), "event_type": kind, "agent_id": vm, "nonce": f"{name}{i}", "counter": i, "received": ts.isoformat(), "interval_s": 5.0} | more))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))

    put.path = str(tmp_path / "in")
    put.check = str(tmp_path / "check")
    return put


def drain(stream, feed, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{feed.check}-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


EVENTS = [("a", 0, "entropy"), ("a", 10, "entropy"), ("a", 29, "shadow"), ("a", 30, "entropy"), ("a", 59, "entropy"), ("a", 61, "entropy"), ("b", 5, "crypto_spike"), ("b", 70, "velocity"), ("a", 62, "heartbeat")]


def test_alerts_are_throttled_as_in_batch(spark, feed):
    feed("one", EVENTS)
    stream = telemetry.weighed(telemetry.read_events(spark, feed.path))
    got = sorted((r["vm_id"], r["event_type"], r["us"]) for r in drain(telemetry.throttled_alerts(stream), feed, "alerts"))
    batch = telemetry.weighed(spark.read.schema(telemetry.SCHEMA).json(feed.path)).filter("delta >= 15").withColumn("us", F.unix_micros("ts")).withColumn("event_id", F.col("counter"))
    assert got == sorted((r["vm_id"], r["event_type"], r["us"]) for r in windows.throttle(batch, ["vm_id", "event_type"], 30 * windows.SECOND).collect())
    assert len([g for g in got if g[:2] == ("a", "entropy")]) == 3


def test_scores_roll_as_in_batch(spark, feed):
    feed("one", EVENTS)
    stream = telemetry.weighed(telemetry.read_events(spark, feed.path))
    got = sorted((r["vm_id"], r["us"], r["score"]) for r in drain(telemetry.rolling_scores(stream), feed, "scores"))
    batch = telemetry.weighed(spark.read.schema(telemetry.SCHEMA).json(feed.path)).withColumn("us", F.unix_micros("ts"))
    assert got == sorted((r["vm_id"], r["us"], r["score"]) for r in windows.rolling_score(batch, ["vm_id"], "delta", 60 * windows.SECOND, 200).collect())


def in_turns(feed, batches):
    """One file a micro-batch, in this order."""
    for i, events in enumerate(batches):
        feed(f"f{i}", events)
        os.utime(f"{feed.path}/f{i}.json", (1_700_000_000 + i * 60,) * 2)


def test_state_lasts_over_micro_batches(spark, feed):
    in_turns(feed, [EVENTS[i::3] for i in range(3)])
    events = telemetry.weighed(telemetry.read_events(spark, feed.path, files=1))
    batch = telemetry.weighed(spark.read.schema(telemetry.SCHEMA).json(feed.path)).withColumn("us", F.unix_micros("ts"))
    drain(telemetry.volume(events, "30 seconds", "1 hour"), feed, "volume", "update")
    got = {(r["start"].timestamp(), r["n"]) for r in spark.table("volume").groupBy("start").agg(F.max("n").alias("n")).collect()}
    want = {(r["start"].timestamp(), r["n"]) for r in batch.groupBy(F.window("ts", "30 seconds")).agg(F.count("*").alias("n")).select("window.start", "n").collect()}
    assert got == want
    # a late row counts the rows at or before it, as in batch
    scores = {(r["vm_id"], r["us"]): r["score"] for r in drain(telemetry.rolling_scores(events), feed, "turns")}
    expected = {(r["vm_id"], r["us"]): r["score"] for r in windows.rolling_score(batch, ["vm_id"], "delta", 60 * windows.SECOND, 200).collect()}
    assert scores.keys() == expected.keys() and all(scores[k] <= expected[k] for k in scores)


def test_late_rows_are_scored_at_their_place(spark, feed):
    in_turns(feed, [[("a", 100, "entropy"), ("a", 130, "entropy")], [("a", 90, "entropy")], [("a", 131, "entropy")]])
    got = drain(telemetry.rolling_scores(telemetry.weighed(telemetry.read_events(spark, feed.path, files=1))), feed, "late")
    assert [r["score"] for r in sorted(got, key=lambda r: r["us"])] == [40, 40, 80, 160]


def test_alerts_and_counters_over_micro_batches(spark, feed):
    in_turns(feed, [[("a", 0, "shadow")], [("a", 20, "shadow", {"counter": 0})], [("a", 31, "shadow", {"counter": 5})], [("a", 90_000, "shadow", {"counter": 2})], [("a", 90_010, "shadow", {"counter": 3})]])
    events = telemetry.weighed(telemetry.read_events(spark, feed.path, files=1))
    first = int(START.timestamp())
    assert sorted(r["us"] // 1_000_000 - first for r in drain(telemetry.throttled_alerts(events), feed, "raised")) == [0, 31, 90_000]
    assert sorted(r["counter"] for r in drain(telemetry.increasing_counters(events), feed, "again")) == [0, 5]


def test_lines_of_new_files_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    q = logs.stream_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["line"] for r in spark.table("lines").collect()} == {"one", "two"}


def test_replays_and_strangers_are_refused(spark, feed):
    feed("one", [("a", 0, "shadow"), ("a", 1, "shadow", {"nonce": "one0"}), ("a", 2, "shadow", {"agent_id": "b"}), ("a", 3, "shadow", {"received": (START + timedelta(seconds=200)).isoformat()}), ("a", 4, "shadow", {"counter": 0})])
    stream = telemetry.authenticated(telemetry.read_events(spark, feed.path))
    assert len(drain(stream, feed, "auth")) == 2
    counters = telemetry.increasing_counters(telemetry.read_events(spark, feed.path))
    assert sorted(r["counter"] for r in drain(counters, feed, "counters") if r["agent_id"] == "a") == [0, 1, 3]


def test_silence_is_reported_once(spark, feed):
    feed("one", [("a", s, "heartbeat") for s in (0, 5, 10, 40, 45)] + [("b", s, "heartbeat") for s in range(0, 200, 5)])
    got = drain(telemetry.silent_agents(telemetry.read_events(spark, feed.path)), feed, "silence")
    assert sorted((r["vm_id"], r["last_us"]) for r in got)[0] == ("a", int((START + timedelta(seconds=10)).timestamp() * 1e6))
    assert all(r["vm_id"] == "a" for r in got)


def test_failovers_with_returns_are_those_of_the_batch(spark, feed):
    """Losses in several micro-batches, out of order inside one; nodes return by
    timers of event time."""
    nodes = [("web", f"w{r}", r) for r in range(3)] + [("db", f"d{r}", r) for r in range(2)] + [("end", "e0", 0)]
    services = spark.createDataFrame(nodes, "service string, vm_id string, rank int")
    losses = [("w0", 0), ("w1", 30), ("w2", 40), ("d1", 45), ("w0", 100), ("d0", 130), ("d1", 131), ("w1", 400), ("w1", 405), ("w2", 460), ("w0", 460), ("d0", 900), ("w0", 905)]
    for batch in range(3):
        part = losses[batch * 5 : batch * 5 + 5][::-1]
        feed(f"{batch}", [(vm, s, "shadow", {"event_id": losses.index((vm, s))}) for vm, s in part])
    feed("3", [("e0", 5000, "shadow", {"event_id": 99})])
    feed("4", [("e0", 5001, "shadow", {"event_id": 100})])
    for n in range(5):  # the order of the files is that of their times
        os.utime(os.path.join(feed.path, f"{n}.json"), (1_700_000_000 + n, 1_700_000_000 + n))
    schema = telemetry.SCHEMA + ", event_id long"
    cure = 60 * windows.SECOND
    stream = telemetry.failover_log(telemetry.read_events(spark, feed.path, schema, files=1), services, cure, late="1 second")
    got = [tuple(r) for r in drain(stream, feed, "failovers") if r["service"] != "end"]
    batch = spark.read.schema(schema).json(feed.path).withColumn("us", F.unix_micros("ts"))
    want = [tuple(r) for r in lifecycle.failover_log(batch.select("vm_id", "us", "event_id"), services, cure).collect() if r["service"] != "end"]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) == 26
    assert {r[-1] for r in want} == {"HEALTHY", "DEGRADED", "NO_STANDBY", "RESTORED"}
