"""Telemetry as a stream: authentication, scores, throttled alerts, silence.

All clocks are event time.  State is one small row a key: the last emission,
the events of one window, or the last beat; keys spread over partitions, and a
key's state goes once the watermark has passed what it could still matter to.

Rows may come out of order within the watermark, in any micro-batch.  A late row
is scored by the rows at or before it, as in batch; scores that were already
given are not revised, and an alert already raised stands.  Rows later than the
watermark are dropped, which a batch run would not do.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import taxonomy
from ..operators import lifecycle

SCHEMA = "vm_id string, ts timestamp, event_type string, reason string, agent_id string, nonce string, counter long, received timestamp, interval_s double"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 1000) -> DataFrame:
    """Events of JSON files that appear under path, each file once, so many
    files a micro-batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def _keep(state: GroupState, until_us: float) -> None:
    """Let the state go once the watermark has passed this clock."""
    state.setTimeoutTimestamp(int(max(until_us / 1000, state.getCurrentWatermarkMs())) + 1)


def authenticated(events: DataFrame, skew_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """Events that are fresh, not replayed and from the sender they name."""
    fresh = F.abs(F.unix_micros("received") - F.unix_micros("ts")) <= skew_s * 1_000_000
    own = F.col("vm_id") == F.col("agent_id")
    return events.filter(fresh & own).withWatermark("ts", late).dropDuplicatesWithinWatermark(["agent_id", "nonce"])


def weighed(events: DataFrame) -> DataFrame:
    """Score, techniques and immediate response of each event; what the sender
    claims is not used."""
    kind, reason = F.col("event_type"), F.col("reason")
    return events.withColumns({"delta": taxonomy.event_weight(kind, reason), "techniques": taxonomy.event_techniques(kind, reason), "block": kind.isin(taxonomy.INSTANT_BLOCK)})


def increasing_counters(events: DataFrame, keep_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Events whose counter exceeds every earlier one of the agent; an agent is
    forgotten after a silence of ``keep_s``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        top, last = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "counter"], kind="stable")
        before = rows["counter"].cummax().shift(fill_value=top).clip(lower=top)
        kept = rows[rows["counter"] > before]
        last = max(last, int(rows["us"].max()))
        state.update((int(max(top, rows["counter"].max())), last))
        _keep(state, last + keep_s * 1e6)
        yield kept[["agent_id", "counter", "ts"]]

    timed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).select("agent_id", "counter", "ts", "us")
    return timed.groupBy("agent_id").applyInPandasWithState(run, "agent_id string, counter long, ts timestamp", "top long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def rolling_scores(events: DataFrame, window_s: int = 60, cap: int = taxonomy.SCORE_CAP, late_s: int = 600) -> DataFrame:
    """vm_id, ts, score and status after every event of the last window."""
    span, slack = window_s * 1_000_000, late_s * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        scores = []
        for us, delta in zip(rows["us"].tolist(), rows["delta"].tolist()):
            insort(held, (us, delta), key=lambda h: h[0])
            first, end = bisect_left(held, us - span, key=lambda h: h[0]), bisect_right(held, us, key=lambda h: h[0])
            scores.append(min(cap, sum(d for _, d in held[first:end])))
        # what a row as late as the watermark allows could still need
        held = held[bisect_left(held, held[-1][0] - span - slack, key=lambda h: h[0]) :]
        state.update(tuple(map(list, zip(*held))))
        _keep(state, held[-1][0] + span)
        yield pd.DataFrame({"vm_id": key[0], "us": rows["us"], "score": scores})

    timed = events.withWatermark("ts", f"{late_s} seconds").withColumn("us", F.unix_micros("ts")).select("vm_id", "ts", "us", "delta")
    scored = timed.groupBy("vm_id").applyInPandasWithState(run, "vm_id string, us long, score int", "us array<long>, delta array<int>", "append", GroupStateTimeout.EventTimeTimeout)
    return scored.withColumn("status", taxonomy.threat_status(F.col("score")))


def throttled_alerts(events: DataFrame, quiet_s: int = 30, least: int = 15, late: str = "10 minutes") -> DataFrame:
    """Alerts at least ``quiet_s`` after the last one *raised* for the machine
    and type; what is held back does not extend the silence."""
    quiet = quiet_s * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        raised = []
        for us in sorted(pd.concat(list(frames))["us"].tolist()):
            if last is None or us - last >= quiet:
                raised.append(us)
                last = us
        state.update((last,))
        _keep(state, last + quiet)
        yield pd.DataFrame({"vm_id": key[0], "event_type": key[1], "us": raised})

    timed = events.filter(F.col("delta") >= least).withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).select("vm_id", "event_type", "ts", "us")
    return timed.groupBy("vm_id", "event_type").applyInPandasWithState(run, "vm_id string, event_type string, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def silent_agents(events: DataFrame, factor: float = 3.0, late: str = "5 seconds") -> DataFrame:
    """One event for each silence longer than factor times the declared
    interval, when the watermark passes it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            beat, interval = state.get
            state.remove()
            yield pd.DataFrame({"vm_id": [key[0]], "last_us": [beat], "delta": [taxonomy.SCORE_WEIGHTS["agent_silence"]]})
            return
        beat, interval = state.get if state.exists else (None, None)
        gaps = []
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        for us, every in zip(rows["us"].tolist(), rows["interval_s"].tolist()):
            if beat is not None and us - beat > factor * interval * 1e6:
                gaps.append(beat)
            beat, interval = max(us, beat or us), every
        state.update((beat, interval))
        state.setTimeoutTimestamp(int(max(beat / 1000 + factor * interval * 1000, state.getCurrentWatermarkMs() + 1)) + 1)
        yield pd.DataFrame({"vm_id": key[0], "last_us": gaps, "delta": taxonomy.SCORE_WEIGHTS["agent_silence"]})

    beats = events.filter("event_type = 'heartbeat'").withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).select("vm_id", "ts", "us", "interval_s")
    return beats.groupBy("vm_id").applyInPandasWithState(run, "vm_id string, last_us long, delta int", "beat long, every double", "append", GroupStateTimeout.EventTimeTimeout)


def volume(events: DataFrame, bucket: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Events and score of each time bucket."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", bucket)).agg(F.count("*").alias("n"), F.sum("delta").alias("score")).select("window.start", "n", "score")


def failover_log(events: DataFrame, services: DataFrame, cure: int, late: str = "10 minutes") -> DataFrame:
    """``lifecycle.failover_log`` of a stream (vm_id, ts, event_id): a node's
    return is a timer of event time, set when it is lost.

    A service's returns that are due come before the next loss, or once the
    watermark has passed them.  Losses are taken in order within a micro-batch;
    one that is older than those of an earlier batch is taken last.  services is
    a table of few rows a service, joined as it is.
    """
    sizes = services.groupBy("service").agg(F.count("*").cast("int").alias("nodes"))
    named = services.groupBy("service").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int"), F.col("vm_id")))).alias("names"))
    rows = events.withWatermark("ts", late).join(services.select("service", "vm_id", F.col("rank").cast("int").alias("rank")), "vm_id").join(sizes, "service")
    out = "service string, rank int, us long, event_id long, kind string, role_before string, heir int, state string"
    kept = "roles array<int>, active int, state int, due array<struct<us:long,event_id:long,rank:int>>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lost = []
        if not state.hasTimedOut:
            frame = pd.concat(frames)
            clocks = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            lost = sorted(zip(clocks.tolist(), frame["event_id"].tolist(), frame["rank"].tolist(), frame["nodes"].tolist()))
        if state.exists:
            roles, active, now, due = state.get
            pair, due = lifecycle.Pair(len(roles), list(roles), active, now), [tuple(d) for d in due]
        else:
            pair, due = lifecycle.Pair(lost[0][3]), []
        found = []

        def move(us: int, number: int, rank: int, healed: bool) -> None:
            was, heir, after = pair.step(rank, healed)
            found.append((key[0], rank, us, number, "rejoined" if healed else "compromised", lifecycle.ROLES[was], heir, lifecycle.STATES[after]))

        def return_until(us: float) -> None:
            while due and due[0][0] <= us:
                at, number, rank = due.pop(0)
                move(at, number, rank, True)

        for us, number, rank, _ in lost:
            return_until(us)
            move(us, number, rank, False)
            insort(due, (us + cure, number, rank))
        return_until(state.getCurrentWatermarkMs() * 1000 - 1)
        state.update((pair.roles, pair.active, pair.state, due))
        if due:
            _keep(state, due[0][0])
        names = [f.split()[0] for f in out.split(", ")]
        yield pd.DataFrame(found, columns=names).astype({"heir": "Int32"})

    logged = rows.select("service", "rank", "nodes", "ts", "event_id").groupBy("service").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    named_rows = logged.join(named, "service")
    return named_rows.select("service", F.col("names")[F.col("rank")].alias("vm_id"), "us", "event_id", "kind", "role_before", F.when(F.col("heir").isNotNull(), F.col("names")[F.col("heir")]).alias("promoted"), "state")
