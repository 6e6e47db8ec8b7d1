"""State over ordered rows: alerts, services that fail over, spikes of
encryption, password sprays; and the measures of a replay."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy
from .sweeps import Measure, exact, in_range, value_before
from .windows import SECOND, fold, ordered, throttle

# -- fixed values ---------------------------------------------------------------------
TITLES = {
    "crypto_spike": "Ransomware cryptographic spike",
    "entropy": "High-entropy file encryption",
    "shadow": "Backup / shadow-copy destruction",
    "velocity": "File-modification velocity spike",
    "network": "Suspicious outbound connection (possible C2)",
    "agent_silence": "Security agent silenced (possible tamper)",
}
ACTION_STATUS = {"acknowledge": "ACKNOWLEDGED", "escalate": "ESCALATED", "close": "CLOSED", "false_positive": "FALSE_POSITIVE"}
STATUSES = ["OPEN", "ACKNOWLEDGED", "ESCALATED", "CLOSED", "FALSE_POSITIVE"]
# -------------------------------------------------------------------------------------


def alert_title(event_type: Column, reason: Column) -> Column:
    shell = F.when(reason == "web_server_spawned_shell", "Web server spawned a shell (web shell / RCE)").otherwise("Execution from suspicious path")
    return F.when(event_type == "process", shell).otherwise(F.coalesce(taxonomy.lookup(event_type, TITLES), F.concat(event_type, F.lit(" event"))))


def alert_states(actions: DataFrame, alert: str = "alert_id", us: str = "us", tie: str = "event_id") -> DataFrame:
    """status, assignee, last clock and number of actions of each alert from
    its log (alert_id, us, action, detail).

    acknowledge, escalate, close and false_positive set the status whatever it
    was; assign names the assignee, and acknowledges an alert that is open; a
    note changes nothing.  As assign acts on an open alert alone, the status is
    that of the last setting action, or ACKNOWLEDGED after an assignment.
    """
    order = F.struct(us, tie)
    status = taxonomy.lookup(F.col("action"), ACTION_STATUS)
    setting = F.when(status.isNotNull(), order)
    assigned = F.col("action") == "assign"
    out = actions.groupBy(alert).agg(
        F.max_by(status, setting).alias("_set"), F.max(assigned).alias("_assigned"), F.max_by("detail", F.when(assigned, order)).alias("assignee"),
        F.max(us).alias("last_us"), F.count("*").alias("actions"),
    )
    known = F.coalesce("_set", F.when(F.col("_assigned"), "ACKNOWLEDGED"), F.lit("OPEN"))
    return out.select(alert, known.alias("status"), "assignee", "last_us", "actions")


def alert_measures(alerts: DataFrame) -> DataFrame:
    """One row over alerts (status, latency_ms): by status, open, share of false
    positives among those closed, mean latency."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    done = n["CLOSED"] + n["FALSE_POSITIVE"]
    return alerts.agg(
        F.count("*").alias("total"), *[c.alias(f"n_{s.lower()}") for s, c in n.items()],
        (n["OPEN"] + n["ACKNOWLEDGED"] + n["ESCALATED"]).alias("open"),
        F.coalesce(F.round(F.when(done > 0, 100.0 * n["FALSE_POSITIVE"] / done), 1), F.lit(0.0)).alias("false_positive_rate"),
        F.coalesce(F.round(F.avg("latency_ms"), 1), F.lit(0.0)).alias("mean_latency_ms"),
    )


def failovers(events: DataFrame, services: DataFrame, node: str = "vm_id", us: str = "us", tie: str = "event_id") -> DataFrame:
    """What every compromise of a node does to its service: role lost, node
    promoted, state of the service after it.

    events: (vm_id, us, event_id), compromises; services: (service, vm_id,
    rank), the first rank active.  A node is not healed between its events
    here, so it is lost once, at its first event: then the active node is the
    least rank not lost so far, and the events of a service follow from
    windows over its few nodes.
    """
    first = events.join(services, node).withColumn("_n", F.row_number().over(ordered([node], us, tie))).filter("_n = 1").drop("_n")
    by_time = ordered(["service"], us, tie)
    nodes = services.groupBy("service").agg(F.array_sort(F.collect_list("rank")).alias("_ranks"))
    names = services.groupBy("service").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col(node)))).alias("_names"))
    lost_before = F.collect_list("rank").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    rows = first.join(nodes, "service").join(names, "service").withColumn("_lost", lost_before)
    left = F.array_except("_ranks", "_lost")
    was_active = F.get(left, F.lit(0)) == F.col("rank")
    heir = F.get(F.array_except(left, F.array("rank")), F.lit(0))
    state = F.when(~was_active, "HEALTHY").when(heir.isNull(), "NO_STANDBY").otherwise("DEGRADED")
    return rows.select("service", node, us, tie, F.when(was_active, "ACTIVE").otherwise("STANDBY").alias("role_lost"), F.when(was_active, F.col("_names")[heir]).alias("promoted"), state.alias("state"))


ROLES = ["ACTIVE", "STANDBY", "CURING"]
STATES = ["HEALTHY", "DEGRADED", "NO_STANDBY", "RESTORED"]


class Pair:
    """A service's nodes by rank; the first is active.

    A compromised node is cured; if it was active, the first standby is
    promoted.  A cured node rejoins as standby, and a service that had lost one
    is restored if its active node is well.
    """

    def __init__(self, nodes: int, roles: list[int] | None = None, active: int = 0, state: int = 0):
        self.roles = roles if roles is not None else [0] + [1] * (nodes - 1)
        self.active, self.state = active, state

    def step(self, rank: int, healed: bool) -> tuple[int, int | None, int]:
        """(role before, rank promoted, state after)."""
        was, heir = self.roles[rank], None
        if healed:
            self.roles[rank] = 1
            if self.state in (1, 2) and self.roles[self.active] != 2:
                self.state = 3
            return was, None, self.state
        self.roles[rank] = 2
        if was == 0:
            heir = next((r for r, role in enumerate(self.roles) if role == 1), None)
            if heir is None:
                self.state = 2
            else:
                self.roles[heir], self.active, self.state = 0, heir, 1
        return was, heir, self.state


def failover_log(events: DataFrame, services: DataFrame, cure: int, node: str = "vm_id", us: str = "us", tie: str = "event_id") -> DataFrame:
    """What every compromise of a node, and its return ``cure`` later, does to
    its service: service, node, us, event_id, kind (compromised, rejoined), role
    before, node promoted, state after.

    events: (vm_id, us, event_id), compromises; services: (service, vm_id,
    rank), ranks from 0 without gaps.  A service's rows come in order as a
    stream (``windows``), so a task holds one service's roles.  At one clock
    those who return come first.
    """
    sizes = services.groupBy("service").agg(F.count("*").alias("_nodes"))
    lost = events.join(services, node).join(sizes, "service").select("service", "rank", "_nodes", F.col(us).alias("_us"), F.col(tie).alias("_id"), F.lit(False).alias("_healed"))
    moves = lost.unionByName(lost.withColumns({"_us": F.col("_us") + cure, "_healed": F.lit(True)}))
    # twice the clock, so that returns come before losses of the same clock
    moves = moves.withColumns({"_clock": 2 * F.col("_us") + (~F.col("_healed")).cast("int"), "_value": F.struct("rank", "_nodes", "_healed")})

    def start():
        pair = None

        def step(clock, number, value):
            nonlocal pair
            pair = pair or Pair(value["_nodes"])
            was, heir, state = pair.step(value["rank"], value["_healed"])
            return clock, number, value["rank"], was, -1 if heir is None else heir, state

        return step

    adds = {"_clock": pa.int64(), "_id": pa.int64(), "rank": pa.int64(), "_was": pa.int64(), "_heir": pa.int64(), "_state": pa.int64()}
    out = fold(moves, ["service"], "_value", adds, start, "_clock", "_id")
    names = services.select("service", F.col("rank").cast("long").alias("rank"), node)
    heirs = services.select("service", F.col("rank").cast("long").alias("_heir"), F.col(node).alias("promoted"))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.col(at).cast("int"))
    out = out.join(names, ["service", "rank"]).join(heirs, ["service", "_heir"], "left")
    return out.select(
        "service", node, F.expr("_clock div 2").alias(us), F.col("_id").alias(tie), F.when(F.col("_clock") % 2 == 0, "rejoined").otherwise("compromised").alias("kind"),
        pick(ROLES, "_was").alias("role_before"), "promoted", pick(STATES, "_state").alias("state"),
    )


def encryption_spikes(writes: DataFrame, keys: list[str], value: str = "entropy", window: int = 15 * SECOND, baseline: int = 300 * SECOND, least: int = 6, sigmas: float = 3.0, us: str = "us", tie: str = "event_id") -> DataFrame:
    """Rows on which a key's writes of the last window outnumber its rate before
    by so many deviations, with a mean entropy of 7 at least; after one, silent
    for a window."""
    one, known = F.lit(1).cast("long"), F.col(value).isNotNull().cast("long")
    measures = {"n_recent": Measure(window, one), "_all": Measure(baseline, one), "_sum": Measure(window, exact(F.col(value))), "_known": Measure(window, known)}
    rows = in_range(writes, keys, measures, us)
    rows = rows.withColumn("mean_entropy", F.try_divide(F.col("_sum").cast("double"), "_known")).drop("_sum", "_known")
    rate = (F.col("_all") - F.col("n_recent")) / (max(1.0, float(baseline - window)) / window)
    rows = rows.withColumn("rate", rate).withColumn("z", (F.col("n_recent") - F.col("rate")) / F.greatest(F.lit(1.0), F.sqrt(F.greatest("rate", F.lit(1.0)))))
    hits = rows.filter((F.col("n_recent") >= least) & (F.col("z") >= sigmas) & (F.col("mean_entropy") >= 7.0))
    # strictly more than a window after the last one
    return throttle(hits, keys, window + 1, us, tie).join(hits.select(*keys, us, tie, "n_recent", "rate", "z", "mean_entropy"), [*keys, us, tie])


def write_velocity(writes: DataFrame, keys: list[str], span: int = 30 * SECOND, least: int = 10, us: str = "us") -> DataFrame:
    """Rows on which a key has so many writes in the span."""
    return in_range(writes, keys, {"velocity": Measure(span, F.lit(1).cast("long"))}, us).filter(F.col("velocity") >= least)


def password_sprays(failures: DataFrame, source: str, account: str, span: int, accounts: int = 10, cv: float = 0.3, rows: int = 100, us: str = "us", tie: str = "event_id") -> DataFrame:
    """Sources whose failures reach many accounts in the span, either at
    regular gaps or in overwhelming number; first row of each."""
    before = value_before(failures, [source], us, "_before", us, tie)
    gap = F.col(us) - F.col("_before")
    # whole numbers throughout: squares of microseconds leave 64 bits
    square = gap.cast("decimal(38,0)") * gap
    measures = {"n_accounts": Measure(span, item=account), "n_rows": Measure(span, F.lit(1).cast("long")), "_gaps": Measure(span, gap.isNotNull().cast("long")), "_sum": Measure(span, gap), "_square": Measure(span, square.cast("decimal(38,0)"))}
    out = in_range(before, [source], measures, us)
    mean = F.try_divide("_sum", "_gaps")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_square").cast("double"), "_gaps") - mean * mean))
    out = out.withColumn("cv", F.try_divide(spread, mean)).drop("_before", "_gaps", "_sum", "_square")
    hits = out.filter((F.col("n_accounts") >= accounts) & ((F.col("cv") <= cv) | (F.col("n_rows") >= rows)))
    return hits.withColumn("_n", F.row_number().over(ordered([source], us, tie))).filter("_n = 1").drop("_n")


def replay_measures(cases: DataFrame) -> DataFrame:
    """Coverage, false positives and mean time to detect of replayed cases
    (attack, detected, latency_s)."""
    attacks, benign = F.count_if("attack"), F.count_if(~F.col("attack"))
    return cases.agg(
        (100.0 * F.count_if(F.col("attack") & F.col("detected")) / F.greatest(F.lit(1), attacks)).alias("coverage_pct"),
        (100.0 * F.count_if(~F.col("attack") & F.col("detected")) / F.greatest(F.lit(1), benign)).alias("false_positive_pct"),
        F.avg(F.when(F.col("attack") & F.col("detected"), F.col("latency_s"))).alias("mean_latency_s"),
    )
