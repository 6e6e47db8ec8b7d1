"""Behavioural baselines: every row is scored against the rows before it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sweeps import HOUR, sums_before, value_before
from .windows import ordered


def _before(keys: list[str], us: str = "us", tie: str = "event_id"):
    return ordered(keys, us, tie).rowsBetween(Window.unboundedPreceding, -1)


def login_time(df: DataFrame, entity: str, hour: str, least: int = 10, sigmas: float = 2.5) -> DataFrame:
    """Logins far from the circular mean of the entity's earlier hours."""
    angle = F.col(hour) * (2 * math.pi / 24)
    w = _before([entity])
    out = df.withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle)).withColumn("angle", angle)
    out = out.withColumns({"n_prior": F.count("*").over(w), "_mc": F.avg("_c").over(w), "_ms": F.avg("_s").over(w)})
    length = F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), F.sqrt(F.col("_mc") ** 2 + F.col("_ms") ** 2)))
    out = out.withColumn("spread", F.sqrt(-2 * F.log(length))).withColumn("_mean", F.atan2("_ms", "_mc"))
    diff = F.col("angle") - F.col("_mean")
    out = out.withColumn("distance", F.abs(F.atan2(F.sin(diff), F.cos(diff))))
    return out.filter((F.col("n_prior") >= least) & (F.col("distance") > sigmas * F.greatest("spread", F.lit(0.05)))).drop("_c", "_s", "_mc", "_ms", "_mean")


def running_sum(df: DataFrame, value: str, name: str, us: str = "us", tie: str = "event_id", width: int = HOUR, ties: int | None = None) -> DataFrame:
    """df with the sum of a value over all rows before each, in clock order.
    ties: for clocks that many rows share, such as dates, how wide a range of
    the tie is one task's."""
    return sums_before(df, [], {name: F.col(value)}, us, tie, width, ties)


def rare_items(df: DataFrame, entity: str, item: str, population: int = 3, share: float = 0.05) -> DataFrame:
    """An entity's first use of an item that few of the entities so far use.

    Of both, only first rows count, which are found by aggregation: what is left
    has one row an entity and item.
    """
    order = F.struct("us", "event_id")
    first = df.groupBy(entity, item).agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")
    first = first.withColumn("_e", (order == F.min(order).over(Window.partitionBy(entity))).cast("long"))
    out = sums_before(running_sum(first, "_e", "entities"), [item], {"users": F.lit(1).cast("long")})
    return out.filter((F.col("entities") >= population) & (F.col("users") <= share * F.col("entities"))).drop("_e")


def volume_outliers(df: DataFrame, entity: str, value: str, least: int = 8, keep: int = 500, limit: float = 5.0) -> DataFrame:
    """Values far above the median of the entity's last ones, in scaled median
    absolute deviations."""
    w = ordered([entity]).rowsBetween(-keep, -1)

    def middle(column):
        sorted_ = F.array_sort(column)
        n = F.size(sorted_)
        low, high = F.get(sorted_, F.floor((n - 1) / 2).cast("int")), F.get(sorted_, F.floor(n / 2).cast("int"))
        return (low + high) / 2

    out = df.withColumn("_v", F.collect_list(value).over(w)).withColumn("n_prior", F.size("_v")).filter(F.col("n_prior") >= least)
    out = out.withColumn("median", middle(F.col("_v"))).withColumn("_d", F.transform("_v", lambda v: F.abs(v - F.col("median"))))
    out = out.withColumn("_mad", middle(F.col("_d")) * 1.4826).withColumn("mad", F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(1.0))
    out = out.withColumn("mod_z", F.abs(F.col(value) - F.col("median")) / F.col("mad"))
    return out.filter((F.col("mod_z") > limit) & (F.col(value) > F.col("median"))).drop("_v", "_d", "_mad")


def rare_transitions(df: DataFrame, entity: str, item: str, overall: int = 20, least: int = 10, share: float = 0.01) -> DataFrame:
    """Steps from an entity's last item to the next that were rare before, and
    new to the entity.  Counts are of all entities' earlier steps."""
    order, one = F.struct("us", "event_id"), {"n": F.lit(1).cast("long")}
    steps = value_before(df, [entity], item, "prev").filter("prev is not null")
    # enough steps came before a row if it is after the ``overall``-th of all
    enough = steps.select("us", "event_id").orderBy("us", "event_id").limit(overall).agg(F.max(order).alias("_last"), F.count("*").alias("_first"))
    counted = sums_before(steps, ["prev"], {"n_prev": one["n"]})
    counted = sums_before(counted, ["prev", item], {"n_step": one["n"]})
    rare = (F.col("n_prev") >= least) & (F.col("n_step") <= share * F.col("n_prev"))
    found = counted.filter(rare).crossJoin(F.broadcast(enough)).filter((F.col("_first") >= overall) & (order > F.col("_last"))).drop("_last", "_first")
    own = [entity, "prev", item]
    new = steps.groupBy(*own).agg(F.min(order).alias("_own"))
    return found.join(new, own).filter(order == F.col("_own")).drop("_own")
