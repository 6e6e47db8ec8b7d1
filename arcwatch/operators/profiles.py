"""Behaviour that is learnt once, saved, merged and scored against.

A profile is a set of small tables whose rows merge: the profile of two stretches
of time, one after the other, is that of both read in one run.

``times``     circular sums of an entity's hours: n, and the sums of cosine and sine
``items``     how often an entity used an item
``volumes``   an entity's last ``KEEP`` values
``steps``     how often an entity went from one item to the next
``ends``      an entity's first and last item, which make the step between two stretches

Nulls: rows without a clock are left out; a null item is an item for ``items``
and no step.  Ties of the clock go by the tie, everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sweeps import value_before

KEEP = 500
Profile = Mapping[str, DataFrame]


def _last(values: Column, keep: int) -> Column:
    """The last entries of an array of (us, tie, value), in order."""
    ordered = F.array_sort(values)
    return F.slice(ordered, F.greatest(F.lit(1), F.size(ordered) - keep + 1), F.lit(keep))


def learn(events: DataFrame, entity: str, hour: str, item: str, value: str, us: str = "us", tie: str = "event_id", keep: int = KEEP) -> dict[str, DataFrame]:
    """The profile of all rows."""
    rows = events.filter(F.col(us).isNotNull()).select(F.col(entity).alias("entity"), F.col(hour).cast("double").alias("hour"), F.col(item).alias("item"), F.col(value).cast("double").alias("value"), F.col(us).alias("us"), F.col(tie).alias("tie"))
    angle, order = F.col("hour") * (2 * math.pi / 24), F.struct("us", "tie")
    told = rows.filter("value is not null")
    return {
        "times": rows.filter("hour is not null").groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s")),
        "items": rows.groupBy("entity", "item").agg(F.count("*").alias("n")),
        "volumes": _recent(told, keep).groupBy("entity").agg(_last(F.collect_list(F.struct("us", "tie", "value")), keep).alias("recent")),
        "steps": _steps(value_before(rows, ["entity"], "item", "prev", tie="tie"), ["entity"]),
        "ends": rows.groupBy("entity").agg(F.min_by("item", order).alias("first"), F.min(order).alias("first_at"), F.max_by("item", order).alias("last"), F.max(order).alias("last_at")),
    }


def _recent(rows: DataFrame, keep: int) -> DataFrame:
    """At least an entity's last ``keep`` rows, and no more than a task keeps of
    them: ranks are cut before the shuffle, so a hot entity is not gathered."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("us"), F.desc("tie")))
    return rows.withColumn("_n", nth).filter(F.col("_n") <= keep).drop("_n")


def _steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.filter("prev is not null and item is not null").groupBy(*keys, "prev", "item").agg(F.count("*").alias("n"))


def merge(first: Profile, second: Profile, keep: int = KEEP) -> dict[str, DataFrame]:
    """The profile of two stretches, the second after the first."""
    both = {name: first[name].unionByName(second[name]) for name in first}
    ends = first["ends"].alias("a").join(second["ends"].alias("b"), F.col("a.entity").eqNullSafe(F.col("b.entity")))
    seam = ends.select("a.entity", F.col("a.last").alias("prev"), F.col("b.first").alias("item"), F.lit(1).cast("long").alias("n")).filter("prev is not null and item is not null")
    met = both["ends"]
    return {
        "times": both["times"].groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("n", "c", "s")]),
        "items": both["items"].groupBy("entity", "item").agg(F.sum("n").alias("n")),
        "volumes": both["volumes"].groupBy("entity").agg(_last(F.flatten(F.collect_list("recent")), keep).alias("recent")),
        "steps": both["steps"].unionByName(seam).groupBy("entity", "prev", "item").agg(F.sum("n").alias("n")),
        "ends": met.groupBy("entity").agg(F.min_by("first", "first_at").alias("first"), F.min("first_at").alias("first_at"), F.max_by("last", "last_at").alias("last"), F.max("last_at").alias("last_at")),
    }


def save(profile: Profile, path: str) -> None:
    """One Parquet table each, in a folder that must not hold a profile yet."""
    for name, rows in profile.items():
        rows.write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("times", "items", "volumes", "steps", "ends")}


def odd_hours(profile: Profile, events: DataFrame, entity: str, hour: str, least: int = 10, sigmas: float = 2.5) -> DataFrame:
    """Events far from the circular mean of what is known of their entity."""
    known = profile["times"].withColumnRenamed("entity", entity)
    length = F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("n")))
    diff = F.col(hour) * (2 * math.pi / 24) - F.atan2("s", "c")
    out = events.join(known.filter(F.col("n") >= least), entity).withColumn("spread", F.sqrt(-2 * F.log(length))).withColumn("distance", F.abs(F.atan2(F.sin(diff), F.cos(diff))))
    return out.filter(F.col("distance") > sigmas * F.greatest("spread", F.lit(0.05))).drop("n", "c", "s")


def new_items(profile: Profile, events: DataFrame, entity: str, item: str, population: int = 3, share: float = 0.05) -> DataFrame:
    """Distinct (entity, item) of the events that the profile lacks, where few of
    its entities use the item."""
    known = profile["items"]
    users = known.groupBy("item").agg(F.count("*").alias("users")).withColumnRenamed("item", "_item")
    entities = known.select("entity").distinct().agg(F.count("*").alias("entities"))
    unseen = events.select(F.col(entity).alias("_entity"), F.col(item).alias("_new")).distinct()
    unseen = unseen.join(known, F.col("_entity").eqNullSafe(known["entity"]) & F.col("_new").eqNullSafe(known["item"]), "left_anti")
    out = unseen.join(users, F.col("_new").eqNullSafe(F.col("_item")), "left").crossJoin(F.broadcast(entities)).withColumn("users", F.coalesce("users", F.lit(0)))
    return out.filter((F.col("entities") >= population) & (F.col("users") <= share * F.col("entities"))).select(F.col("_entity").alias(entity), F.col("_new").alias(item), "users", "entities")


def odd_volumes(profile: Profile, events: DataFrame, entity: str, value: str, least: int = 8, limit: float = 5.0) -> DataFrame:
    """Events far above the median of their entity's last values."""

    def middle(values: Column) -> Column:
        ordered, n = F.array_sort(values), F.size(values)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

    known = profile["volumes"].filter(F.size("recent") >= least).select(F.col("entity").alias(entity), F.col("recent.value").alias("_v"))
    known = known.withColumn("median", middle(F.col("_v"))).withColumn("_d", middle(F.transform("_v", lambda v: F.abs(v - F.col("median")))) * 1.4826)
    known = known.select(entity, "median", F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0).alias("mad"))
    out = events.join(known, entity).withColumn("mod_z", (F.col(value) - F.col("median")) / F.col("mad"))
    return out.filter(F.col("mod_z") > limit)


def new_steps(profile: Profile, events: DataFrame, entity: str, item: str, us: str = "us", tie: str = "event_id", overall: int = 20, least: int = 10, share: float = 0.01) -> DataFrame:
    """Events that follow another of their entity (the profile's last, for the
    first) by a step that is rare in the profile and new to the entity."""
    steps = profile["steps"]
    rows = value_before(events.filter(F.col(us).isNotNull()), [entity], item, "_before", us, tie)
    first = events.filter(F.col(us).isNotNull()).groupBy(F.col(entity).alias("_e")).agg(F.min(F.struct(us, tie)).alias("_first"))
    last = profile["ends"].select(F.col("entity").alias("_e"), F.col("last").alias("_last")).join(first, "_e")
    rows = rows.join(last, F.col(entity) == F.col("_e"), "left").drop("_e")
    begins = F.struct(us, tie) == F.col("_first")
    rows = rows.withColumn("prev", F.coalesce("_before", F.when(begins, F.col("_last")))).drop("_before", "_last", "_first").filter("prev is not null")
    total = steps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    from_prev = steps.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    of_step = steps.groupBy("prev", F.col("item").alias("_item")).agg(F.sum("n").alias("n_step"))
    own = steps.select(F.col("entity").alias(entity), "prev", F.col("item").alias("_item")).distinct()
    rows = rows.withColumn("_item", F.col(item)).join(own, [entity, "prev", "_item"], "left_anti")
    out = rows.join(from_prev, "prev").join(of_step, ["prev", "_item"], "left").withColumn("n_step", F.coalesce("n_step", F.lit(0))).crossJoin(F.broadcast(total))
    return out.filter((F.col("_all") >= overall) & (F.col("n_prev") >= least) & (F.col("n_step") <= share * F.col("n_prev"))).drop("_all", "_item")
