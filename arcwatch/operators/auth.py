"""Sign-in graph detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered


def hops(df: DataFrame, user: str, source: str, target: str, span: int) -> DataFrame:
    """Adjacent sign-ins of a user within the span, to two targets: the next one
    starts at this one's target, or neither is a sign-in of a host to itself."""
    w = ordered([user])
    out = df.withColumns({"next_id": F.lead("event_id").over(w), "next_us": F.lead("us").over(w), "next_source": F.lead(source).over(w), "next_target": F.lead(target).over(w)})
    gap = F.col("next_us") - F.col("us")
    pivot = F.col(target) == F.col("next_source")
    loose = (gap > 0) & (F.col(target) != F.col(source)) & (F.col("next_source") != F.col("next_target"))
    return out.filter((F.col(target) != F.col("next_target")) & gap.between(0, span) & (pivot | loose))


def privilege_jumps(df: DataFrame, source: str, target: str, privileged: Column) -> DataFrame:
    """A privileged sign-in after an ordinary one of the same source elsewhere."""
    before = ordered([source]).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_p", privileged).withColumn("from_target", F.last(F.when(~F.col("_p"), F.col(target)), ignorenulls=True).over(before))
    return out.filter(F.col("_p") & (F.col("from_target") != F.col(target))).drop("_p")


def new_edges(edges: DataFrame, baseline: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every edge that the baseline does not have."""
    unseen = edges.join(baseline.select(*keys).distinct(), keys, "left_anti")
    return unseen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
