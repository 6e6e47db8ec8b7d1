"""The driver's tables, and events read as telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy
from ..operators.windows import clock

#: What the stand-in event types weigh and which tactic and severity they show.
WEIGHTS = {"error": 40, "purchase": 25, "signup": 15, "click": 5, "view": 0}
TACTICS = {"error": "Impact", "purchase": "Exfiltration", "signup": "Initial Access", "click": "Discovery", "view": "Unknown"}
LEVELS = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the clock in microseconds, the property k, weight, tactic
    and severity."""
    events = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.withColumns(
        {
            "us": clock("ts"),
            "k": F.get_json_object("props", "$.k").cast("int"),
            "weight": taxonomy.lookup(kind, WEIGHTS, 0),
            "tactic": taxonomy.lookup(kind, TACTICS, "Unknown"),
            "severity": taxonomy.lookup(kind, LEVELS, "info"),
        }
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with customer and clock: flows from customers to suppliers."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", clock("o_orderdate").alias("us"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
