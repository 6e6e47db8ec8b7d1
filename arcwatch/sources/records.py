"""Record types read from JSON, CSV and text, with their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iocs

DNS = "ts double, src string, qname string, qtype string, rcode string, answers array<string>, ttl int"
BEHAVIOUR = "ts double, entity string, type string, hour double, name string, bytes double, cmd string"
INTERACTION = "src_ip string, listen_port int, honeypot_type string, duration_ms double, payload string, captured_user string, captured_pass string"


def _json(spark: SparkSession, path: str, schema: str, need: str) -> DataFrame:
    """Lines of JSON; lines that are not, or lack the needed field, are left out."""
    return spark.read.schema(schema).json(path).filter(F.col(need).isNotNull())


def passive_dns(spark: SparkSession, path: str) -> DataFrame:
    out = _json(spark, path, DNS, "qname")
    filled = out.fillna({"ts": 0.0, "src": "unknown", "qtype": "A", "rcode": "NOERROR", "ttl": 0})
    return filled.withColumn("us", (F.col("ts") * 1_000_000).cast("long"))


def behaviour(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, BEHAVIOUR, "entity").withColumn("us", (F.col("ts") * 1_000_000).cast("long"))


def interactions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, INTERACTION, "src_ip")


def _indicators(df: DataFrame, default: int) -> DataFrame:
    kind = F.coalesce(F.nullif("type", F.lit("")), iocs.ioc_type(F.trim("value")))
    named = df.filter(F.col("value").isNotNull()).withColumn("type", F.lower(kind))
    return named.select("type", iocs.normal_form(F.col("value"), F.col("type")).alias("value"), F.coalesce(F.col("score").try_cast("int"), F.lit(default)).alias("score"), "tags")


def feed_csv(spark: SparkSession, path: str) -> DataFrame:
    """indicator,type,score,tags with a header; tags split at commas."""
    df = spark.read.option("header", "true").schema("indicator string, type string, score string, tags string").csv(path)
    return _indicators(df.withColumnRenamed("indicator", "value").withColumn("tags", F.filter(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: t != "")), 75)


def feed_text(spark: SparkSession, path: str) -> DataFrame:
    """One indicator a line; # starts a comment."""
    df = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    return _indicators(df.withColumns({"type": F.lit(None).cast("string"), "score": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")}), 70)


def feed_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of indicators, or one under ``indicators``."""
    entry = "struct<value:string,indicator:string,type:string,score:string,tags:array<string>>"
    text = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", f"struct<indicators:array<{entry}>>")["indicators"], F.from_json("value", f"array<{entry}>"))
    df = text.select(F.explode(items).alias("_e")).select(F.coalesce("_e.value", "_e.indicator").alias("value"), "_e.type", "_e.score", F.coalesce("_e.tags", F.array().cast("array<string>")).alias("tags"))
    return _indicators(df, 75)


def key_values(lines: DataFrame, line: str = "line") -> DataFrame:
    """key and value of configuration lines; comments and blank lines go."""
    text = F.trim(F.regexp_replace(F.col(line), "#.*$", ""))
    return lines.withColumn("_t", text).filter("_t <> ''").withColumns({"key": F.lower(F.regexp_extract("_t", r"^(\S+)", 1)), "value": F.trim(F.regexp_extract("_t", r"^\S+[\s=]+(.*)$", 1))}).drop("_t")


def listeners(lines: DataFrame, line: str = "line") -> DataFrame:
    """Ports that listen, from /proc/net/tcp lines (state 0A, port in hex)."""
    parts = F.split(F.trim(line), r"\s+")
    local = F.try_element_at(parts, F.lit(2))
    return lines.filter(F.try_element_at(parts, F.lit(4)) == "0A").select(F.conv(F.substring_index(local, ":", -1), 16, 10).cast("int").alias("port")).distinct()
