"""Indicator lookups, extraction and address ranges as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iocs

def extract_indicators(texts: DataFrame, key: str, text: str, kinds: list[str]) -> DataFrame:
    """Distinct (key, type, value) of the indicators in each text."""

    def typed(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("type"), iocs.normal_form(v, F.lit(kind)).alias("value"))

    found = F.concat(*[F.transform(iocs.extract(F.col(text), k), typed(k)) for k in kinds])
    return texts.select(key, F.explode(F.array_distinct(found)).alias("_i")).select(key, "_i.type", "_i.value")


def match_indicators(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found indicators that are known (type, value, score), with their tier.

    Spark picks the join at run time by the measured size of the known side.
    """
    return found.join(known, ["type", "value"]).withColumn("tier", iocs.reputation_tier(F.col("score")))


def upsert(known: DataFrame, added: DataFrame) -> DataFrame:
    """One row for each value (value, type, score, tags, source, seen_us):
    highest score, all tags, type and source of its first row, last sighting."""
    both = known.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    for name, kind in (("source", "string"), ("seen_us", "long")):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast(kind))
    order = F.struct("_new", F.coalesce("seen_us", F.lit(0)), "type", F.coalesce("source", F.lit("")))
    first = F.min_by(F.struct("type", "source"), order)
    out = both.groupBy("value").agg(first.alias("_f"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.max("seen_us").alias("last_seen_us"))
    return out.select("_f.type", "value", "score", "tags", "_f.source", "last_seen_us")


def locate(addresses: DataFrame, ip: str = "ip") -> DataFrame:
    """Country, city, lat, lon and approx of each IPv4 address.

    The blocks are a fixed short list, so containment is a chain of range
    tests in the projection and needs no join.
    """
    return addresses.filter(iocs.ipv4_number(F.col(ip)).isNotNull()).withColumn("_p", iocs.placement(F.col(ip))).select(*addresses.columns, "_p.*")


def locate_in(addresses: DataFrame, blocks: DataFrame, ip: str = "ip", order: str | None = None) -> DataFrame:
    """The block (first, bits, name) of any number of blocks that holds each
    address: the narrowest, or the first by a column ``order`` where blocks
    overlap and their order counts.  An equi-join on the prefix, once for each of
    the 33 prefix lengths in use, rather than a range join."""
    lengths = [r["bits"] for r in blocks.select("bits").distinct().orderBy(F.desc("bits")).limit(33).collect()]
    numbered = addresses.withColumn("_n", iocs.ipv4_number(F.col(ip))).filter("_n is not null")
    tries = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftleft(F.shiftright("_n", 32 - b), 32 - b).alias("first")) for b in lengths]))
    probed = numbered.select(ip, tries.alias("_t")).select(ip, "_t.bits", "_t.first").distinct()
    named = F.max_by("name", "bits") if order is None else F.min_by("name", order)
    hits = probed.join(blocks, ["bits", "first"]).groupBy(ip).agg(named.alias("name"))
    return addresses.join(hits, ip, "left")
