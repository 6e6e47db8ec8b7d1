"""Reports as DataFrames: counts by a field, risk, trends, entities, hosts.

Every report aggregates on the executors; ordered lists are bounded top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy
from .correlate import risk_score

# -- fixed values ---------------------------------------------------------------------
PORT_RISK = {"none": 0, "info": 5, "low": 10, "medium": 20, "high": 30, "critical": 50}
RISK_RANK = ["none", "info", "low", "medium", "high", "critical"]
CRITICAL_CVES = ["CVE-2024-6387", "CVE-2019-0708", "CVE-2017-0144"]
OUI = {
    "00:00:0c": "Cisco Systems", "00:0c:29": "VMware", "00:50:56": "VMware", "00:1a:11": "Google",
    "00:16:3e": "Xen / Amazon", "00:0d:3a": "Microsoft Azure", "52:54:00": "QEMU/KVM", "08:00:27": "Oracle VirtualBox",
    "00:15:5d": "Microsoft Hyper-V", "b8:27:eb": "Raspberry Pi", "dc:a6:32": "Raspberry Pi", "e4:5f:01": "Raspberry Pi",
    "00:1b:21": "Intel", "00:1e:67": "Intel", "00:22:fb": "Intel", "00:26:b9": "Dell", "14:18:77": "Dell",
    "f0:1f:af": "Dell", "00:1a:4b": "HP", "00:21:5a": "HP", "3c:d9:2b": "HP", "00:0e:7f": "Cisco-Linksys",
    "00:12:17": "Cisco-Linksys", "00:18:f8": "Apple", "00:1b:63": "Apple", "00:25:4b": "Apple", "28:cf:e9": "Apple",
    "3c:07:54": "Apple", "ac:de:48": "Apple", "00:26:bb": "Apple", "fc:fb:fb": "Cisco Meraki",
    "00:0f:61": "Juniper Networks", "00:1f:12": "Juniper Networks", "00:60:97": "3Com", "00:50:ba": "D-Link",
    "00:11:95": "D-Link", "14:91:82": "TP-Link", "ec:08:6b": "TP-Link", "50:c7:bf": "TP-Link", "00:50:43": "Zyxel",
    "00:13:49": "Zyxel",
}
# -------------------------------------------------------------------------------------


def counts_by(df: DataFrame, fields: list[str], score: str | None = None) -> DataFrame:
    """(field, value, n, score): how often each value of each field occurs, and
    the scores it sums to; one pass, one row a field and value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    rows = df.select(each.alias("_e"), (F.col(score) if score else F.lit(0)).alias("_score")).select("_e.*", "_score")
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"), F.coalesce(F.sum("_score"), F.lit(0)).cast("long").alias("score"))


def top(df: DataFrame, key: str, k: int, weight: Column | None = None, name: str = "n") -> DataFrame:
    """The k keys with the most rows or weight; ties by key."""
    total = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(key).agg(total.alias(name)).orderBy(F.desc(name), key).limit(k)


def at_least(findings: DataFrame, floor: str, severity: str = "severity") -> DataFrame:
    """Findings of a severity or worse, as exports and screens show them."""
    return findings.filter(taxonomy.severity_rank(F.col(severity)) >= taxonomy.SEVERITIES.index(floor))


def finding_order() -> list[Column]:
    """Worst severity first, then score; the fingerprint breaks ties."""
    return [F.desc(taxonomy.severity_rank(F.col("severity"))), F.desc("score"), F.asc("fingerprint")]


def address_order(ip: str = "ip") -> Column:
    """Numeric order of IPv4 addresses."""
    return F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))


def retained(findings: DataFrame, rows: int = 10_000, us: str = "us") -> DataFrame:
    """The last findings, as many as a screen keeps (its own limit)."""
    return findings.orderBy(F.desc(us), F.desc("fingerprint")).limit(rows)


def risk_summary(findings: DataFrame) -> DataFrame:
    """One row: findings by severity and the risk of them all, 0..100."""
    n = lambda s: F.count_if(F.lower("severity") == s)
    raw = F.coalesce(F.sum(taxonomy.severity_weight(F.col("severity"))), F.lit(0)).cast("double")
    out = findings.agg(F.count("*").alias("findings"), *[n(s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low")], raw.alias("_raw"))
    return out.withColumn("risk", risk_score(F.col("_raw"))).drop("_raw")


def entity_weights(findings: DataFrame, k: int = 10) -> DataFrame:
    """The entities with the most severity weight times hits."""
    return top(findings, "entity", k, taxonomy.severity_weight(F.col("severity")) * F.col("hit_count"), "weight")


def trend(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: fingerprints new, resolved and persisting, both risks, and
    IMPROVING, WORSENING or STABLE by more than five points."""
    a, b = previous.select("fingerprint").distinct(), current.select("fingerprint").distinct()
    both = a.withColumn("_was", F.lit(1)).join(b.withColumn("_is", F.lit(1)), "fingerprint", "full_outer")
    fates = both.agg(F.count_if(F.col("_was").isNull()).alias("new"), F.count_if(F.col("_is").isNull()).alias("resolved"), F.count_if(F.col("_was").isNotNull() & F.col("_is").isNotNull()).alias("persisting"))
    fresh = current.join(a, "fingerprint", "left_anti").agg(F.count("*").alias("new_findings"), F.count_if(F.col("severity") == "critical").alias("new_critical"))
    risks = risk_summary(previous).select(F.col("risk").alias("previous_risk")).crossJoin(risk_summary(current).select(F.col("risk").alias("current_risk")))
    change = F.col("current_risk") - F.col("previous_risk")
    out = fates.crossJoin(fresh).crossJoin(risks)  # one row each
    return out.withColumns({"change": change, "trend": F.when(change < -5, "IMPROVING").when(change > 5, "WORSENING").otherwise("STABLE")})


def correlation_summary(deduplicated: DataFrame) -> DataFrame:
    """(field, value, n): totals, hits by severity and findings by tool."""
    total = deduplicated.agg(F.count("*").alias("findings"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))
    totals = total.select(F.explode(F.array(F.struct(F.lit("total").alias("field"), F.lit("findings").alias("value"), F.col("findings").alias("n")), F.struct(F.lit("total").alias("field"), F.lit("hits").alias("value"), F.col("hits").alias("n")))).alias("_t")).select("_t.*")
    by_severity = deduplicated.groupBy(F.lit("severity").alias("field"), F.col("severity").alias("value")).agg(F.sum("hit_count").alias("n"))
    by_tool = deduplicated.groupBy(F.lit("tool").alias("field"), F.col("tool").alias("value")).agg(F.count("*").alias("n"))
    return totals.unionByName(by_severity).unionByName(by_tool)


def screen_entities(findings: DataFrame, k: int = 50) -> DataFrame:
    """Entities by score; a finding without one has that of its severity."""
    score = F.coalesce(F.col("score"), taxonomy.severity_weight(F.col("severity")))
    return findings.groupBy("entity").agg(F.sum(score).alias("score"), F.count("*").alias("findings")).orderBy(F.desc("score"), "entity").limit(k)


def screen_campaigns(findings: DataFrame, k: int = 20) -> DataFrame:
    """Entities that showed three known tactics at any time, by final score."""
    known = F.col("tactic").isin(taxonomy.TACTIC_ORDER)
    score = F.coalesce(F.col("score"), taxonomy.severity_weight(F.col("severity")))
    out = findings.groupBy("entity").agg(F.count_distinct(F.when(known, F.col("tactic"))).alias("tactics"), F.sum(score).alias("base_score")).filter("tactics >= 3")
    out = out.withColumn("multiplier", 1 + 0.5 * (F.col("tactics") - 2))
    return out.withColumn("final_score", F.floor(F.col("base_score") * F.col("multiplier")).cast("long")).orderBy(F.desc("final_score"), "entity").limit(k)


def vendor(mac: Column) -> Column:
    """Maker of a network card by the first three bytes of its address."""
    return F.coalesce(taxonomy.lookup(F.substring_index(F.lower(mac), ":", 3), OUI), F.lit("Unknown"))


def host_summary(hosts: DataFrame) -> DataFrame:
    """(field, value, n) over hosts (mac, os_guess, is_rogue, open_ports): the
    five commonest makers, systems, totals."""
    rows = hosts.withColumn("vendor", vendor(F.col("mac")))
    makers = top(rows, "vendor", 5).select(F.lit("vendor").alias("field"), F.col("vendor").alias("value"), "n")
    systems = rows.groupBy(F.lit("os").alias("field"), F.col("os_guess").alias("value")).agg(F.count("*").alias("n"))
    totals = rows.agg(F.count("*").alias("hosts"), F.count_if(F.size("open_ports") > 0).alias("with_ports"), F.count_if("is_rogue").alias("rogues"))
    named = [F.struct(F.lit("total").alias("field"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("hosts", "with_ports", "rogues")]
    return makers.unionByName(systems).unionByName(totals.select(F.explode(F.array(*named)).alias("_t")).select("_t.*"))


def port_risks(exposed: DataFrame) -> DataFrame:
    """Worst risk of each port (host, port) of its known weaknesses (cve)."""
    cve = F.col("cve")
    rank = F.when(cve.startswith("INFO"), 1).when(cve.isin(CRITICAL_CVES), 5).otherwise(4)
    worst = exposed.groupBy("host", "port").agg(F.max(rank).alias("_r"), F.count("*").alias("cves"))
    return worst.select("host", "port", F.get(F.array(*map(F.lit, RISK_RANK)), F.col("_r")).alias("risk"), "cves")


def scan_risk(ports: DataFrame) -> DataFrame:
    """Sum of the risk points of a host's open ports."""
    return ports.groupBy("host").agg(F.sum(taxonomy.lookup(F.col("risk"), PORT_RISK, 0)).cast("long").alias("risk_score"))


def certificate_flags(tls: DataFrame, now: Column) -> DataFrame:
    """weak_protocol, expired, expiring_soon and self_signed of certificates
    (version, not_after, subject, issuer)."""
    days = F.floor((F.unix_micros("not_after") - F.unix_micros(now)) / 86_400_000_000)
    return tls.withColumns(
        {
            "days_left": days.cast("long"),
            "weak_protocol": F.col("version").isin("SSLv2", "SSLv3", "TLSv1", "TLSv1.1"),
            "expired": F.coalesce(days < 0, F.lit(False)),
            "expiring_soon": F.coalesce(days.between(0, 29), F.lit(False)),
            "self_signed": F.col("subject").eqNullSafe(F.col("issuer")),
        }
    )


def interaction_stats(interactions: DataFrame, k: int = 10) -> DataFrame:
    """(field, value, n): interactions by intent, and the addresses with most."""
    by_intent = interactions.groupBy(F.lit("intent").alias("field"), F.col("intent").alias("value")).agg(F.count("*").alias("n"))
    return by_intent.unionByName(top(interactions, "src_ip", k).select(F.lit("src_ip").alias("field"), F.col("src_ip").alias("value"), "n"))


def flow_totals(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def indicator_stats(lookups: DataFrame) -> DataFrame:
    """One row over lookups (type, value, score; score null where unknown)."""
    return lookups.agg(F.count("*").alias("total"), F.count("score").alias("hits"), F.count_if(F.col("score").isNull()).alias("misses"), F.count_distinct("type", "value").alias("distinct"))


def matrix(seen: DataFrame, catalog: list[tuple[str, str]]) -> DataFrame:
    """(tactic, technique, detected) of a catalog of (technique, tactic)."""
    known = seen.sparkSession.createDataFrame(catalog, "technique string, tactic string")  # a fixed list
    hit = seen.select("technique").distinct().withColumn("_hit", F.lit(True))
    return known.join(hit, "technique", "left").select("tactic", "technique", F.coalesce("_hit", F.lit(False)).alias("detected"))


def indicators_in_dumps(regions: DataFrame, text: str = "text") -> DataFrame:
    """Distinct outside addresses and URLs in the texts of each dump."""
    from ..functions import iocs

    ips = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(iocs.PATTERNS["ip"]), F.lit(0))), lambda v: ~F.coalesce(iocs.is_internal(iocs.ipv4_number(v)), F.lit(True)))
    urls = F.array_distinct(F.regexp_extract_all(text, F.lit(iocs.PATTERNS["url"]), F.lit(0)))
    typed = lambda kind, a: F.transform(a, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    return regions.select("dump", F.explode(F.concat(typed("ip", ips), typed("url", urls))).alias("_i")).select("dump", "_i.*").distinct()
