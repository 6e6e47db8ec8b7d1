"""Findings from all detectors in one schema: fingerprint, dedup, entities,
campaigns, risk, delta and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy
from .windows import islands

#: tool, finding_type, severity, mitre, entity, description, score, us
FINDING = ["tool", "finding_type", "severity", "mitre", "entity", "description", "score", "us"]

# -- fixed values: controls that a tactic puts to the test --------------------
CIS = {
    "Reconnaissance": ["CIS-7", "CIS-13"], "Initial Access": ["CIS-4", "CIS-7", "CIS-13"],
    "Execution": ["CIS-2", "CIS-10"], "Persistence": ["CIS-5", "CIS-10"],
    "Privilege Escalation": ["CIS-4", "CIS-5", "CIS-10"], "Defense Evasion": ["CIS-8", "CIS-10"],
    "Credential Access": ["CIS-5", "CIS-16"], "Discovery": ["CIS-13", "CIS-14"],
    "Lateral Movement": ["CIS-12", "CIS-14"], "Command and Control": ["CIS-13", "CIS-14"],
    "Exfiltration": ["CIS-13", "CIS-14"], "Impact": ["CIS-11", "CIS-14"],
}
NIST = {
    "Reconnaissance": ["ID.RA-1", "DE.CM-1"], "Initial Access": ["PR.AC-1", "DE.CM-7"],
    "Execution": ["PR.PT-3", "DE.CM-3"], "Persistence": ["PR.AC-4", "DE.CM-3"],
    "Privilege Escalation": ["PR.AC-3", "PR.AC-6"], "Defense Evasion": ["DE.CM-4", "DE.CM-7"],
    "Credential Access": ["PR.AC-7", "DE.CM-3"], "Discovery": ["PR.AC-5", "DE.AE-2"],
    "Lateral Movement": ["PR.AC-5", "DE.AE-3"], "Command and Control": ["DE.CM-1", "PR.IP-1"],
    "Exfiltration": ["DE.CM-1", "RS.MI-1"], "Impact": ["PR.IP-4", "RC.RP-1"],
}
CIS_NAMES = {
    "CIS-2": "Inventory & Control of Software Assets", "CIS-4": "Secure Configuration", "CIS-5": "Account Management",
    "CIS-7": "Email & Web Browser Protections", "CIS-8": "Malware Defenses", "CIS-10": "Malware Defenses (Behavior)",
    "CIS-11": "Data Recovery", "CIS-12": "Network Infrastructure Management", "CIS-13": "Network Monitoring & Defense",
    "CIS-14": "Security Awareness", "CIS-16": "Application Software Security",
}
# -----------------------------------------------------------------------------


def fingerprint(tool: str, kind: str, entity: str, description: str, length: int = 80) -> Column:
    """First 16 hex digits of sha256(tool|type|entity|start of description)."""
    text = F.concat_ws("|", tool, kind, entity, F.left(F.col(description), F.lit(length)))
    return F.left(F.sha2(text, 256), F.lit(16))


def deduplicate(findings: DataFrame, gap: int) -> DataFrame:
    """One row for each run of hits of a fingerprint no further apart than gap,
    with the facts of its first hit."""
    facts = tuple(c for c in ("tool", "finding_type", "severity", "mitre", "tactic", "entity", "description", "score") if c in findings.columns)
    return islands(findings, ["fingerprint"], gap, facts=facts)


def entity_risk(findings: DataFrame) -> DataFrame:
    """Score times hits, severities and tools of each entity."""
    hits = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in taxonomy.SEVERITIES]
    return findings.groupBy("entity").agg(F.sum(F.col("score") * F.col("hit_count")).alias("risk"), F.count("*").alias("findings"), *hits, F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


def campaigns(findings: DataFrame, span: int, least: int = 3) -> DataFrame:
    """Entities with ``least`` tactics in the span that ends at their last
    finding: base score, multiplier and final score."""
    known = findings.filter("tactic <> 'Unknown'")
    recent = known.withColumn("_last", F.max("us").over(Window.partitionBy("entity"))).filter(F.col("us") >= F.col("_last") - span)
    grouped = recent.groupBy("entity").agg(
        F.collect_set(F.struct(taxonomy.tactic_rank(F.col("tactic")).alias("r"), "tactic")).alias("_t"),
        F.sum(F.col("score") * F.col("hit_count")).alias("base_score"),
        F.count("*").alias("findings"),
        (F.max("us") - F.min("us")).alias("span_us"),
    )
    n = F.size("_t")
    out = grouped.filter((n >= least) & (F.col("findings") >= 2)).withColumn("multiplier", 1 + 0.5 * (n - 2))
    return out.withColumn("final_score", F.floor(F.col("base_score") * F.col("multiplier")).cast("long")).withColumn("tactics", F.array_join(F.transform(F.array_sort("_t"), lambda t: t["tactic"]), " > ")).drop("_t")


def risk_score(raw: Column) -> Column:
    """0..100 on a logarithmic scale that ends at a raw weight of 400."""
    return F.least(F.lit(100), F.floor(F.log1p(raw) / F.log1p(F.lit(400.0)) * 100)).cast("int")


def delta(previous: DataFrame, current: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Fingerprints by fate: new, resolved or persisting."""
    a = previous.select(F.col(key)).distinct().withColumn("_was", F.lit(True))
    b = current.select(F.col(key)).distinct().withColumn("_is", F.lit(True))
    fate = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "resolved").otherwise("persisting")
    return a.join(b, key, "full_outer").select(key, fate.alias("fate"))


def control_failures(findings: DataFrame, framework: str = "cis", order: str = "us") -> DataFrame:
    """Failures of each control of a framework (cis, nist) by the tactics of the
    findings, its name and the description of the first of them."""
    table = NIST if framework == "nist" else CIS
    controls = F.explode(F.coalesce(taxonomy.lookup(F.col("tactic"), table), F.array().cast("array<string>")))
    first = F.min_by(F.left("description", F.lit(60)), F.struct(order, "description"))
    out = findings.withColumn("control", controls).groupBy("control").agg(F.count("*").alias("failures"), first.alias("first_evidence"))
    severity = F.when(F.col("failures") >= 10, "critical").when(F.col("failures") >= 5, "high").otherwise("medium")
    return out.withColumns({"name": F.coalesce(taxonomy.lookup(F.col("control"), CIS_NAMES), "control"), "severity": severity})


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows added, deleted or modified between two snapshots."""
    state = F.struct(*fields)
    a, b = before.select(key, state.alias("_a")), after.select(key, state.alias("_b"))
    drift = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "DELETED").when(~F.col("_a").eqNullSafe(F.col("_b")), "MODIFIED")
    return a.join(b, key, "full_outer").select(key, drift.alias("drift")).filter("drift is not null")
