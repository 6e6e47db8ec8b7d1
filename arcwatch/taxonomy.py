"""Severities, score weights and ATT&CK tables, and Columns that look them up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values -------------------------------------------------------------

SEVERITIES = ["info", "low", "medium", "high", "critical"]
SEVERITY_WEIGHT = {"critical": 40, "high": 25, "medium": 10, "low": 3, "info": 0}

SCORE_WEIGHTS = {
    "crypto_spike": 50, "entropy": 40, "shadow": 40, "process": 40, "shell": 30,
    "agent_silence": 25, "velocity": 20, "network": 15, "heartbeat": 0,
    "cred_dump": 50, "driver_load": 45, "cloud_exfil": 45, "ransomware_esxi": 50,
    "kerberoast": 35, "rmm_tool": 30, "powershell": 30, "lolbin": 30, "staging": 25,
    "persistence": 25, "mfa_fatigue": 25, "cloud_auth": 20,
}
INSTANT_BLOCK = ["crypto_spike", "cred_dump", "ransomware_esxi"]
ISOLATION_SCORE, WARNING_SCORE, SCORE_CAP = 100, 50, 200

TACTIC_ORDER = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence",
    "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery",
    "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]

TECHNIQUE_TACTIC = {
    "T1595": "Reconnaissance", "T1583": "Resource Development", "T1190": "Initial Access",
    "T1078": "Initial Access", "T1059": "Execution", "T1053": "Persistence",
    "T1543": "Persistence", "T1098": "Persistence", "T1136": "Persistence",
    "T1505": "Persistence", "T1548": "Privilege Escalation", "T1027": "Defense Evasion",
    "T1070": "Defense Evasion", "T1003": "Credential Access", "T1110": "Credential Access",
    "T1552": "Credential Access", "T1558": "Credential Access", "T1082": "Discovery",
    "T1083": "Discovery", "T1018": "Discovery", "T1021": "Lateral Movement",
    "T1105": "Command and Control", "T1071": "Command and Control",
    "T1568": "Command and Control", "T1041": "Exfiltration", "T1030": "Exfiltration",
    "T1485": "Impact", "T1486": "Impact", "T1490": "Impact", "T1565": "Impact",
}

EVENT_TECHNIQUES = {
    "crypto_spike": ["T1486", "T1496"], "entropy": ["T1486"], "velocity": ["T1486"],
    "shadow": ["T1490"], "network": ["T1071", "T1571"], "agent_silence": ["T1562.001"],
    "rmm_tool": ["T1219"], "cloud_exfil": ["T1567.002"], "lolbin": ["T1218"],
    "staging": ["T1560"], "driver_load": ["T1068"], "cloud_auth": ["T1078.004"],
    "ransomware_esxi": ["T1486"], "cred_dump": ["T1003.001"],
}
PROCESS_REASONS = {
    "web_server_spawned_shell": ["T1505.003", "T1059"],
    "suspicious_exec_path": ["T1036.005", "T1059"],
}
REASON_TECHNIQUES = {
    "lsass_dump": ["T1003.001"], "kerberoast": ["T1558.003"], "mfa_fatigue": ["T1621"],
    "encoded_command": ["T1059.001", "T1027"], "obfuscated": ["T1027"],
    "scheduled_task": ["T1053"], "wmi_subscription": ["T1546.003"], "new_account": ["T1136"],
}
#: Event types whose reason alone names the technique.
BY_REASON = ["cred_access", "persistence", "powershell"]

# -----------------------------------------------------------------------------


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """table[key] for a small literal table."""
    out = F.lit(default)
    for k, v in table.items():
        value = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        out = F.when(key == k, value).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return lookup(F.lower(severity), {s: i for i, s in enumerate(SEVERITIES)}, 0)


def severity_weight(severity: Column) -> Column:
    return lookup(F.lower(severity), SEVERITY_WEIGHT, 0)


def event_weight(event_type: Column, reason: Column) -> Column:
    """Score of a telemetry event; what the sender claims is never used."""
    shell = (event_type == "process") & (reason == "web_server_spawned_shell")
    roast = (event_type == "cred_dump") & (reason == "kerberoast")
    return F.when(shell, SCORE_WEIGHTS["shell"]).when(roast, SCORE_WEIGHTS["kerberoast"]).otherwise(lookup(event_type, SCORE_WEIGHTS, 0))


def event_techniques(event_type: Column, reason: Column) -> Column:
    """ATT&CK technique ids of an event: by reason where the type needs one, or
    where the reason is one that names a technique; else by type."""
    none = F.array().cast("array<string>")
    named = lookup(reason, REASON_TECHNIQUES)
    return (
        F.when(event_type == "process", F.coalesce(lookup(reason, PROCESS_REASONS), F.array(F.lit("T1059"))))
        .when(event_type.isin(BY_REASON) | named.isNotNull(), F.coalesce(named, none))
        .otherwise(F.coalesce(lookup(event_type, EVENT_TECHNIQUES), none))
    )


def technique_tactic(technique: Column) -> Column:
    return F.coalesce(lookup(F.substring_index(technique, ".", 1), TECHNIQUE_TACTIC), F.lit("Unknown"))


def tactic_rank(tactic: Column) -> Column:
    return lookup(tactic, {t: i for i, t in enumerate(TACTIC_ORDER)}, len(TACTIC_ORDER))


def threat_status(score: Column) -> Column:
    return F.when(score >= ISOLATION_SCORE, "CRITICAL").when(score >= WARNING_SCORE, "WARNING").otherwise("SECURE")
