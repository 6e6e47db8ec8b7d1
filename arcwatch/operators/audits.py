"""Configuration audit: every check over facts of hosts, as rows.

Facts come as small tables by kind: ``settings`` (host, file, key, value),
``texts`` (host, file, text), ``modes`` (host, path, mode, kind), ``ports``
(host, port), ``accounts`` (host, name, uid, shell, home_mode, password) and
``commands`` (host, name, ok).  A check whose facts a host does not have is a
SKIP.  Results are (host, check_id, category, severity, status, lost).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values: checks, their severity and points ----------------------------------
LOGIN_DEFS = [
    ("PAM-01", "pass_max_days", "<=", 90, "medium", 10),
    ("PAM-02", "pass_min_days", ">=", 1, "low", 5),
    ("PAM-03", "pass_warn_age", ">=", 7, "low", 5),
]
FILE_MODES = [
    ("FS-01", "/etc/passwd", 0o644, "high", 15),
    ("FS-02", "/etc/shadow", 0o640, "high", 15),
    ("FS-03", "/etc/gshadow", 0o640, "high", 15),
    ("FS-04", "/etc/group", 0o644, "high", 15),
]
SYSTEM_FOLDERS = ["/etc", "/usr/bin", "/usr/sbin", "/bin", "/sbin"]
LISTEN_PORTS = [
    (23, "critical", 20), (21, "high", 15), (2375, "critical", 20), (6379, "high", 15),
    (9200, "medium", 10), (11211, "medium", 10), (111, "medium", 10),
]
NO_LOGIN = ["/usr/sbin/nologin", "/sbin/nologin", "/bin/false", ""]
FULL_POINTS = 400
# -------------------------------------------------------------------------------------

RESULT = ["host", "check_id", "category", "severity", "status", "lost"]


def _result(df: DataFrame, check: str | Column, category: str, severity: str | Column, ok: Column, points: int | Column, failed: str = "FAIL", skipped: Column | None = None) -> DataFrame:
    """One row a row of df; a null answer counts as no."""
    points, severity = (F.lit(x) if isinstance(x, (int, str)) else x for x in (points, severity))
    status = F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(failed)
    if skipped is not None:
        status = F.when(skipped, "SKIP").otherwise(status)
    lost = F.when(status.isin("FAIL", "WARN"), points).otherwise(0)
    shown = F.when(status == "SKIP", "info").otherwise(severity)
    name = F.lit(check) if isinstance(check, str) else check
    return df.select("host", name.alias("check_id"), F.lit(category).alias("category"), shown.alias("severity"), status.alias("status"), lost.cast("int").alias("lost"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def password_policy(hosts: DataFrame, settings: DataFrame, texts: DataFrame) -> DataFrame:
    """Ages in login.defs, length in pwquality.conf, lockout and history in PAM."""
    pick = lambda file, key: F.max(F.when((F.col("file") == file) & (F.lower("key") == key), F.col("value")))
    has = lambda file: F.max(F.col("file") == file)
    known = settings.groupBy("host").agg(
        *[pick("/etc/login.defs", key).alias(key) for _, key, *_ in LOGIN_DEFS], has("/etc/login.defs").alias("defs"),
        pick("/etc/security/pwquality.conf", "minlen").alias("minlen"), has("/etc/security/pwquality.conf").alias("quality"),
    )
    pam = texts.filter(F.col("file").isin("/etc/pam.d/common-auth", "/etc/pam.d/system-auth")).groupBy("host").agg(F.max(F.col("text").rlike(r"pam_(faillock|tally2)\.so")).alias("lockout"), F.max(F.col("text").rlike(r"pam_pwhistory\.so")).alias("history"))
    remember = texts.filter(F.col("file") == "/etc/security/pwquality.conf").groupBy("host").agg(F.max(F.col("text").contains("remember=")).alias("remember"))
    rows = hosts.join(known, "host", "left").join(pam, "host", "left").join(remember, "host", "left")
    number = lambda c: F.when(F.col(c).rlike(r"^-?\d+$"), F.col(c).cast("int"))
    out = []
    for check, key, op, limit, severity, points in LOGIN_DEFS:
        n = number(key)
        status = F.when(n.isNull(), "WARN").when(n <= limit if op == "<=" else n >= limit, "PASS").otherwise("FAIL")
        status = F.when(F.coalesce("defs", F.lit(False)), status).otherwise("SKIP")
        lost = F.when(status.isin("WARN", "FAIL"), points).otherwise(0).cast("int")
        out.append(rows.select("host", F.lit(check).alias("check_id"), F.lit("pam").alias("category"), F.when(status == "SKIP", "info").otherwise(severity).alias("severity"), status.alias("status"), lost.alias("lost")))
    out.append(_result(rows, "PAM-04", "pam", "medium", number("minlen") >= 12, 10, skipped=~F.coalesce("quality", F.lit(False))))
    out.append(_result(rows, "PAM-05", "pam", "high", F.col("lockout"), 15))
    out.append(_result(rows, "PAM-06", "pam", "low", F.coalesce("history", F.lit(False)) | F.coalesce("remember", F.lit(False)), 5, "WARN"))
    return _union(out)


def filesystem(hosts: DataFrame, modes: DataFrame) -> DataFrame:
    """Rights of account files, world-writable system files, sticky /tmp."""
    mode = lambda path: F.max(F.when(F.col("path") == path, F.col("mode")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    loose = F.count_if((F.col("kind") == "file") & folder.isin(SYSTEM_FOLDERS) & (F.col("mode").bitwiseAND(0o002) != 0))
    known = modes.groupBy("host").agg(*[mode(path).alias(check) for check, path, *_ in FILE_MODES], mode("/tmp").alias("tmp"), mode("/etc/crontab").alias("crontab"), F.max(F.col("path") == "/etc/cron.allow").alias("cron_allow"), loose.alias("loose"))
    rows = hosts.join(known, "host", "left")
    out = [_result(rows, check, "filesystem", severity, F.col(f"`{check}`").bitwiseAND(0o7777 & ~most) == 0, points, skipped=F.col(f"`{check}`").isNull()) for check, _, most, severity, points in FILE_MODES]
    out.append(_result(rows, "FS-05", "filesystem", "high", F.coalesce("loose", F.lit(0)) == 0, 15))
    out.append(_result(rows, "FS-06", "filesystem", "medium", F.col("tmp").bitwiseAND(0o1000) != 0, 10, skipped=F.col("tmp").isNull()))
    out.append(_result(rows, "CRN-01", "cron", "high", F.col("crontab").bitwiseAND(0o022) == 0, 15, skipped=F.col("crontab").isNull()))
    out.append(_result(rows, "CRN-02", "cron", "low", F.col("cron_allow"), 5, "WARN"))
    review = rows.select("host", F.lit("CRN-03").alias("check_id"), F.lit("cron").alias("category"), F.lit("low").alias("severity"), F.lit("INFO").alias("status"), F.lit(0).alias("lost"))
    return _union([*out, review])


def services(hosts: DataFrame, ports: DataFrame, commands: DataFrame) -> DataFrame:
    """Risky listening ports, each a FAIL; a PASS where a host has none; and
    whether a firewall has rules."""
    risky = F.col("port").isin([p for p, *_ in LISTEN_PORTS])
    listening = ports.filter(risky).select("host", "port").distinct()
    severity, points = F.lit(None).cast("string"), F.lit(None).cast("int")
    for port, level, lost in LISTEN_PORTS:
        severity, points = F.when(F.col("port") == port, level).otherwise(severity), F.when(F.col("port") == port, lost).otherwise(points)
    found = _result(listening, F.concat(F.lit("SVC-"), F.col("port").cast("string")), "services", severity, F.lit(False), points)
    none = _result(hosts.join(listening, "host", "left_anti"), "SVC-01", "services", "high", F.lit(True), 0)
    wall = commands.filter(F.col("name").isin("iptables", "nft", "ufw")).groupBy("host").agg(F.max("ok").alias("ok"))
    return _union([found, none, _result(hosts.join(wall, "host", "left"), "SVC-02", "services", "medium", F.col("ok"), 10, "WARN")])


def audit_logging(hosts: DataFrame, commands: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether auditd is there, has rules and watches the account files."""
    installed = commands.filter("name = 'auditctl'").groupBy("host").agg(F.max("ok").alias("installed"))
    rules = texts.filter(F.col("file").isin("/etc/audit/rules.d/audit.rules", "/etc/audit/audit.rules")).groupBy("host").agg(F.max_by("text", F.when(F.col("file").contains("rules.d"), 1).otherwise(0)).alias("rules"))
    rows = hosts.join(installed, "host", "left").join(rules, "host", "left").withColumn("installed", F.coalesce("installed", F.lit(False)))
    lines = F.size(F.split(F.trim(F.coalesce("rules", F.lit(""))), "\n"))
    return _union([
        _result(rows, "AUD-01", "audit", "medium", F.col("installed"), 10, "WARN"),
        _result(rows, "AUD-02", "audit", "low", lines > 2, 5, "WARN", skipped=~F.col("installed")),
        _result(rows, "AUD-03", "audit", "medium", F.col("rules").contains("/etc/passwd"), 10, "WARN", skipped=~F.col("installed")),
    ])


def accounts(hosts: DataFrame, users: DataFrame) -> DataFrame:
    """A second root, system accounts with shells, empty passwords, open homes."""
    system = (F.col("uid") < 1000) & (F.col("uid") != 0)
    known = users.groupBy("host").agg(
        F.count_if((F.col("uid") == 0) & (F.col("name") != "root")).alias("roots"),
        F.count_if(system & ~F.coalesce("shell", F.lit("")).isin(NO_LOGIN)).alias("shells"),
        F.count_if(F.col("password") == "").alias("empty"),
        F.count("password").alias("shadow"),
        F.count_if((F.col("uid") >= 1000) & (F.col("home_mode").bitwiseAND(0o022) != 0)).alias("homes"),
    )
    rows = hosts.join(known, "host")
    return _union([
        _result(rows, "ACC-01", "accounts", "critical", F.col("roots") == 0, 25),
        _result(rows, "ACC-02", "accounts", "medium", F.col("shells") == 0, 10, "WARN"),
        _result(rows, "ACC-03", "accounts", "critical", F.col("empty") == 0, 25, skipped=F.col("shadow") == 0),
        _result(rows, "ACC-04", "accounts", "low", F.col("homes") == 0, 5, "WARN"),
    ])


def hardening(results: DataFrame) -> DataFrame:
    """host, score (0..100), points lost and checks by status."""
    lost = F.coalesce(F.sum(F.when(F.col("status").isin("FAIL", "WARN"), F.col("lost"))), F.lit(0))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "FAIL", "WARN", "SKIP", "INFO")]
    out = results.groupBy("host").agg(lost.alias("points_lost"), F.count("*").alias("checks"), *counts)
    return out.withColumn("score", F.greatest(F.lit(0), 100 - F.floor(100 * F.col("points_lost") / FULL_POINTS)).cast("int"))
