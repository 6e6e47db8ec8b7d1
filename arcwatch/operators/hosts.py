"""Detectors on process, file, memory, configuration and honeypot records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy
from ..functions.iocs import SECRETS
from ..functions.text import entropy, redact
from .scanning import literals_in

# -- fixed values ----------------------------------------------------------------------
LINEAGE = {
    "nginx": ["bash", "sh", "cmd.exe", "powershell.exe", "python", "python3", "perl", "ruby"],
    "apache2": ["bash", "sh", "cmd.exe", "powershell.exe", "python", "python3"],
    "httpd": ["bash", "sh", "cmd.exe", "powershell.exe", "python", "python3"],
    "iis": ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe"],
    "tomcat": ["bash", "sh", "cmd.exe", "powershell.exe"],
    "php-fpm": ["bash", "sh", "cmd.exe"],
    "node": ["bash", "sh", "cmd.exe", "powershell.exe"],
    "java": ["bash", "sh", "cmd.exe", "powershell.exe"],
    "svchost": ["cmd.exe", "powershell.exe", "wscript.exe"],
}
SCRATCH = ["/tmp/", "/var/tmp/", "/dev/shm/", "/run/user/", "\\appdata\\local\\temp\\", "\\windows\\temp\\", "\\users\\public\\"]
DESTRUCTION = [
    "vssadmin delete shadows", "wmic shadowcopy delete", "bcdedit /set {default} recoveryenabled no",
    "wbadmin delete catalog", "diskshadow /s", "rm -rf /var/backups", "rm -rf /backup", "rm -rf /snap",
    "btrfs subvolume delete", "zfs destroy", "tmutil deletelocalsnapshots", "rm -rf .snapshots", "shred ",
]
CRITICALITY = [
    ("/etc/shadow", 100, "credential_store"), ("/etc/passwd", 90, "credential_store"), ("/etc/sudoers", 90, "privilege_config"),
    ("/etc/ssh/", 85, "ssh_config"), ("/etc/cron", 80, "persistence"), ("/etc/systemd/", 75, "persistence"),
    ("/etc/ld.so.preload", 95, "hijack_vector"), ("/etc/ld.so.conf", 80, "hijack_vector"), ("/bin/", 70, "system_binary"),
    ("/sbin/", 70, "system_binary"), ("/usr/bin/", 65, "system_binary"), ("/usr/sbin/", 65, "system_binary"),
    ("/lib/", 60, "system_library"), ("/usr/lib/", 60, "system_library"), ("/var/www/", 55, "web_content"),
    ("/home/", 30, "user_data"), ("/root/", 50, "root_home"),
]
MALWARE = [
    ("mimikatz", r"(?i)(?:mimikatz|sekurlsa|lsadump)"), ("metasploit", r"(?i)(?:meterpreter|metasploit)"),
    ("win_shell", r"(?i)(?:cmd\.exe|powershell\.exe|wscript\.exe)"), ("unix_shell", r"/bin/sh\x00|/bin/bash\x00"),
    ("reverse_shell", r"(?i)nc -e|ncat -e|/dev/tcp/"), ("download_exec", r"(?i)(?:wget|curl)\s+http.*\|\s*(?:bash|sh)"),
    ("nop_sled", r"\x90{8,}"), ("int3_sled", r"\xcc{4,}"), ("b64_pe_header", r"(?:TVqQAAMAAAAEAAAA|TVoAAA)"),
]
WORM = ["mirai", "gafgyt", "tsunami", "botnet", "tftp", "busybox", "/proc/mounts", "/etc/shadow", "/var/tmp/"]
EXPLOIT = [
    r"/bin/sh", r"/bin/bash", r"cmd\.exe", r"powershell", r"eval\(", r"base64_decode", r"gzinflate", r"union\s+select",
    r"information_schema", r"\x90{4,}", r"\xcc{4,}", r"jndi:", r"ldap://", r"rmi://", r"\.\./", r"\.\.\\", r"%2e%2e",
    r"(?:wget|curl)\s+http",
]
#: id, key, test of the value, weight, value assumed when unset
SSH_CHECKS = [
    ("SSH-01", "permitrootlogin", "lower(value) = 'no'", 20, None), ("SSH-02", "passwordauthentication", "lower(value) = 'no'", 15, None),
    ("SSH-03", "permitemptypasswords", "lower(value) = 'no'", 20, "no"), ("SSH-04", "x11forwarding", "lower(value) = 'no'", 5, None),
    ("SSH-05", "maxauthtries", "try_cast(value as int) <= 6", 10, None), ("SSH-06", "protocol", "value = '2'", 15, "2"),
    ("SSH-07", "permituserenvironment", "lower(value) = 'no'", 5, "no"), ("SSH-08", "logingracetime", "try_cast(rtrim('sm', value) as int) <= 60", 5, "120"),
    ("SSH-09", "clientaliveinterval", "try_cast(value as int) between 1 and 900", 10, "0"),
]
SYSCTL_CHECKS = [
    ("KRN-01", "kernel.randomize_va_space", "value = '2'", 15, None), ("KRN-02", "kernel.kptr_restrict", "value in ('1', '2')", 10, None),
    ("KRN-03", "kernel.dmesg_restrict", "value = '1'", 10, None), ("KRN-04", "kernel.yama.ptrace_scope", "value in ('1', '2', '3')", 15, None),
    ("KRN-05", "net.ipv4.ip_forward", "value = '0'", 10, None), ("KRN-06", "net.ipv4.conf.all.accept_redirects", "value = '0'", 10, None),
    ("KRN-07", "net.ipv4.conf.all.send_redirects", "value = '0'", 5, None), ("KRN-08", "net.ipv4.tcp_syncookies", "value = '1'", 10, None),
]
# --------------------------------------------------------------------------------------


def contains_any(column: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.lower(column).contains(n)
    return F.coalesce(out, F.lit(False))


def process_findings(processes: DataFrame) -> DataFrame:
    """host, pid and reason for processes (host, pid, ppid, name, exe, cmdline,
    create_us): a server that spawned a shell, a scratch path, destroyed
    backups, a parent younger than its child or none at all."""
    parents = processes.select("host", F.col("pid").alias("ppid"), F.col("name").alias("parent_name"), F.col("create_us").alias("parent_us"))
    rows = processes.join(parents, ["host", "ppid"], "left")
    allowed = taxonomy.lookup(F.regexp_replace(F.lower("parent_name"), r"\.exe$", ""), LINEAGE)
    tests = {
        "web_server_spawned_shell": F.array_contains(allowed, F.lower("name")),
        "suspicious_exec_path": contains_any(F.col("exe"), SCRATCH),
        "backup_destruction": contains_any(F.col("cmdline"), DESTRUCTION),
        "parent_newer": F.col("parent_us") > F.col("create_us") + 1_000_000,
        "ghost_parent": F.col("parent_name").isNull() & (F.col("ppid") > 1),
    }
    reasons = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]), lambda r: r.isNotNull())
    return rows.select("host", "pid", "name", "parent_name", F.explode(reasons).alias("reason"))


def outbound(connections: DataFrame, browsers: list[str]) -> DataFrame:
    """Connections of programs that are no browser, to odd ports or from a
    scratch path; each (pid, address, port) once."""
    odd = ~F.col("remote_port").isin(80, 443, 53, 123) | contains_any(F.col("exe"), SCRATCH)
    return connections.filter(~F.lower("name").isin(browsers) & odd).dropDuplicates(["pid", "remote_ip", "remote_port"])


def criticality(path: Column) -> Column:
    """(weight, label) of the first tier whose prefix fits."""
    tier = lambda w, c: F.struct(F.lit(w).alias("weight"), F.lit(c).alias("label"))
    out = tier(20, "general")
    for prefix, weight, label in reversed(CRITICALITY):
        out = F.when(path.startswith(prefix), tier(weight, label)).otherwise(out)
    return out


def integrity_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drift between two file snapshots (path, sha256, mode, uid, gid; perhaps
    link_target): new, deleted, modified, or else changed in rights, owner or
    link target, each a row, with severity; order by ``drift_order``."""
    fields = ["sha256", "mode", "uid", "gid"] + ["link_target"] * ("link_target" in before.columns and "link_target" in after.columns)
    a = before.select("path", F.struct(*fields).alias("_a"))
    b = after.select("path", F.struct(*fields).alias("_b"))
    tier = criticality(F.col("path"))
    rows = a.join(b, "path", "full_outer").withColumns({"criticality": tier["weight"], "category": tier["label"]})
    weight = F.col("criticality")
    by = lambda high, middle, low: F.when(weight >= high, "critical").when(weight >= middle, "high").otherwise(low)
    was, now = F.col("_a.mode"), F.col("_b.mode")
    gained = lambda bit: (now.bitwiseAND(bit) != 0) & (was.bitwiseAND(bit) == 0)
    fact = lambda kind, severity: F.struct(F.lit(kind).alias("change_type"), severity.alias("severity"))
    differ = lambda f: ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}"))
    changed = [
        F.when(differ("mode"), fact("PERM_CHANGED", F.when(gained(0o4000) | gained(0o002), "critical").otherwise("low"))),
        F.when(differ("uid") | differ("gid"), fact("OWNER_CHANGED", F.when(weight >= 50, "high").otherwise("low"))),
    ]
    if "link_target" in fields:
        both = F.col("_a.link_target").isNotNull() & F.col("_b.link_target").isNotNull()
        changed.append(F.when(both & differ("link_target"), fact("SYMLINK_CHANGED", F.lit("high"))))
    found = (
        F.when(F.col("_a").isNull(), F.array(fact("NEW", by(80, 50, "low"))))
        .when(F.col("_b").isNull(), F.array(fact("DELETED", by(80, 50, "medium"))))
        .when(F.col("_a.sha256") != F.col("_b.sha256"), F.array(fact("MODIFIED", by(70, 40, "medium"))))
        .otherwise(F.filter(F.array(*changed), lambda c: c.isNotNull()))
    )
    gained_suid = F.coalesce(gained(0o4000), F.lit(False))
    out = rows.withColumn("setuid_added", gained_suid).withColumn("_f", F.explode(found))
    return out.select("path", "_f.change_type", "_f.severity", "setuid_added", "criticality", "category")


def drift_order() -> list[Column]:
    """Worst severity first, then the more critical path."""
    return [F.desc(taxonomy.severity_rank(F.col("severity"))), F.desc("criticality"), F.asc("path")]


def drift_verdict(drift: DataFrame) -> DataFrame:
    """One row: COMPROMISED, DRIFTED, MINOR_DRIFT or TRUSTED."""
    has = lambda s: F.count_if(F.col("severity") == s) > 0
    return drift.agg(F.when(has("critical"), "COMPROMISED").when(has("high"), "DRIFTED").when(F.count("*") > 0, "MINOR_DRIFT").otherwise("TRUSTED").alias("verdict"))


def memory_findings(regions: DataFrame) -> DataFrame:
    """Secrets (redacted), malware marks, runs of 16 or more no-operations (with the
    length of the first) and injected code in memory regions
    (pid, region, perms, data): bytes are read as ISO-8859-1 text."""
    data = F.decode("data", "ISO-8859-1")
    fact = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("detail"))
    found = [F.transform(F.regexp_extract_all(data, F.lit(p), F.lit(0)), lambda v: fact("credential", redact(v))) for p in SECRETS.values()]
    found += [F.when(data.rlike(f"(?s){p}"), F.array(fact("malware", F.lit(n)))).otherwise(F.array()) for n, p in MALWARE]
    sled = F.regexp_extract(data, "\\x90{16,}", 0)
    found.append(F.when(sled != "", F.array(fact("shellcode_pattern", F.length(sled).cast("string")))).otherwise(F.array()))
    injected = F.col("perms").contains("x") & F.col("region").rlike(r"heap|stack|/tmp/|/dev/shm/")
    found.append(F.when(injected, F.array(fact("injected_code", F.col("region")))).otherwise(F.array()))
    return regions.select("pid", "region", F.explode(F.concat(*found)).alias("_f")).select("pid", "region", "_f.*").distinct()


def printable_strings(data: Column, least: float = 2.5) -> Column:
    """Printable runs of six or more characters with enough entropy."""
    return F.filter(F.regexp_extract_all(data, F.lit("[ -~]{6,}"), F.lit(0)), lambda s: entropy(s) >= least)


def intent(payload: Column, duration_ms: Column, user: Column, password: Column) -> Column:
    """(intent, technique, score) of a honeypot interaction; first match.

    payload is text with one character a byte.
    """
    as_ = lambda i, m, s: F.struct(F.lit(i).alias("intent"), F.lit(m).alias("mitre"), F.lit(s).alias("score"))
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    variety = F.size(F.array_distinct(F.split(payload, "")))
    return (
        F.when((F.length(payload) < 10) & (duration_ms < 500), as_("SCANNER", "T1046", 30))
        .when(given(user) | given(password), as_("BRUTE_FORCE", "T1110", 50))
        .when(payload.rlike("(?i)" + "|".join(WORM)), as_("WORM", "T1584", 70))
        .when(payload.rlike("(?i)" + "|".join(EXPLOIT)), as_("EXPLOIT_PROBE", "T1203", 65))
        .when((F.length(payload) > 200) & (variety > 100), as_("C2_CALLBACK", "T1071", 55))
        .otherwise(as_("UNKNOWN", "T1046", 40))
    )


def audit(facts: DataFrame, checks: list[tuple]) -> DataFrame:
    """check_id, host, status, lost of every check on facts (host, key, value);
    an unset key takes the assumed value, or is a WARN without one."""
    spark = facts.sparkSession
    rows = spark.createDataFrame([(c, k, w, d) for c, k, _, w, d in checks], "check_id string, key string, weight int, assumed string")  # a fixed list
    hosts = facts.select("host").distinct()
    every = hosts.join(F.broadcast(rows))
    joined = every.join(facts.select("host", F.lower("key").alias("key"), F.col("value").alias("_v")), ["host", "key"], "left").withColumn("value", F.coalesce("_v", "assumed"))
    ok = F.lit(None).cast("boolean")
    for check, _, test, *_ in checks:
        ok = F.when(F.col("check_id") == check, F.coalesce(F.expr(test), F.lit(False))).otherwise(ok)
    status = F.when(F.col("value").isNull(), "WARN").when(ok, "PASS").otherwise("FAIL")
    return joined.select("check_id", "host", "value", status.alias("status"), F.when(status == "PASS", 0).otherwise(F.col("weight")).alias("lost"))


def hardening(checks: DataFrame) -> DataFrame:
    return checks.groupBy("host").agg(F.greatest(F.lit(0), 100 - F.floor(100 * F.sum("lost") / 400)).cast("int").alias("score"))


def touched_canaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """Canary files (path, token, atime, size) read, changed or gone since."""
    now = after.select("path", F.col("atime").alias("_at"), F.col("size").alias("_sz"))
    kind = F.when(F.col("_sz").isNull(), "missing").when(F.col("_sz") != F.col("size"), "modified").when(F.col("_at") > F.col("atime") + 1, "accessed")
    return before.join(now, "path", "left").withColumn("kind", kind).filter("kind is not null").drop("_at", "_sz")


def leaked_tokens(texts: DataFrame, tokens: DataFrame, pattern: str = r"[A-Z]{2,8}-[0-9a-f]{16,64}", text: str = "text") -> DataFrame:
    """Texts that hold a canary token: tokens share a form, so candidates are
    extracted and joined by equality rather than compared with every token."""
    found = texts.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))))
    return found.join(tokens, "token")


#: Characters of tokens that one automaton holds.
TOKEN_TEXT = 8 << 20


def leaked_anywhere(texts: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """Texts that hold a canary token of whatever form, anywhere: texts with
    every column of the tokens that they hold.

    Tokens are sought by an automaton a block of at most ``TOKEN_TEXT``
    characters, one pass over the texts each; empty and null tokens are in no
    text.
    """
    held, size, blocks = [], 0, []
    for row in tokens.select("token").filter("token <> ''").distinct().orderBy("token").toLocalIterator():
        held.append(row["token"])
        size += len(row["token"])
        if size >= TOKEN_TEXT:
            blocks.append(held)
            held, size = [], 0
    blocks.append(held)
    found = reduce(DataFrame.unionByName, [texts.withColumn("token", F.explode(literals_in(F.col(text), b))) for b in blocks])
    return found.join(tokens, "token")
