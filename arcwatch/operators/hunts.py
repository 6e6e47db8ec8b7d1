"""Hunts: playbooks over processes, connections, units and logs, with verdicts;
and indicators of compromise in files, command lines and start-up files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iocs
from ..functions.text import entropy
from .rules import first_match

# -- fixed values ---------------------------------------------------------------------
LOG_PATTERNS = {
    "CRED-01": [r"sekurlsa::", r"lsadump::", r"privilege::debug", r"procdump.*lsass", r"mimikatz", r"wce -w", r"pwdump"],
    "EXEC-01": [r"certutil.*-urlcache", r"bitsadmin.*transfer", r"mshta.*http", r"regsvr32.*/i:http", r"rundll32.*javascript"],
    "DISC-01": [r"whoami", r"net user", r"ipconfig", r"systeminfo", r"arp -a", r"cat /etc/passwd", r"cat /etc/hosts"],
    "LMOV-01": [r"ADMIN\$", r"\\C\$", r"IPC\$", r"net use .* /user:", r"PsExec", r"psexesvc", r"wmiexec", r"smbexec", r"Impacket"],
}
HUNT_SEVERITY = {
    "CRED-01": "critical", "EXEC-01": "high", "EXEC-03": "medium", "PERS-01": "high", "DISC-01": "medium",
    "EVAD-01": "high", "C2-01": "critical", "LMOV-01": "critical", "EXFIL-01": "high",
}
STATUS_FACTOR = {"CONFIRMED": 3, "SUSPECT": 2, "NEGATIVE": 0, "INSUFFICIENT_DATA": 0}
SEVERITY_POINTS = {"critical": 40, "high": 25, "medium": 15, "low": 5}
DOWNLOADERS = {
    "certutil": ["-urlcache", "-split", "-f"], "bitsadmin": ["/transfer", "/download"],
    "mshta": ["http://", "https://", "javascript:", "vbscript:"], "regsvr32": ["/s", "/i:http", "/i:ftp"],
    "rundll32": ["javascript:", "..dll,"],
}
SHELLS = ["bash", "sh", "zsh", "fish", "ksh", "tcsh", "dash", "cmd.exe", "powershell.exe", "pwsh.exe"]
SYSTEM_USERS = ["root", "system", "SYSTEM", "NT AUTHORITY\\SYSTEM"]
DISCOVERY = [
    "whoami", "id", "net", "ipconfig", "ifconfig", "arp", "route", "netstat", "systeminfo", "uname", "hostname", "w",
    "who", "last", "ps", "tasklist", "dir", "ls", "find", "env", "set", "cat /etc/passwd", "cat /etc/hosts",
]
PLAIN_PORTS = [80, 443, 22, 25, 53, 143, 993, 587, 465, 8080, 8443]
TRUSTED = ["ssh", "sshd", "curl", "wget", "python", "python3", "browser", "chrome", "firefox"]
GHOSTS = ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe"]
COMMAND_LINES = [
    ("Download-and-execute pipeline", r"(?:wget|curl).*\|\s*(?:bash|sh|python)"),
    ("Base64-decode-and-execute", r"base64\s+-d.*\|\s*(?:bash|sh)"),
    ("Bash /dev/tcp reverse shell", r"(?:/dev/tcp|/dev/udp)/"),
    ("PowerShell encoded command", r"powershell.*(?:-enc|-EncodedCommand)"),
    ("Chained recon commands", r"(?:whoami|net user|net group|netstat|ipconfig).*&&"),
]
CRON = [
    ("Download in cron job", r"(?:wget|curl).*http"),
    ("Cron executing from /tmp", r"/tmp/\S+"),
    ("Base64 decode in cron", r"base64\s+-d"),
    ("Reverse shell in cron", r"nc\s+-e|/dev/tcp"),
]
UNIT_MARKS = ["/tmp/", "/dev/shm/", "base64", "wget", "curl", "nc -e"]
SHELL_START = [r"(?:wget|curl).*http", r"base64\s+-d", r"nc\s+-e|/dev/tcp", r"LD_PRELOAD\s*="]
PROTECTED_NAMES = ["svchost.exe", "lsass.exe", "csrss.exe", "winlogon.exe"]
SUID_KNOWN = ["/usr/bin/sudo", "/bin/su", "/usr/bin/passwd"]
SCRATCH = ["/tmp/", "/dev/shm/", "/var/tmp/"]
#: Kind of a file by its first bytes, in hex.
MAGIC = [("PE/EXE", "4d5a"), ("ELF", "7f454c46"), ("SCRIPT", "23212f"), ("ZIP", "504b0304"), ("GZIP", "1f8b"), ("MACHO", "cafebabe")]
CREDENTIAL_TOOLS = [
    "mimikatz", "procdump", "wce", "fgdump", "pwdump", "lsass", "ntdsutil", "secretsdump", "lazagne", "gsecdump",
    "crackmapexec", "impacket",
]
# -------------------------------------------------------------------------------------


def log_hits(lines: DataFrame, hunt: str, text: str = "line") -> DataFrame:
    """Lines that a hunt's patterns match, with the first that does."""
    return lines.withColumn("pattern", first_match(F.col(text), [(p, p) for p in LOG_PATTERNS[hunt]])).filter("pattern is not null")


def downloaders(processes: DataFrame) -> DataFrame:
    """Programs of the system that fetch or run what they should not."""
    name, cmd = F.regexp_replace(F.lower("name"), r"\.exe", ""), F.lower("cmdline")
    hit = F.lit(False)
    for program, marks in DOWNLOADERS.items():
        any_mark = F.lit(False)
        for m in marks:
            any_mark = any_mark | cmd.contains(m)
        hit = hit | ((name == program) & any_mark)
    return processes.filter(hit)


def credential_tools(processes: DataFrame, tools: list[str] = CREDENTIAL_TOOLS) -> DataFrame:
    """Processes that dump credentials: by name, by an encoded or downloading
    command, or by reaching for lsass; each once, with what matched."""
    name, cmd = F.lower("name"), F.col("cmdline")
    any_of = lambda c, marks: F.coalesce(F.greatest(*[c.contains(m) for m in marks], F.lit(False)), F.lit(False))
    kind = (
        F.when(any_of(name, tools), "tool_name")
        .when(name.contains("certutil") & any_of(cmd, ["-urlcache", "-decode", "-f"]), "certutil_download")
        .when(name.contains("powershell") & cmd.rlike("-[Ee]nc|-[Ee]ncodedCommand"), "powershell_encoded")
        .when(F.lower(cmd).contains("lsass") & any_of(name, ["procdump", "taskmgr", "werfault"]), "lsass_access")
    )
    return processes.withColumn("match", kind).filter("match is not null")


def long_shells(processes: DataFrame, now: Column, hours: float = 6.0) -> DataFrame:
    """Shells of ordinary users that have run for so many hours."""
    runtime = (now - F.col("create_us")) / 3_600_000_000
    return processes.withColumn("hours", F.round(runtime, 1)).filter(F.lower("name").isin(SHELLS) & (runtime >= hours) & ~F.col("username").isin(SYSTEM_USERS))


def discovery_bursts(processes: DataFrame, now: Column, span: int, least: int = 5) -> DataFrame:
    """Ordinary users with so many discovery commands in the span."""
    recent = (now - F.col("create_us")) <= span
    name = F.regexp_replace(F.lower("name"), r"\.exe", "")
    found = processes.filter(name.isin(DISCOVERY) & recent).groupBy("username").agg(F.count("*").alias("commands"))
    return found.filter((F.col("commands") >= least) & ~F.col("username").isin("root", "SYSTEM"))


def spoofed_parents(processes: DataFrame) -> DataFrame:
    """Shells whose parent is gone, and processes older than their parent."""
    parents = processes.select("host", F.col("pid").alias("ppid"), F.col("create_us").alias("parent_us"), F.lit(True).alias("_there"))
    rows = processes.filter("ppid <> 0").join(parents, ["host", "ppid"], "left")
    issue = F.when(F.col("_there").isNull() & F.lower("name").isin(GHOSTS), "ghost_parent").when(F.col("parent_us") > F.col("create_us") + 1_000_000, "parent_newer_than_child")
    return rows.withColumn("issue", issue).filter("issue is not null").drop("_there")


def odd_connections(connections: DataFrame) -> DataFrame:
    """Established connections to outside addresses on unusual ports, of
    programs that are not trusted."""
    trusted = F.lit(False)
    for t in TRUSTED:
        trusted = trusted | F.lower("process").contains(t)
    outside = ~F.coalesce(iocs.is_internal(iocs.ipv4_number(F.col("remote_ip"))), F.lit(False))
    return connections.filter((F.col("status") == "ESTABLISHED") & ~F.col("remote_port").isin(PLAIN_PORTS) & outside & ~F.coalesce(trusted, F.lit(False)))


def verdicts(evidence: DataFrame) -> DataFrame:
    """status, confidence and score of each hunt from its counts of evidence
    (hunt, n_hits, n_logs, n_other; null n_hits: the data was not there).

    n_hits: all hits; n_logs: those in logs; n_other: what else the hunt weighs
    (suspicious units, SMB connections, users with bursts).
    """
    hunt, n, logs, other = F.col("hunt"), F.col("n_hits"), F.col("n_logs"), F.col("n_other")
    any_hit = n > 0
    as_ = lambda s, c: F.struct(F.lit(s).alias("status"), (c if isinstance(c, Column) else F.lit(c)).cast("int").alias("confidence"))
    found = (
        F.when(n.isNull(), as_("INSUFFICIENT_DATA", 0))
        .when(hunt == "CRED-01", F.when(any_hit, as_("CONFIRMED", 90)).otherwise(as_("NEGATIVE", 85)))
        .when(hunt == "EXEC-01", F.when(any_hit, as_("CONFIRMED", F.least(F.lit(95), 40 * n))).otherwise(as_("NEGATIVE", 85)))
        .when(hunt == "EXEC-03", F.when(any_hit, as_("SUSPECT", 65)).otherwise(as_("NEGATIVE", 80)))
        .when(hunt == "PERS-01", F.when(other > 0, as_("CONFIRMED", 85)).when(any_hit, as_("SUSPECT", 50)).otherwise(as_("NEGATIVE", 80)))
        .when(hunt == "DISC-01", F.when((other > 0) | (logs >= 10), as_("SUSPECT", 70)).otherwise(as_("NEGATIVE", 80)))
        .when(hunt == "EVAD-01", F.when(any_hit, as_("CONFIRMED", 80)).otherwise(as_("NEGATIVE", 85)))
        .when(hunt == "C2-01", F.when(any_hit, as_("SUSPECT", F.least(F.lit(85), 30 * n))).otherwise(as_("NEGATIVE", 80)))
        .when(hunt == "LMOV-01", F.when((logs > 0) & (other > 0), as_("CONFIRMED", 80)).when(any_hit, as_("SUSPECT", 55)).otherwise(as_("NEGATIVE", 80)))
        .when(hunt == "EXFIL-01", F.when(any_hit, as_("SUSPECT", 55)).otherwise(as_("NEGATIVE", 60)))
    )
    points, factor = F.lit(10), F.lit(0)
    for h, severity in HUNT_SEVERITY.items():
        points = F.when(hunt == h, SEVERITY_POINTS[severity]).otherwise(points)
    for s, k in STATUS_FACTOR.items():
        factor = F.when(F.col("status") == s, k).otherwise(factor)
    out = evidence.withColumn("_v", found).select("*", "_v.*").drop("_v")
    return out.withColumn("score", (F.floor(F.col("confidence") * points / 100) * factor).cast("int"))


def verdict_order() -> list[Column]:
    """Confirmed first, then by confidence."""
    rank = F.when(F.col("status") == "CONFIRMED", 0).when(F.col("status") == "SUSPECT", 1).when(F.col("status") == "INSUFFICIENT_DATA", 2).otherwise(3)
    return [rank.asc(), F.desc("confidence"), F.asc("hunt")]


def command_line(cmdline: Column) -> Column:
    """What a command line is suspected of; the first pattern that fits."""
    return first_match(cmdline, COMMAND_LINES)


def masquerades(processes: DataFrame) -> DataFrame:
    """System programs that run from outside the system folder."""
    return processes.filter(F.lower("name").isin(PROTECTED_NAMES) & (F.col("exe") != "") & ~F.lower("exe").contains("system32"))


def persistence(files: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Findings in start-up files (path, text) of a kind: every suspicious
    pattern of a ``cron`` file, every marked ExecStart of a ``systemd`` unit, a
    ``shell`` start file once."""
    body = F.col(text)
    fact = lambda d, s, c: F.struct(d.alias("detail"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    if kind == "cron":
        found = F.filter(F.array(*[F.when(body.rlike(f"(?i){p}"), fact(F.lit(d), "critical", 85)) for d, p in CRON]), lambda f: f.isNotNull())
    elif kind == "systemd":
        marked = lambda line: F.exists(F.array(*map(F.lit, UNIT_MARKS)), lambda m: line.contains(m))
        starts = F.regexp_extract_all(body, F.lit(r"(?m)^\s*ExecStart=(.*)$"), F.lit(1))
        found = F.transform(F.filter(F.transform(starts, F.trim), marked), lambda v: fact(F.left(v, F.lit(80)), "critical", 90))
    else:
        first = first_match(body, [(p, p) for p in SHELL_START])
        found = F.when(first.isNotNull(), F.array(fact(first, "high", 80)))
    return files.withColumn("_f", F.explode(found)).select("path", F.lit(kind).alias("kind"), "_f.*")


def file_findings(files: DataFrame) -> DataFrame:
    """Findings on files (path, size, mode, mtime, ctime in seconds, data; the
    data as bytes): times that were set back, setuid, programs in scratch
    folders, packed programs."""
    magic = F.lower(F.hex(F.substring("data", 1, 4)))
    kind = F.lit(None).cast("string")
    for name, start in reversed(MAGIC):
        kind = F.when(magic.startswith(start), name).otherwise(kind)
    in_scratch = F.lit(False)
    for folder in SCRATCH:
        in_scratch = in_scratch | F.col("path").startswith(folder)
    packed = kind.isin("PE/EXE", "ELF") & (F.col("size") > 1024) & (entropy(F.decode(F.substring("data", 1, 65536), "ISO-8859-1")) > 7.2)
    fact = lambda n, s, c: F.struct(F.lit(n).alias("finding"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    tests = [
        (F.col("mtime") < F.col("ctime") - 60, fact("timestomp", "medium", 60)),
        ((F.col("mode").bitwiseAND(0o4000) != 0) & ~F.col("path").isin(SUID_KNOWN), fact("setuid", "high", 75)),
        (in_scratch & (F.col("size") > 100) & kind.isNotNull(), fact("scratch_binary", "critical", 85)),
        (packed, fact("packed_binary", "high", 70)),
    ]
    found = F.filter(F.array(*[F.when(t, f) for t, f in tests]), lambda f: f.isNotNull())
    return files.filter("size > 0").withColumn("_f", F.explode(found)).select("path", "_f.*")


def file_verdict(md5: Column, sha256: Column, file_entropy: Column, bad: list[str]) -> Column:
    """MALICIOUS by hash, SUSPICIOUS by entropy, else CLEAN."""
    return F.when(md5.isin(bad) | sha256.isin(bad), "MALICIOUS").when(file_entropy > 7.2, "SUSPICIOUS").otherwise("CLEAN")
