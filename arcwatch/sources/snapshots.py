"""Snapshots of hosts: files, processes, connections and alerts as timeline
events in one schema; exclusions; saved baselines; known indicators."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy

# -- fixed values ---------------------------------------------------------------------
EXCLUDED = [
    "*.log", "*.tmp", "*.swp", "*.lock", "*.pid", "*.sock", "*~", "*.cache", "*.bak", "/proc/*", "/sys/*", "/dev/*",
    "/run/*", "*/wtmp", "*/utmp", "*/btmp", "*/lastlog", "*/.bash_history", "*/.viminfo", "*/.lesshst",
    "*/__pycache__/*", "*.pyc",
]
SUSPICIOUS_NAMES = ["nc", "ncat", "nmap", "masscan", "metasploit", "msfconsole", "mimikatz", "lazagne", "hydra", "john", "hashcat", "socat"]
SCRATCH = ["/tmp/", "/dev/shm/", "/var/tmp/"]
CATEGORY_TECHNIQUE = {
    "login_success": "T1078", "login_failure": "T1110", "file_create": "T1105", "file_modify": "T1565",
    "file_delete": "T1485", "execution": "T1059", "persistence": "T1053", "network_connect": "T1071",
    "privesc": "T1548", "discovery": "T1082", "exfil": "T1041", "defense_evasion": "T1027", "credential": "T1003",
    "alert": "T1486",
}
KNOWN_INDICATORS = [
    ("198.51.100.10", "ip", 95, ["ransomware", "c2", "lockbit"]), ("203.0.113.77", "ip", 90, ["trojan", "c2"]),
    ("192.0.2.55", "ip", 85, ["scanner", "botnet"]), ("evil-c2.example.com", "domain", 95, ["c2", "malware"]),
    ("update-flash-now.biz", "domain", 88, ["phishing", "dropper"]), ("cdn-fast-delivery.ru", "domain", 82, ["malware", "redirector"]),
    ("d41d8cd98f00b204e9800998ecf8427e", "md5", 90, ["ransomware", "wannacry-variant"]),
    ("aabbcc112233445566778899aabbcc11", "md5", 85, ["trojan", "agent-tesla"]),
    ("invoice_2024.exe", "filename", 75, ["phishing", "dropper"]), ("update.bat", "filename", 60, ["suspicious"]),
    ("svchost32.exe", "filename", 80, ["masquerading", "trojan"]),
]
# -------------------------------------------------------------------------------------

EVENT = ["us", "source", "category", "severity", "actor", "target", "mitre", "score", "tags"]


def excluded(path: Column, globs: list[str] = EXCLUDED) -> Column:
    """Whether a path fits one of the globs."""
    # the translated pattern ends in \\Z, which Java writes \\z
    return path.rlike("^(?:" + "|".join(translate(g).replace(r"\Z", r"\z").replace(r"\z)", r")\z") for g in globs) + ")")


def _event(df: DataFrame, us: Column, source: str, category: Column | str, severity: Column, actor: Column, target: Column, score: Column, tags: Column, mitre: Column | None = None) -> DataFrame:
    category = F.lit(category) if isinstance(category, str) else category
    technique = taxonomy.lookup(category, CATEGORY_TECHNIQUE, "") if mitre is None else mitre
    return df.select(us.cast("long").alias("us"), F.lit(source).alias("source"), category.alias("category"), severity.alias("severity"), actor.alias("actor"), target.alias("target"), technique.alias("mitre"), score.cast("int").alias("score"), tags.alias("tags"))


def _none() -> Column:
    return F.array().cast("array<string>")


def between(events: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Events of a span of the clock, in microseconds, both ends included."""
    if since is not None:
        events = events.filter(F.col("us") >= since)
    return events if until is None else events.filter(F.col("us") <= until)


def file_events(files: DataFrame) -> DataFrame:
    """Files (path, mtime, ctime in seconds): one event for the last change of
    the content, one for that of the metadata where it lies over a minute off."""
    apart = F.abs(F.col("ctime") - F.col("mtime"))
    changed = _event(files, F.col("mtime") * 1_000_000, "filesystem", "file_modify", F.lit("info"), F.lit(""), F.col("path"), F.lit(0), _none())
    odd = files.filter(apart > 60)
    near = apart < 3600
    meta = _event(odd, F.col("ctime") * 1_000_000, "filesystem", "file_create", F.when(near, "low").otherwise("medium"), F.lit(""), F.col("path"), F.when(near, 5).otherwise(15), F.when(apart > 3600, F.array(F.lit("timestomping"))).otherwise(_none()), F.lit("T1027"))
    return changed.unionByName(meta)


def process_events(processes: DataFrame) -> DataFrame:
    """Processes (name, exe, username, create_us): tools of attackers, and
    programs in scratch folders."""
    named, scratch = F.lit(False), F.lit(False)
    for n in SUSPICIOUS_NAMES:
        named = named | F.lower("name").contains(n)
    for folder in SCRATCH:
        scratch = scratch | F.col("exe").contains(folder)
    kind = F.when(named, "suspicious_tool").when(scratch, "malware_path")
    severity = F.when(kind == "suspicious_tool", "high").when(kind == "malware_path", "critical").otherwise("info")
    tags = F.when(kind.isNotNull(), F.array(kind)).otherwise(_none())
    return _event(processes, F.col("create_us"), "process", "execution", severity, F.col("username"), F.left("exe", F.lit(120)), taxonomy.severity_rank(severity) * 10, tags)


def connection_events(connections: DataFrame) -> DataFrame:
    """Connections (us, status, process, local, remote_ip, remote_port)."""
    rows = connections.filter(F.col("status").isin("ESTABLISHED", "LISTEN"))
    odd = F.col("remote_port").isNotNull() & ~F.col("remote_port").isin(80, 443, 53, 22, 25)
    severity = F.when(odd, "medium").when(F.col("status") == "LISTEN", "info").otherwise("low")
    remote = F.concat("remote_ip", F.lit(":"), F.col("remote_port").cast("string"))
    return _event(rows, F.col("us"), "network", "network_connect", severity, F.col("process"), F.coalesce(remote, "local"), taxonomy.severity_rank(severity) * 5, _none())


def alert_events(findings: DataFrame) -> DataFrame:
    """Findings of tools as timeline events."""
    return _event(findings, F.col("us"), "alert", "alert", F.col("severity"), F.col("entity"), F.lit(""), F.col("score"), F.array("finding_type"), F.when(F.col("mitre") == "", "T1486").otherwise(F.col("mitre")))


_TIMES = ("timestamp", "ts", "time", "@timestamp", "first_seen")
_ITEM = "struct<" + ",".join(f"`{c}`:string" for c in (*_TIMES, "event_type", "severity", "vm_id", "file_path", "hunt_type", "path")) + ",score_delta:int,tags:array<string>,details:struct<path:string,exe:string>,meta:struct<severity:string,mitre:string>>"


def json_events(spark: SparkSession, path: str, kind: str = "alert") -> DataFrame:
    """Timeline events of JSON files of alerts, byte-rule matches (yara) or hunt
    findings (ioc): a list, or an object that holds one as vms or findings, or
    is one itself.

    The clock is the first of timestamp, ts, time, @timestamp and first_seen that
    can be read, else now.  A file that is no JSON has no events.
    """
    text = F.col("value")
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    wrapped = F.from_json(text, f"struct<vms:array<{_ITEM}>,findings:array<{_ITEM}>>")
    single = F.array(F.from_json(text, _ITEM))
    held = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{_ITEM}>")).when(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.coalesce(wrapped["vms"], wrapped["findings"], single))
    rows = whole.select(F.explode(held).alias("i")).select("i.*")
    seen = F.coalesce(*[F.try_to_timestamp(F.col(f"`{c}`")) for c in _TIMES], F.current_timestamp())
    us, none = F.unix_micros(seen), F.lit("")
    severity = F.coalesce(F.col("meta.severity") if kind == "yara" else F.col("severity"), F.lit("medium"))
    rank = taxonomy.severity_rank(severity) * 15
    if kind == "yara":
        return _event(rows, us, "yara", "defense_evasion", severity, none, F.coalesce("file_path", none), rank, F.coalesce("tags", _none()), F.coalesce(F.col("meta.mitre"), none))
    if kind == "ioc":
        return _event(rows, us, "ioc", F.coalesce("hunt_type", F.lit("alert")), severity, none, F.coalesce("path", none), rank, F.array(F.lit("ioc")), none)
    event = F.coalesce("event_type", F.lit("alert"))
    target = F.coalesce(F.nullif(F.col("details.path"), none), F.col("details.exe"), none)
    return _event(rows, us, "alert", "alert", severity, F.coalesce("vm_id", none), target, F.coalesce("score_delta", F.lit(0)), F.array(event))


def chronological() -> list[Column]:
    return [F.asc("us"), F.asc("source"), F.asc("target")]


def timeline_counts(events: DataFrame) -> DataFrame:
    """(field, value, n) by severity, category and source."""
    from ..operators.reports import counts_by

    return counts_by(events, ["severity", "category", "source"], "score")


def timeline_span(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("score").alias("score"))


def scan_files(spark: SparkSession, path: str, most_bytes: int = 200 << 20, globs: list[str] = EXCLUDED) -> DataFrame:
    """path, size, mtime and sha256 of the files under a folder that no glob
    excludes; larger files come without a hash, and none passes the driver."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(path).filter(~excluded(F.regexp_replace("path", "^[a-z]+:/+", "/"), globs))
    small = F.col("length") <= most_bytes
    return files.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.when(small, F.sha2("content", 256)).alias("sha256"))


def known_indicators(spark: SparkSession) -> DataFrame:
    """A small list of known-bad values, for trials."""
    return spark.createDataFrame(KNOWN_INDICATORS, "value string, type string, score int, tags array<string>")


def host_baseline(spark: SparkSession, path: str) -> DataFrame:
    """ip and mac of the hosts of a saved scan (a JSON list)."""
    return spark.read.schema("ip string, mac string").option("multiLine", "true").json(path)
