"""Log files as DataFrames: lines, format by line, parsed fields.

Files are read by ``spark.read.text`` (gzip is transparent); a line's format is
told from the line itself, so mixed files and streams parse alike.  Everything
is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# -- fixed values: line formats ---------------------------------------------------
SYSLOG = r"(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s*(.+)"
ACCESS = r'(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\d+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
WINDOWS = r"(?s)<EventID>(\d+)</EventID>.*?<TimeCreated SystemTime='([^']+)'/>.*?<Computer>([^<]+)</Computer>"
# ---------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None, after: str | None = None) -> DataFrame:
    """file and line of every line under path; ``after`` keeps newer files only."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if after:
        reader = reader.option("modifiedAfter", after)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and line of all text files under path.

    A file is read in blocks; the lines of a block are numbered inside it, and
    the counts of the blocks before it, one row a block, are added.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("_at"))
    joined = lines.withColumn("_i", inside).join(before, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return joined.select("file", (F.col("_before") + F.col("_i")).alias("line_no"), "line")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of files that appear under path (each file once)."""
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def _some(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def syslog_time(month: Column, day: Column, time: Column, year: int) -> Column:
    """Syslog lines carry no year; it is the caller's to say."""
    return F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.initcap(month), day, time), F.lit("yyyy MMM d HH:mm:ss"))


def log_format(line: Column) -> Column:
    start = F.ltrim(line)
    return (
        F.when(start.startswith("{"), "json")
        .when(line.contains("<Event ") | line.contains("<EventID>"), "windows")
        .when(line.rlike("^" + ACCESS), F.when(line.rlike(r'^\S+\s+-\s+.*" \d+ \d+ "'), "nginx").otherwise("apache"))
        .when(line.rlike("^" + SYSLOG), "syslog")
        .otherwise("raw")
    )


def parse(lines: DataFrame, year: int, line: str = "line") -> DataFrame:
    """lines with format, time, host, process, pid, message, status, bytes, uri."""
    raw, kind = F.col(line), log_format(F.col(line))
    sys = lambda i: _some(F.regexp_extract(raw, SYSLOG, i))
    web = lambda i: _some(F.regexp_extract(raw, ACCESS, i))
    win = lambda i: _some(F.regexp_extract(raw, WINDOWS, i))
    js = lambda *names: F.coalesce(*[_some(F.get_json_object(raw, f"$['{n}']")) for n in names])
    by = lambda **of: F.coalesce(*[F.when(F.col("format").isin(*k.split("_")), v) for k, v in of.items()])
    iso = lambda c: F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    out = lines.withColumn("format", kind)
    return out.withColumns(
        {
            "time": by(syslog=syslog_time(sys(1), sys(2), sys(3), year), nginx_apache=F.try_to_timestamp(web(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), json=iso(js("timestamp", "time", "@timestamp")), windows=iso(win(2))),
            "host": by(syslog=sys(4), nginx_apache=web(1), json=js("host", "hostname"), windows=win(3)),
            "process": by(syslog=sys(5), json=js("process", "program")),
            "pid": by(syslog=sys(6), json=js("pid")).try_cast("long"),
            "user": by(nginx_apache=F.nullif(web(2), F.lit("-"))),
            "uri": by(nginx_apache=web(5)),
            "status": by(nginx_apache=web(7)).try_cast("int"),
            "bytes": by(nginx_apache=web(8)).try_cast("long"),
            "event_id": by(windows=win(1)).try_cast("int"),
            "message": F.coalesce(by(syslog=sys(7), json=js("message", "msg", "line")), raw),
        }
    )


# -- fixed values: sign-in messages -------------------------------------------------
AUTH_LINE = r"^(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
AUTH_OK = r"(?i)Accepted (password|publickey|keyboard-interactive) for (\S+) from ([\d.]+)"
AUTH_FAIL = r"(?i)Failed password for (?:invalid user )?(\S+) from ([\d.]+)"
KERBEROS_TGS = r"(?i)TGS[_-]REQ.*?account[:=]?\s*(\S+).*?service[:=]?\s*(\S+)"
KERBEROS_AS = r"(?i)AS[_-]REQ.*?account[:=]?\s*(\S+)"
PREAUTH_FAILED = r"(?i)PREAUTH_FAILED|KRB5KDC_ERR_PREAUTH_FAILED"
PRIVILEGED = ["root", "administrator", "admin", "domain admin", "enterprise admin", "krbtgt"]
TIMELINE = [
    (r"Accepted (?:password|publickey) for (\S+) from ([\d.]+)", "login_success", "low"),
    (r"Failed password for (\S+) from ([\d.]+)", "login_failure", "medium"),
    (r"Invalid user (\S+) from ([\d.]+)", "login_failure", "medium"),
    (r"sudo:\s*(\S+)\s*:.*COMMAND=(.+)", "execution", "low"),
    (r"useradd.*name=(\S+)", "persistence", "high"),
    (r"pam_tally2.*user=(\S+).*locked", "login_failure", "high"),
    (r"CRON.*CMD\s*\((.+)\)", "execution", "info"),
    (r"systemd.*Started (.+)", "execution", "info"),
]
# -----------------------------------------------------------------------------------


def auth_events(lines: DataFrame, year: int, line: str = "line") -> DataFrame:
    """kind (ok, fail, tgs, as_fail), time, host, user, src, method, service of
    sign-in lines; the first pattern that fits decides."""
    raw = F.col(line)
    part = lambda i: F.regexp_extract(raw, AUTH_LINE, i)
    msg = part(5)
    kind = (
        F.when(msg.rlike(AUTH_OK), "ok").when(msg.rlike(AUTH_FAIL), "fail").when(msg.rlike(KERBEROS_TGS), "tgs")
        .when(msg.rlike(KERBEROS_AS) & msg.rlike(PREAUTH_FAILED), "as_fail")
    )
    pick = lambda ok, fail, tgs, as_: F.when(F.col("kind") == "ok", F.regexp_extract(msg, AUTH_OK, ok) if ok else None).when(F.col("kind") == "fail", F.regexp_extract(msg, AUTH_FAIL, fail) if fail else None).when(F.col("kind") == "tgs", F.regexp_extract(msg, KERBEROS_TGS, tgs) if tgs else None).when(F.col("kind") == "as_fail", F.regexp_extract(msg, KERBEROS_AS, as_) if as_ else None)
    out = lines.filter(raw.rlike(AUTH_LINE)).withColumn("kind", kind).filter("kind is not null")
    return out.withColumns({"time": syslog_time(part(1), part(2), part(3), year), "host": part(4), "user": F.lower(pick(2, 1, 1, 1)), "src": pick(3, 2, 0, 0), "method": pick(1, 0, 0, 0), "service": pick(0, 0, 2, 0)})


def timeline_events(lines: DataFrame, year: int, line: str = "line") -> DataFrame:
    """time, host, category, severity, actor of lines that the timeline knows."""
    raw = F.col(line)
    fact = F.lit(None)
    for pattern, category, severity in reversed(TIMELINE):
        fact = F.when(raw.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.regexp_extract(raw, pattern, 1).alias("actor"))).otherwise(fact)
    sys = lambda i: F.regexp_extract(raw, SYSLOG, i)
    out = lines.withColumn("_f", fact).filter("_f is not null")
    return out.select(line, syslog_time(sys(1), sys(2), sys(3), year).alias("time"), sys(4).alias("host"), "_f.*")
