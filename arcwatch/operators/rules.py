"""Detection rules compiled to Columns.

A rule is data: named selections or strings and a condition.  A condition is
compiled once, on the driver, to one boolean Column; nothing is evaluated per
row in Python and nothing goes through eval.  Missing fields make a test false,
never null, so ``not`` means what it says.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from fnmatch import fnmatchcase
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy
from . import scanning

_TOKEN = re.compile(r"\s*(\(|\)|[^\s()]+)")


def condition(text: str, parts: Mapping[str, Column]) -> Column:
    """and, or, not, parentheses; ``N|any|all|none of them|pattern*``."""
    words = _TOKEN.findall(text)
    at = 0

    def peek(ahead: int = 0) -> str:
        return words[at + ahead].lower() if at + ahead < len(words) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1]

    def group(count: str) -> Column:
        pattern = take()
        if pattern == "(":
            pattern = take()
            take()
        named = [c for n, c in parts.items() if pattern == "them" or fnmatchcase(n, pattern)]
        hits = reduce(lambda a, b: a + b, (c.cast("int") for c in named), F.lit(0))
        if count == "none":
            return hits == 0
        return hits >= (len(named) if count == "all" else 1 if count == "any" else int(count)) if named else F.lit(False)

    def unary() -> Column:
        if peek() == "not":
            take()
            return ~unary()
        if peek() == "(":
            take()
            inner = either()
            take()
            return inner
        if peek(1) == "of":
            count = take().lower()
            take()
            return group(count)
        return parts[take()]

    def both() -> Column:
        out = unary()
        while peek() == "and":
            take()
            out = out & unary()
        return out

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    return either()


# -- Sigma ------------------------------------------------------------------------


def _matches(text: Column, pattern: str) -> Column:
    """A pattern that is no regular expression matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return text.rlike(pattern)


def _value(field: Column, expected, modifier: str) -> Column:
    text = F.lower(field.cast("string"))
    want = str(expected).lower()
    if modifier == "re":
        return _matches(field.cast("string"), f"(?i){expected}")
    if modifier in ("contains", "startswith", "endswith"):
        return getattr(text, modifier)(F.lit(want))
    if isinstance(expected, (int, float)) and not isinstance(expected, bool):
        return field.cast("string").try_cast("double") == float(expected)
    return text == want


def selection(chosen: Mapping | list, resolve: Callable[[str], Column]) -> Column:
    """All fields of a mapping; any mapping of a list; any value of a field,
    or all with the ``all`` modifier."""
    if isinstance(chosen, list):
        return reduce(or_, (selection(c, resolve) for c in chosen))
    tests = []
    for key, expected in chosen.items():
        name, *modifiers = key.split("|")
        how = next((m for m in modifiers if m != "all"), "")
        each = [F.coalesce(_value(resolve(name), v, how), F.lit(False)) for v in (expected if isinstance(expected, list) else [expected])]
        tests.append(reduce(and_ if "all" in modifiers else or_, each))
    return reduce(and_, tests)


def sigma(rule: Mapping, resolve: Callable[[str], Column]) -> Column:
    found = {k: selection(v, resolve) for k, v in rule["detection"].items() if k != "condition"}
    text = rule["detection"].get("condition", "")
    return condition(text, found) if text else reduce(and_, found.values())


def load_sigma(folder: str) -> list[dict]:
    """The rules of a folder of YAML files, by name; files without a detection
    are left out."""
    from pathlib import Path

    import yaml

    files = sorted(p for p in Path(folder).iterdir() if p.suffix in (".yml", ".yaml"))
    rules = [r for p in files for r in yaml.safe_load_all(p.read_text()) if isinstance(r, dict)]
    return [r for r in rules if "detection" in r]


def firing(df: DataFrame, rules: list[Mapping], compiled: Callable[[Mapping], Column], name: str = "title", facts: tuple[str, ...] = ("level",)) -> DataFrame:
    """One row for each row and rule that fires, in one pass over df."""
    hit = [F.when(compiled(r), F.struct(F.lit(r[name]).alias("rule"), *[F.lit(r[f]).alias(f) for f in facts])) for r in rules]
    return df.withColumn("_hit", F.explode(F.filter(F.array(*hit), lambda h: h.isNotNull()))).select("*", "_hit.*").drop("_hit")


def techniques(rule: Mapping) -> list[str]:
    """ATT&CK ids of a rule's tags."""
    return [t[7:].upper() for t in rule.get("tags", []) if re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", t)]


# -- fixed values: the shipped pack ------------------------------------------------
SIGMA_PACK = [
    {
        "title": "crypto_spike",
        "level": "critical",
        "tags": ["attack.t1486", "attack.t1496"],
        "detection": {"selection": {"event_type": "crypto_spike"}, "condition": "selection"},
    },
    {
        "title": "inhibit_recovery",
        "level": "critical",
        "tags": ["attack.t1490"],
        "detection": {"selection": {"event_type": "shadow"}, "condition": "selection"},
    },
    {
        "title": "webshell_spawn",
        "level": "high",
        "tags": ["attack.t1505.003", "attack.t1059"],
        "detection": {"selection": {"event_type": "process", "details.reason": "web_server_spawned_shell"}, "condition": "selection"},
    },
    {
        "title": "suspicious_exec_path",
        "level": "high",
        "tags": ["attack.t1036.005"],
        "detection": {"selection": {"event_type": "process", "details.reason": "suspicious_exec_path"}, "condition": "selection"},
    },
    {
        "title": "c2_nonstandard_port",
        "level": "medium",
        "tags": ["attack.t1571"],
        "detection": {"selection": {"event_type": "network", "details.dest_port": [4444, 1337, 6666, 9001, 31337]}, "condition": "selection"},
    },
    {
        "title": "agent_tamper",
        "level": "high",
        "tags": ["attack.t1562.001"],
        "detection": {"selection": {"event_type": "agent_silence"}, "condition": "selection"},
    },
    {
        "title": "encoded_powershell",
        "level": "high",
        "tags": ["attack.t1059.001", "attack.t1027"],
        "detection": {"selection": {"event_type": "powershell", "details.cmdline|contains": [" -enc ", "-encodedcommand", "frombase64string", "iex(new-object", "downloadstring"]}, "condition": "selection"},
    },
    {
        "title": "byovd_driver_load",
        "level": "critical",
        "tags": ["attack.t1068"],
        "detection": {"selection": {"event_type": "driver_load", "details.driver_name|contains": ["rtcore64", "gdrv", "dbutil", "procexp", "aswarpot", "kprocesshacker"]}, "condition": "selection"},
    },
    {
        "title": "rmm_tool_abuse",
        "level": "high",
        "tags": ["attack.t1219"],
        "detection": {"selection": {"event_type": "rmm_tool", "details.tool|contains": ["anydesk", "screenconnect", "connectwise", "teamviewer", "atera", "splashtop", "ngrok"]}, "condition": "selection"},
    },
    {
        "title": "cloud_exfil",
        "level": "high",
        "tags": ["attack.t1567.002"],
        "detection": {"selection": {"event_type": "cloud_exfil"}, "condition": "selection"},
    },
    {
        "title": "esxi_ransomware",
        "level": "critical",
        "tags": ["attack.t1486"],
        "detection": {"selection": {"event_type": "ransomware_esxi"}, "condition": "selection"},
    },
    {
        "title": "kerberoasting",
        "level": "high",
        "tags": ["attack.t1558.003"],
        "detection": {"selection": {"event_type": "cred_dump", "details.reason": "kerberoast"}, "condition": "selection"},
    },
    {
        "title": "lolbin_proxy_exec",
        "level": "high",
        "tags": ["attack.t1218"],
        "detection": {"selection": {"event_type": "lolbin", "details.binary|contains": ["rundll32", "mshta", "regsvr32", "msiexec", "installutil", "wmic"]}, "condition": "selection"},
    },
    {
        "title": "persistence_mechanisms",
        "level": "high",
        "tags": ["attack.t1053", "attack.t1546.003", "attack.t1136"],
        "detection": {"selection": {"event_type": "persistence", "details.reason": ["scheduled_task", "wmi_subscription", "new_account"]}, "condition": "selection"},
    },
    {
        "title": "mfa_fatigue",
        "level": "high",
        "tags": ["attack.t1621"],
        "detection": {"selection": {"event_type": "mfa_fatigue"}, "condition": "selection"},
    },
]

#: Our own, for dumps of credentials that no shipped rule confirms.
OWN_RULES = [
    {
        "title": "lsass_dump",
        "level": "critical",
        "tags": ["attack.t1003.001"],
        "detection": {"selection": {"event_type": "cred_dump", "details.reason": "lsass_dump"}, "condition": "selection"},
    },
]

#: name, regex (case-insensitive), severity, technique, score
LOG_RULES = [
    ("ssh_brute_force", r"Failed password for .+ from (?P<ip>[\d.]+)", "high", "T1110.001", 15),
    ("ssh_invalid_user", r"Invalid user (?P<user>\S+) from (?P<ip>[\d.]+)", "medium", "T1110.003", 10),
    ("sudo_failure", r"sudo:.*authentication failure.*user=(?P<user>\S+)", "high", "T1548.003", 20),
    ("su_failure", r"su: FAILED SU.*to (?P<user>\S+) by (?P<actor>\S+)", "medium", "T1548.003", 15),
    ("account_lockout", r"(account locked|too many auth|pam_tally2.*locked)", "high", "T1110", 25),
    ("root_login", r"Accepted .+ for root from (?P<ip>[\d.]+)", "critical", "T1078", 40),
    ("accepted_password", r"Accepted password for (?P<user>\S+) from (?P<ip>[\d.]+)", "low", "T1078", 5),
    ("web_sqli", r"(?:union\s+select|select.*from|or\s+1=1|'\s*or\s*'|information_schema)", "critical", "T1190", 35),
    ("web_xss", r"<script[\s>]|javascript:|on(?:load|click|error|mouseover)\s*=", "high", "T1059.007", 25),
    ("web_traversal", r"\.\./|\.\.\\|%2e%2e%2f|%252e%252e", "high", "T1083", 30),
    ("web_rce", r"(?:/etc/passwd|/bin/bash|cmd\.exe|powershell|eval\(|base64_decode)", "critical", "T1059", 45),
    ("web_scanner", r"(?:nikto|nmap|sqlmap|masscan|gobuster|dirbuster|wfuzz|nuclei)", "medium", "T1595", 20),
    ("web_4xx_flood", r'" (?:400|401|403|404|405) ', "low", "T1595.003", 5),
    ("cron_added", r"(?:crontab|cron\.d|at\.allow|at\.deny)", "medium", "T1053.003", 20),
    ("systemd_unit", r"systemctl.*(enable|start|daemon-reload)|\.service.*created", "medium", "T1543.002", 15),
    ("ssh_key_added", r"authorized_keys|\.ssh/", "high", "T1098.004", 30),
    ("new_user_created", r"(?:useradd|adduser|net user.*\/add|New user|user added)", "high", "T1136.001", 30),
    ("group_modification", r"(?:usermod|groupadd|gpasswd|net localgroup)", "medium", "T1098", 15),
    ("large_outbound", r'" \d{3} (?P<bytes>[0-9]{7,}) ', "medium", "T1030", 20),
    ("base64_payload", r"(?:base64|b64decode|frombase64|ToBase64)", "medium", "T1027", 15),
    ("temp_execution", r"(?:/tmp/|/dev/shm/|/var/tmp/|\\Temp\\|\\AppData\\Local\\Temp\\)", "high", "T1059", 25),
    ("wget_curl_pipe", r"(?:wget|curl).*\|\s*(?:bash|sh|python|perl|ruby)", "critical", "T1059", 45),
    ("reverse_shell", r"(?:nc -e|/bin/bash -i|bash -i|python.*socket|socat.*exec)", "critical", "T1059.004", 50),
]

#: What the groups of these patterns name.
CAPTURES = ("ip", "user", "actor", "bytes")

#: Texts of which a line must hold one, in lower case, for a rule to match at all.
NEEDED = {
    "ssh_brute_force": ["failed password for"],
    "ssh_invalid_user": ["invalid user "],
    "sudo_failure": ["sudo:"],
    "su_failure": ["su: failed su"],
    "account_lockout": ["account locked", "too many auth", "pam_tally2"],
    "root_login": [" for root from "],
    "accepted_password": ["accepted password for "],
    "web_sqli": ["select", "1=1", "'", "information_schema"],
    "web_xss": ["<script", "javascript:", "onload", "onclick", "onerror", "onmouseover"],
    "web_traversal": ["../", "..\\", "%2e%2e%2f", "%252e%252e"],
    "web_rce": ["/etc/passwd", "/bin/bash", "cmd.exe", "powershell", "eval(", "base64_decode"],
    "web_scanner": ["nikto", "nmap", "sqlmap", "masscan", "gobuster", "dirbuster", "wfuzz", "nuclei"],
    "web_4xx_flood": ['" 4'],
    "cron_added": ["crontab", "cron.d", "at.allow", "at.deny"],
    "systemd_unit": ["systemctl", ".service"],
    "ssh_key_added": ["authorized_keys", ".ssh/"],
    "new_user_created": ["useradd", "adduser", "net user", "new user", "user added"],
    "group_modification": ["usermod", "groupadd", "gpasswd", "net localgroup"],
    "large_outbound": ['" '],
    "base64_payload": ["base64", "b64decode"],
    "temp_execution": ["/tmp/", "/dev/shm/", "\\temp\\"],
    "wget_curl_pipe": ["wget", "curl"],
    "reverse_shell": ["nc -e", "bash -i", "python", "socat"],
}

#: name, regex (case-insensitive); first match
WEBSHELLS = [
    ("php_eval", r"eval\s*\(\s*(base64_decode|gzinflate|str_rot13|gzuncompress)\s*\("),
    ("php_system", r"\$_(GET|POST|REQUEST|COOKIE)\s*\[.*\]\s*\)"),
    ("php_passthru", r"(passthru|shell_exec|popen|proc_open|system)\s*\("),
    ("asp_exec", r"CreateObject\s*\(\s*[\"']WScript\.Shell[\"']"),
    ("jsp_runtime", r"Runtime\.getRuntime\(\)\.exec\s*\("),
    ("generic_base64", r"(?:echo|print)\s+base64_decode\s*\("),
    ("py_exec", r"exec\s*\(\s*(?:compile|__import__)\s*\("),
]
# ----------------------------------------------------------------------------------


def log_rules(lines: DataFrame, text: str = "line") -> DataFrame:
    """Every log rule that each line matches, with where, and the address, user,
    actor and bytes that the rule names (null where it names none)."""
    patterns = {n: p for n, p, *_ in LOG_RULES}
    out = lines.withColumn("_hit", F.explode(scanning.regex_hits(F.col(text), patterns, NEEDED, CAPTURES)))
    facts = {k: {r[0]: r[i] for r in LOG_RULES} for i, k in ((2, "severity"), (3, "mitre"), (4, "score"))}
    return out.select("*", "_hit.*").drop("_hit").withColumns({k: taxonomy.lookup(F.col("rule"), v) for k, v in facts.items()})


def top_addresses(hits: DataFrame, n: int = 10) -> DataFrame:
    """The addresses that most hits name (ties: by address)."""
    return hits.filter("ip <> ''").groupBy("ip").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "ip").limit(n)


def log_summary(hits: DataFrame) -> DataFrame:
    """field, value, n, score: all hits, by severity, the 10 most frequent rules
    and addresses."""
    n, score = F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("score")

    def by(field: str, most: int | None = None) -> DataFrame:
        out = hits.filter(F.col(field).isNotNull()).groupBy(F.lit(field).alias("field"), F.col(field).alias("value")).agg(n, score)
        return out.orderBy(F.desc("n"), "value").limit(most) if most else out

    total = hits.agg(n, score).select(F.lit("total").alias("field"), F.lit("hits").alias("value"), "n", "score")
    return reduce(DataFrame.unionByName, [total, by("severity"), by("rule", 10), by("ip", 10)])


def first_match(text: Column, named: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(named):
        out = F.when(text.rlike(f"(?is){pattern}"), name).otherwise(out)
    return out


# -- byte patterns (the YARA-like rules) ------------------------------------------


def string_test(spec: dict | str, data: Column) -> Column:
    """One string of a rule as a test over bytes read as ISO-8859-1 text.

    text, hex (?? for any byte) or regex; nocase; wide (UTF-16LE too); xor with
    a key; fullword; at an offset, or within two offsets.
    """
    spec = {"text": spec} if isinstance(spec, str) else spec
    flag = "(?is)" if spec.get("nocase") else "(?s)"
    if "hex" in spec:
        bodies = ["".join("." if b == "??" else f"\\x{b}" for b in spec["hex"].split())]
    elif "regex" in spec:
        bodies = [spec["regex"]]
    else:
        raw = spec["text"].encode()
        plain = bytes(b ^ spec["xor"] for b in raw) if spec.get("xor") else raw
        forms = [plain] + [spec["text"].encode("utf-16-le")] * bool(spec.get("wide"))
        if len(forms) == 1 and not {"at", "within", "fullword"} & spec.keys():
            text = plain.decode("latin-1")
            return F.contains(F.lower(data), F.lit(text.lower())) if spec.get("nocase") else F.contains(data, F.lit(text))
        bodies = ["".join(f"\\x{b:02x}" for b in form) for form in forms]
    body = "(?:" + "|".join(bodies) + ")"
    if spec.get("fullword"):
        body = f"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])"
    if "at" in spec:
        body = f"^.{{{spec['at']}}}{body}"
    elif "within" in spec:
        body = f"^.{{{spec['within'][0]},{spec['within'][1]}}}?{body}"
    return _matches(data, flag + body)


def byte_rule(rule: Mapping, data: Column) -> Column:
    """A rule over bytes read as ISO-8859-1 text, so one byte is one character.

    ``max_size`` and ``min_entropy`` are further conditions.
    """
    parts = {n: F.coalesce(string_test(s, data), F.lit(False)) for n, s in rule["strings"].items()}
    out = condition(rule["condition"], parts)
    if "max_size" in rule:
        out = out & (F.length(data) < rule["max_size"])
    if "min_entropy" in rule:
        from ..functions.text import entropy

        out = out & (entropy(data) > rule["min_entropy"])
    return out


def scan(df: DataFrame, rules: list[Mapping], data: Column) -> DataFrame:
    """One row for each row and rule that fires on bytes, with ``offsets``: where
    each string of the rule is found (map<string, array<int>>).

    All strings of all rules are sought in one pass; conditions are Columns over
    what was found.
    """
    strings = {f"{n}.{s}": {"text": spec} if isinstance(spec, str) else spec for n, r in enumerate(rules) for s, spec in r["strings"].items()}
    found = df.withColumn("_at", scanning.string_offsets(data, strings))

    def place(key: str) -> Column:
        spec, at = strings[key], F.try_element_at("_at", F.lit(key))
        if "at" in spec:
            return F.coalesce(F.array_contains(at, F.lit(spec["at"])), F.lit(False))
        if "within" in spec:
            return F.coalesce(F.exists(at, lambda o: o.between(*spec["within"])), F.lit(False))
        return at.isNotNull()

    def test(n: int, rule: Mapping) -> Column:
        out = condition(rule["condition"], {s: place(f"{n}.{s}") for s in rule["strings"]})
        if "max_size" in rule:
            out = out & (F.octet_length(data) < rule["max_size"])
        if "min_entropy" in rule:
            # most rows fail on their strings, and their bytes are not sent to be measured
            out = out & F.coalesce(scanning.byte_entropy(F.when(out, data)) > rule["min_entropy"], F.lit(False))
        return out

    def own(n: int, rule: Mapping) -> Column:
        each = [F.struct(F.lit(s).alias("key"), F.try_element_at("_at", F.lit(f"{n}.{s}")).alias("value")) for s in rule["strings"]]
        return F.map_from_entries(F.filter(F.array(*each), lambda e: e["value"].isNotNull()))

    hit = [F.when(test(n, r), F.struct(F.lit(r["title"]).alias("rule"), F.lit(r["level"]).alias("level"), own(n, r).alias("offsets"))) for n, r in enumerate(rules)]
    return found.withColumn("_hit", F.explode(F.filter(F.array(*hit), lambda h: h.isNotNull()))).select("*", "_hit.*").drop("_hit", "_at")


# -- fixed values: the shipped byte rules -------------------------------------------
BYTE_RULES = [
    {
        "title": "shadow_copy_deletion",
        "level": "critical",
        "strings": {"s1": {"text": "vssadmin delete shadows", "nocase": True}, "s2": {"text": "wmic shadowcopy delete", "nocase": True}, "s3": {"text": "bcdedit /set {default} recoveryenabled no", "nocase": True}, "s4": {"text": "wbadmin delete catalog", "nocase": True}, "s5": {"text": "diskshadow /s", "nocase": True}},
        "condition": "any of (s*)",
    },
    {
        "title": "ransom_note",
        "level": "critical",
        "strings": {"n1": {"text": "YOUR FILES HAVE BEEN ENCRYPTED", "nocase": True}, "n2": {"text": "All your files are encrypted", "nocase": True}, "n3": {"text": "DECRYPT_INSTRUCTIONS", "nocase": True}, "n4": {"text": "HOW_TO_RECOVER", "nocase": True}, "n5": {"text": "bitcoin", "nocase": True}, "n6": {"text": "onion", "nocase": True}, "e1": ".locked", "e2": ".encrypted", "e3": ".WNCRY", "e4": ".zepto", "e5": ".locky", "e6": ".cerber"},
        "condition": "(2 of (n*)) or (any of (e*) and any of (n*))",
    },
    {
        "title": "webshell_php",
        "level": "critical",
        "strings": {"eval1": {"regex": r"eval\s*\(\s*(base64_decode|gzinflate|str_rot13|gzuncompress)\s*\(", "nocase": True}, "eval2": {"regex": r"assert\s*\(\s*(base64_decode|gzinflate|str_rot13)\s*\(", "nocase": True}, "super": {"regex": r"\$_(GET|POST|REQUEST|COOKIE)\s*\[", "nocase": True}, "exec1": {"text": "passthru", "nocase": True}, "exec2": {"text": "shell_exec", "nocase": True}, "exec3": {"text": "proc_open", "nocase": True}},
        "condition": "(eval1 or eval2) or ((exec1 or exec2 or exec3) and super)",
    },
    {
        "title": "credential_dumper",
        "level": "critical",
        "strings": {"m1": {"text": "sekurlsa::logonpasswords", "nocase": True}, "m2": {"text": "lsadump::sam", "nocase": True}, "m3": {"text": "privilege::debug", "nocase": True}, "m4": {"text": "SekurLSA", "nocase": True}, "m5": {"text": "gentilkiwi", "nocase": True}, "hex": {"hex": "6B 69 77 69"}},
        "condition": "2 of (m*) or hex",
    },
    {
        "title": "reverse_shell",
        "level": "critical",
        "strings": {"s1": {"text": "bash -i >& /dev/tcp/", "nocase": True}, "s2": {"text": "nc -e /bin/bash", "nocase": True}, "s3": {"text": "nc -e /bin/sh", "nocase": True}, "s4": {"text": "import socket,subprocess,os", "nocase": True}, "s5": {"text": "socat exec:", "nocase": True}, "bash2": "/bin/bash -i", "py2": {"regex": r"socket\.connect\(.{5,50}\).*subprocess", "nocase": True}},
        "condition": "any of them",
    },
    {
        "title": "packed_pe",
        "level": "high",
        "strings": {"mz": {"hex": "4D 5A", "at": 0}, "pe": {"hex": "50 45 00 00"}},
        "condition": "mz and pe",
        "max_size": 10485760,
        "min_entropy": 7.2,
    },
    {
        "title": "dropper_base64",
        "level": "high",
        "strings": {"b1": {"regex": r"base64[_\-]?decode", "nocase": True}, "b2": {"text": "FromBase64String", "nocase": True}, "b3": {"text": "base64 -d", "nocase": True}, "x1": {"text": "exec(", "nocase": True}, "x2": {"text": "eval(", "nocase": True}, "x3": {"text": "Invoke-Expression", "nocase": True}, "x4": {"text": "IEX(", "nocase": True}},
        "condition": "(any of (b*)) and (any of (x*))",
    },
    {
        "title": "cron_download",
        "level": "high",
        "strings": {"cron": "* * * * *", "dl1": {"text": "wget ", "nocase": True}, "dl2": {"text": "curl ", "nocase": True}, "ex1": {"text": "| bash", "nocase": True}, "ex2": {"text": "| sh", "nocase": True}, "ex3": {"text": "/tmp/", "nocase": True}},
        "condition": "cron and (any of (dl*)) and (any of (ex*))",
    },
    {
        "title": "port_scan_tool",
        "level": "medium",
        "strings": {"t1": {"text": "nmap", "nocase": True}, "t2": {"text": "masscan", "nocase": True}, "t3": {"text": "zmap", "nocase": True}, "t4": {"text": "unicornscan", "nocase": True}, "t5": {"text": "rustscan", "nocase": True}, "s1": {"text": "--open --script", "nocase": True}, "s2": {"text": "-sV -sC", "nocase": True}, "s3": {"text": "SYN scan", "nocase": True}},
        "condition": "any of (t*) and any of (s*)",
    },
]
# ----------------------------------------------------------------------------------
