"""Indicators: extraction from text, type, normal form, reputation, IPv4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values ----------------------------------------------------------------
PATTERNS = {
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "md5": r"\b[0-9a-fA-F]{32}\b",
    "sha1": r"\b[0-9a-fA-F]{40}\b",
    "sha256": r"\b[0-9a-fA-F]{64}\b",
    "domain": r"\b(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,6}\b",
    "url": r"https?://[^\s\"'<>]+",
}
SECRETS = {
    "password": r"(?i)(?:password|passwd|pwd)\s*[=:]\s*[^\x00-\x1f]{4,64}",
    "token": r"(?i)(?:token|secret|api.?key|apikey)\s*[=:]\s*[^\x00-\x1f]{8,128}",
    "aws_key": r"(?i)AKIA[A-Z0-9]{16}",
    "web_token": r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]+PRIVATE KEY-----",
}
GEO_BLOCKS = [
    ("8.8.8.0/24", "US", "Mountain View"), ("1.1.1.0/24", "AU", "Sydney"),
    ("185.220.0.0/16", "DE", "Frankfurt"), ("45.135.0.0/16", "RU", "Moscow"),
    ("103.0.0.0/8", "CN", "Beijing"), ("196.0.0.0/8", "ZA", "Johannesburg"),
    ("191.0.0.0/8", "BR", "Sao Paulo"), ("80.0.0.0/8", "GB", "London"),
]
GEO_PLACES = {
    "Mountain View": (37.4, -122.1), "Sydney": (-33.9, 151.2), "Frankfurt": (50.1, 8.7), "Moscow": (55.8, 37.6),
    "Beijing": (39.9, 116.4), "Johannesburg": (-26.2, 28.0), "Sao Paulo": (-23.5, -46.6), "London": (51.5, -0.1),
}
#: Private, loopback, link-local and reserved addresses, as the registries list them.
INTERNAL_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
MALICIOUS_IPS = ["185.220.1.9", "45.135.232.4", "103.224.182.250", "194.147.78.11"]
MALICIOUS_BLOCKS = ["185.220.0.0/16", "45.135.0.0/16"]
# --------------------------------------------------------------------------------


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null unless it is four parts of 0..255."""
    parts = F.split(ip, "\\.")
    nums = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    fine = (F.size(parts) == 4) & nums[0].between(0, 255) & nums[1].between(0, 255) & nums[2].between(0, 255) & nums[3].between(0, 255)
    return F.when(fine, ((nums[0] * 256 + nums[1]) * 256 + nums[2]) * 256 + nums[3])


def block_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a block."""
    base, bits = cidr.split("/")
    first = 0
    for part in base.split("."):
        first = first * 256 + int(part)
    return first, first + (1 << (32 - int(bits))) - 1


def is_internal(number: Column) -> Column:
    out = F.lit(False)
    for block in INTERNAL_BLOCKS:
        out = out | number.between(*block_bounds(block))
    return out


#: IPv6 in full or with one run of zeros left out.
_V6 = r"^(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=(?:[0-9a-fA-F]*:){2,7}[0-9a-fA-F]*$)(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?)$"


def ioc_type(value: Column) -> Column:
    """Type of an indicator by its form, first match."""
    v = F.trim(value)
    return (
        F.when(ipv4_number(v).isNotNull() | v.rlike(_V6), "ip")
        .when(v.rlike(r"^[0-9a-fA-F]{32}$"), "md5")
        .when(v.rlike(r"^[0-9a-fA-F]{40}$"), "sha1")
        .when(v.rlike(r"^[0-9a-fA-F]{64}$"), "sha256")
        .when(v.rlike(r"^(?:http|https|ftp)://"), "url")
        .when(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(v.rlike(r"^([a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,}$"), "domain")
        .otherwise("filename")
    )


def normal_form(value: Column, kind: Column) -> Column:
    """Trimmed lower case; hashes without separators, domains without the last
    dots."""
    plain = F.lower(F.trim(value))
    return F.when(kind.isin("md5", "sha1", "sha256"), F.regexp_replace(plain, "[:-]", "")).when(kind == "domain", F.rtrim(plain, F.lit("."))).otherwise(plain)


def verdict(ip: Column) -> Column:
    """(verdict, score, source) of an address by the local lists."""
    n = ipv4_number(ip)
    as_ = lambda v, s, w: F.struct(F.lit(v).alias("verdict"), F.lit(s).alias("score"), F.lit(w).alias("source"))
    listed = F.lit(False)
    for block in MALICIOUS_BLOCKS:
        listed = listed | n.between(*block_bounds(block))
    return (
        F.when(n.isNull(), as_("invalid", 0, "-")).when(is_internal(n), as_("internal", 0, "rfc1918"))
        .when(ip.isin(MALICIOUS_IPS), as_("malicious", 95, "local-ioc")).when(listed, as_("suspicious", 70, "local-block"))
        .otherwise(as_("unknown", 30, "no-data"))
    )


def placement(ip: Column) -> Column:
    """(country, city, lat, lon, approx) of an address: its block, or a place
    drawn from its hash."""
    n = ipv4_number(ip)
    at = lambda cc, city, lat, lon, approx: F.struct(F.lit(cc).alias("country"), F.lit(city).alias("city"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(approx).alias("approx"))
    byte = lambda i: F.conv(F.substring(F.sha2(ip, 256), 2 * i + 1, 2), 16, 10).cast("int") / 255.0
    out = at("??", "unknown", F.round(byte(0) * 140 - 70, 2), F.round(byte(1) * 360 - 180, 2), True)
    for block, country, city in reversed(GEO_BLOCKS):
        out = F.when(n.between(*block_bounds(block)), at(country, city, *map(F.lit, GEO_PLACES[city]), False)).otherwise(out)
    return F.when(n.isNull(), at("??", "invalid", F.lit(0), F.lit(0), True)).when(is_internal(n), at("INTERNAL", "internal", F.lit(0), F.lit(0), False)).otherwise(out)


def reputation_tier(score: Column) -> Column:
    return F.when(score.between(0, 19), "CLEAN").when(score.between(20, 49), "SUSPICIOUS").when(score.between(50, 79), "MALICIOUS").when(score.between(80, 100), "CRITICAL").otherwise("UNKNOWN")


def extract(text: Column, kind: str) -> Column:
    """All indicators of a kind in a text, as an array."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
