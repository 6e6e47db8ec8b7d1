"""What packets carry: DNS questions, HTTP requests and responses, the name a
TLS client asks for.  HTTP is read by Columns; the two wire formats are decoded
in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import entropy


def _dns_name(data: bytes, at: int) -> tuple[str, int]:
    """A name with its compression pointers followed, and where it ends."""
    labels: list[str] = []
    end = None
    for _ in range(128):
        if at >= len(data):
            break
        size = data[at]
        if size == 0:
            at += 1
            break
        if size & 0xC0 == 0xC0:
            end = at + 2 if end is None else end
            at = (size & 0x3F) << 8 | data[at + 1]
            continue
        labels.append(data[at + 1 : at + 1 + size].decode("ascii", "replace"))
        at += 1 + size
    return ".".join(labels), at if end is None else end


def dns_message(data: bytes | None) -> tuple | None:
    """(id, is_response, [(name, type)]) of a DNS message, or None."""
    if data is None or len(data) < 12:
        return None
    number = lambda i: int.from_bytes(data[i : i + 2], "big")
    at, queries = 12, []
    try:
        for _ in range(number(4)):
            name, at = _dns_name(data, at)
            if at + 4 > len(data):
                break
            queries.append((name, number(at)))
            at += 4
    except IndexError:
        return None
    return number(0), bool(data[2] & 0x80), queries


def server_name(data: bytes | None) -> str | None:
    """The server name of a TLS ClientHello, or None."""
    if data is None or len(data) < 5 or data[0] != 0x16 or len(data) < 5 + int.from_bytes(data[3:5], "big"):
        return None
    hello = data[5:]
    number = lambda i: int.from_bytes(hello[i : i + 2], "big")
    try:
        if hello[0] != 1:
            return None
        at = 38
        at += 1 + hello[at]
        at += 2 + number(at)
        at += 1 + hello[at]
        end = at + 2 + number(at)
        at += 2
        while at + 4 <= end:
            kind, size = number(at), number(at + 2)
            at += 4
            if kind == 0 and at + 5 <= end:
                length = number(at + 3)
                return hello[at + 5 : at + 5 + length].decode("ascii", "replace") if at + 5 + length <= end else None
            at += size
    except IndexError:
        return None
    return None


_QUERY = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.IntegerType())])
_DNS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("is_response", T.BooleanType()), T.StructField("queries", T.ArrayType(_QUERY))])


@F.pandas_udf(_DNS)
def dns(payload: pd.Series) -> pd.DataFrame:
    rows = [dns_message(p) or (None, None, None) for p in payload]
    found = [None if q is None else [{"name": n, "type": t} for n, t in q] for *_, q in rows]
    return pd.DataFrame({"id": pd.array([r[0] for r in rows], "Int32"), "is_response": pd.array([r[1] for r in rows], "boolean"), "queries": pd.Series(found, dtype=object)})


@F.pandas_udf(T.StringType())
def sni(payload: pd.Series) -> pd.Series:
    return payload.map(server_name)


def http(payload: Column) -> Column:
    """(type, method, uri, status, reason, host, user_agent) of HTTP/1.x."""
    text = F.decode(payload, "ISO-8859-1")
    line = F.substring_index(text, "\r\n", 1)
    parts = F.split(line, " ", 3)
    request = line.rlike(r"^(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\S* ")
    response = line.startswith("HTTP/")
    header = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{name}:\s*([^\r\n]*)", 1)), F.lit(""))
    pick = lambda i: F.get(parts, F.lit(i))
    return F.when(
        request | response,
        F.struct(
            F.when(request, "request").otherwise("response").alias("type"),
            F.when(request, pick(0)).alias("method"), F.when(request, pick(1)).alias("uri"),
            F.when(response, pick(1).try_cast("int")).alias("status"), F.when(response, pick(2)).alias("reason"),
            F.when(request, header("host")).alias("host"), F.when(request, header("user-agent")).alias("user_agent"),
        ),
    )


def dns_queries(packets: DataFrame) -> DataFrame:
    """Questions of DNS packets (udp to port 53): us, src_ip, name."""
    asked = packets.filter("transport = 'udp' and dst_port = 53 and length(payload) > 0").withColumn("_d", dns("payload"))
    return asked.select("us", "src_ip", "frame_no", F.explode("_d.queries").alias("_q")).select("us", "src_ip", "frame_no", "_q.name")


def tunnelled_names(queries: DataFrame, length: int = 20, least: float = 3.5) -> DataFrame:
    """Each source and name once whose labels before the last two are long and
    random, with the first such label (src_ip, name, us)."""
    parts = F.split("name", r"\.")
    labels = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0)))
    odd = F.filter(labels, lambda v: (F.length(v) > length) & (entropy(v) > least))
    found = queries.withColumn("label", F.get(odd, F.lit(0))).filter("label is not null")
    return found.groupBy("src_ip", "name").agg(F.min("us").alias("us"), F.first("label").alias("label"))
