"""Measures of bytes that have no Column form: BLAKE2b, program headers inside
a region, entropy of a program's sections.  Each takes a binary column in Arrow
batches; null gives null."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a section whose entropy is taken.
SAMPLE = 1 << 16
_PLACE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("at", T.LongType())])
_SECTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("entropy", T.DoubleType())])


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def _program(data: bytes, at: int) -> int | None:
    """Where the PE header of the program at a place is, if it has one."""
    if at + 64 >= len(data):
        return None
    header = at + _u32(data, at + 60)
    return header if data[header : header + 4] == b"PE\0\0" else None


def program_places(data: bytes) -> list[tuple[str, int]]:
    """(PE or ELF, offset) of every program header in a region."""
    found = [("PE", m.start()) for m in re.finditer(b"MZ", data) if _program(data, m.start()) is not None]
    return found + [("ELF", m.start()) for m in re.finditer(b"\x7fELF", data)]


def byte_entropy(data: bytes) -> float:
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


def section_entropies(data: bytes) -> list[tuple[str, float]]:
    """Name and entropy of the sections of a PE program, as far as they are whole."""
    header = _program(data, 0) if data[:2] == b"MZ" else None
    if header is None:
        return []
    count, skip = int.from_bytes(data[header + 6 : header + 8], "little"), int.from_bytes(data[header + 20 : header + 22], "little")
    out = []
    for at in range(header + 24 + skip, header + 24 + skip + 40 * count, 40):
        if at + 40 > len(data):
            break
        size, start = _u32(data, at + 16), _u32(data, at + 20)
        body = data[start : start + min(size, SAMPLE)] if start else b""
        out.append((data[at : at + 8].rstrip(b"\0").decode("ascii", "replace"), byte_entropy(body)))
    return out


@F.pandas_udf(T.StringType())
def blake2b(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else hashlib.blake2b(d, digest_size=32).hexdigest())


@F.pandas_udf(T.ArrayType(_PLACE))
def programs(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else [{"kind": k, "at": at} for k, at in program_places(d)])


@F.pandas_udf(T.ArrayType(_SECTION))
def sections(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else [{"name": n, "entropy": e} for n, e in section_entropies(d)])
