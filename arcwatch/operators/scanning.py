"""Many texts sought at once: one automaton for the literals of all rules.

Texts go through Arrow batches, and each is read once, however many rules there
are.  A rule's regular expression is tried only where a literal that it needs was
met.  Case is that of ASCII letters alone, offsets are code points of the text
(bytes, for binary columns).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """ASCII letters to lower case; as long as before."""
    return text.lower() if text.isascii() else text.translate(_LOW)


def automaton(literals: Iterable[tuple[str, object]]) -> ahocorasick.Automaton | None:
    """Of literals, each with what it stands for; equal ones stand for all."""
    met: dict[str, list] = {}
    for text, value in literals:
        met.setdefault(text, []).append(value)
    if not met:
        return None
    out = ahocorasick.Automaton()
    for text, values in met.items():
        out.add_word(text, (len(text), tuple(values)))
    out.make_automaton()
    return out


@cache
def _regexes(spec: tuple) -> tuple[ahocorasick.Automaton | None, list[re.Pattern]]:
    """Built once a worker from (pattern, texts it needs) of each rule."""
    literals = automaton((text, n) for n, (_, needed) in enumerate(spec) for text in needed)
    return literals, [re.compile(p, re.IGNORECASE | re.ASCII) for p, _ in spec]


def regex_hits(text: Column, patterns: Mapping[str, str], needed: Mapping[str, list[str]], captures: tuple[str, ...]) -> Column:
    """array<struct<rule, at, captures...>>: every rule whose pattern (case of
    ASCII letters ignored) is in the text, in the order of the rules, with where
    it first matches and what its named groups hold.

    needed: texts in lower case of which a rule's matches hold one.
    """
    names = list(patterns)
    fields = [("rule", pa.string()), ("at", pa.int32()), *[(c, pa.string()) for c in captures]]

    spec = tuple((p, tuple(needed[name])) for name, p in patterns.items())

    @F.arrow_udf("array<struct<" + ",".join(["rule:string", "at:int", *[f"{c}:string" for c in captures]]) + ">>")
    def run(texts: pa.Array) -> pa.Array:
        literals, compiled = _regexes(spec)
        rows = []
        for cell in texts:
            line = cell.as_py()
            found = []
            if line:
                met = {n for _, (_, rules) in literals.iter(lowered(line)) for n in rules}
                for n in sorted(met):
                    m = compiled[n].search(line)
                    if m:
                        groups = m.groupdict()
                        found.append({"rule": names[n], "at": m.start(), **{c: groups.get(c) for c in captures}})
            rows.append(found)
        return pa.array(rows, pa.list_(pa.struct(fields)))

    return run(text)


@cache
def _word(byte: int) -> bool:
    return chr(byte).isalnum() and byte < 128 or byte == 95


@cache
def _strings(spec: tuple) -> tuple[ahocorasick.Automaton | None, ahocorasick.Automaton | None, list[tuple[str, re.Pattern]]]:
    """Built once a worker: literals as they are, literals in lower case, and
    patterns over bytes.  One byte is one character of an automaton."""
    exact, folded, patterns = [], [], []
    for name, facts in spec:
        of = dict(facts)
        if "hex" in of and "??" not in of["hex"]:
            exact.append((bytes.fromhex(of["hex"]).decode("latin-1"), name))
        elif "hex" in of:
            body = b"".join(b"." if b == "??" else re.escape(bytes.fromhex(b)) for b in of["hex"].split())
            patterns.append((name, re.compile(b"(?=" + body + b")", re.DOTALL)))
        elif "regex" in of:
            patterns.append((name, re.compile(of["regex"].encode(), re.DOTALL | (re.IGNORECASE if of.get("nocase") else 0))))
        else:
            raw = of["text"].encode()
            if of.get("nocase"):
                folded.append((raw.lower().decode("latin-1"), name))
            else:
                exact.append((bytes(b ^ of.get("xor", 0) for b in raw).decode("latin-1"), name))
            if of.get("wide"):
                exact.append((of["text"].encode("utf-16-le").decode("latin-1"), name))
    return automaton(exact), automaton(folded), patterns


def string_offsets(data: Column, strings: Mapping[str, Mapping]) -> Column:
    """map<string, array<int>>: the offsets at which each string of some rules
    is found in bytes, of those that are found at all.

    A string is a text (nocase, wide for UTF-16LE too, xor with a key, fullword),
    hex bytes (?? for any) or a regex over bytes; overlapping finds of texts and
    hex bytes count each, and those of a regex follow one another.
    """

    spec = tuple((name, tuple(sorted(of.items()))) for name, of in strings.items())
    whole = {name: len(spec["text"].encode()) for name, spec in strings.items() if spec.get("fullword") and "text" in spec}

    def alone(raw: bytes, at: int, size: int) -> bool:
        end = at + size
        return not (at > 0 and _word(raw[at - 1])) and not (end < len(raw) and _word(raw[end]))

    def offsets(raw: bytes) -> dict[str, list[int]]:
        exact, folded, patterns = _strings(spec)
        found: dict[str, set[int]] = {}
        for tree, text in ((exact, raw), (folded, raw.lower())):
            for end, (size, names) in tree.iter(text.decode("latin-1")) if tree else ():
                for name in names:
                    found.setdefault(name, set()).add(end - size + 1)
        for name, pattern in patterns:
            for m in pattern.finditer(raw):
                found.setdefault(name, set()).add(m.start())
        for name, size in whole.items():
            if name in found:
                found[name] = {at for at in found[name] if alone(raw, at, size)}
        return {name: sorted(at) for name, at in found.items() if at}

    @F.arrow_udf("map<string,array<int>>")
    def run(column: pa.Array) -> pa.Array:
        rows = [offsets(raw) if (raw := cell.as_py()) else {} for cell in column]
        return pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.list_(pa.int32())))

    return run(data)


@cache
def _tokens(tokens: tuple[str, ...]) -> ahocorasick.Automaton | None:
    return automaton((t, t) for t in tokens)


def literals_in(text: Column, tokens: Iterable[str]) -> Column:
    """array<string>: which of some literals are in a text, sorted."""
    spec = tuple(sorted({t for t in tokens if t}))

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        tree = _tokens(spec)
        rows = []
        for cell in texts:
            line = cell.as_py()
            rows.append(sorted({t for _, (_, held) in tree.iter(line) for t in held}) if line and tree else [])
        return pa.array(rows, pa.list_(pa.string()))

    return run(text)


def byte_entropy(data: Column) -> Column:
    """Bits a byte; 0 for no bytes, null for null."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for cell in column:
            raw = cell.as_py()
            n = np.bincount(np.frombuffer(raw, np.uint8)) / max(len(raw), 1) if raw is not None else None
            out.append(None if n is None else float(-(n[n > 0] * np.log2(n[n > 0])).sum()))
        return pa.array(out, pa.float64())

    return run(data)
