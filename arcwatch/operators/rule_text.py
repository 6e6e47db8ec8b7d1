"""Byte rules written as text, read to the data that ``rules.byte_rule`` compiles.

A rule has a name, tags, meta entries, strings (text, hex or regular expression,
with nocase, wide, fullword and xor(key)) and a condition: and, or, not,
parentheses, counts (any, all, none, N of them or of ``$name*``), ``$s at N``,
``$s in (a..b)``, ``filesize`` and ``entropy(from, length)`` against a number.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import entropy
from .rules import condition, string_test

_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_RULE = re.compile(r"\brule\s+(\w+)\s*(?::\s*([\w\s]+?))?\s*\{")
_STRING = re.compile(r'\$(\w+)\s*=\s*(?:"((?:\\.|[^"\\])*)"|\{([^}]*)\}|/((?:\\.|[^/\\])+)/)([^\n$]*)')
_META = re.compile(r'(\w+)\s*=\s*"([^"]*)"')
_SIZES = {"": 1, "KB": 1 << 10, "MB": 1 << 20}


def _body_end(text: str, start: int) -> int:
    """The brace that closes the one before start, outside quotes."""
    depth, quoted, at = 1, False, start
    while at < len(text) and depth:
        c = text[at]
        if c == "\\" and quoted:
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
        at += 1
    return at - 1


def _string(found: re.Match) -> dict:
    name, text, hexa, pattern, mods = found.groups()
    spec: dict = {"nocase": "nocase" in mods, "wide": "wide" in mods, "fullword": "fullword" in mods}
    key = re.search(r"xor\(([0-9a-fA-F]{1,2})\)", mods)
    if key:
        spec["xor"] = int(key[1], 16)
    if hexa is not None:
        spec["hex"] = " ".join(re.findall(r"\?\?|[0-9a-fA-F]{2}", hexa))
    elif pattern is not None:
        spec["regex"] = pattern
    else:
        spec["text"] = re.sub(r"\\(.)", r"\1", text)
    return {name: {k: v for k, v in spec.items() if v not in (False, None)}}


def parse(text: str) -> list[dict]:
    """The rules of a text, in order: title, tags, meta, strings, condition."""
    text = _COMMENT.sub(lambda m: m[1] or " ", text)
    out = []
    for found in _RULE.finditer(text):
        body = text[found.end() : _body_end(text, found.end())]
        parts = re.split(r"\b(meta|strings|condition)\s*:", body)
        named = dict(zip(parts[1::2], parts[2::2]))
        strings: dict = {}
        for s in _STRING.finditer(named.get("strings", "")):
            strings |= _string(s)
        meta = dict(_META.findall(named.get("meta", "")))
        out.append({"title": found[1], "level": meta.get("severity", "medium"), "tags": (found[2] or "").split(), "meta": meta, "strings": strings, "condition": " ".join(named.get("condition", "").split())})
    return out


def load(folder: str) -> list[dict]:
    """The rules of all .vyr files of a folder, by file name."""
    return [r for p in sorted(Path(folder).rglob("*.vyr")) for r in parse(p.read_text(errors="replace"))]


def compile_rule(rule: Mapping, data: Column) -> Column:
    """One boolean Column over bytes read as ISO-8859-1 text.

    Tests with numbers become parts of their own, named by their place, so the
    condition left is the language of ``rules.condition``.  An empty condition
    asks for any string.
    """
    tests: dict[str, Column] = {}

    def part(test: Column) -> str:
        tests[f"test{len(tests)}"] = F.coalesce(test, F.lit(False))
        return f" test{len(tests) - 1} "

    def compare(value: Column, op: str, number: float) -> Column:
        return {"<": value < number, "<=": value <= number, ">": value > number, ">=": value >= number, "==": value == number}[op]

    strings = rule["strings"]
    text = rule["condition"] or "any of them"
    text = re.sub(r"\$(\w+)\s+at\s+(\d+)", lambda m: part(string_test(strings[m[1]] | {"at": int(m[2])}, data)), text)
    text = re.sub(r"\$(\w+)\s+in\s*\(\s*(\d+)\s*\.\.\s*(\d+)\s*\)", lambda m: part(string_test(strings[m[1]] | {"within": (int(m[2]), int(m[3]))}, data)), text)
    text = re.sub(r"filesize\s*(<=|>=|==|<|>)\s*(\d+)\s*(KB|MB|)", lambda m: part(compare(F.length(data), m[1], int(m[2]) * _SIZES[m[3]])), text)
    text = re.sub(r"entropy\(\s*(\d+)\s*,\s*(\d+|filesize)\s*\)\s*(<=|>=|==|<|>)\s*([\d.]+)", lambda m: part(compare(entropy(F.substring(data, F.lit(int(m[1]) + 1), F.length(data) if m[2] == "filesize" else F.lit(int(m[2])))), m[3], float(m[4]))), text)
    text = re.sub(r"\(\s*\$(\w*\*)\s*\)", r"( s_\1 )", text)
    text = re.sub(r"\$(\w+)", r"s_\1", text)
    text = re.sub(r"\bof\s+them\b", "of s_*", text)
    named = {f"s_{n}": F.coalesce(string_test(s, data), F.lit(False)) for n, s in strings.items()}
    return condition(text, named | tests)
