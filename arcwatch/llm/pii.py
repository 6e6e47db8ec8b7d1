"""Personal data in texts, by weak supervision.

Four kinds of spans: e-mail addresses, IP addresses, payment cards and telephone
numbers.  Strict patterns give *base* spans, which always stay.  Looser patterns
give further candidates: written-out addresses ("jo (at) site dot org"), IPv6 and
defanged addresses, cards of 13 to 15 digits or other separators, numbers without
a plus.  Seven labelers (patterns, gazetteers, words around the span) vote yes, no
or nothing on every candidate.  How often each pattern of votes occurs is counted
over all texts; expectation-maximisation on these counts (3**7 a kind at most)
estimates how each labeler votes on true and on false spans, without any label.
The posteriors then train a logistic classifier of the span's shape, its words
around and its votes, on ``SAMPLE`` candidates of each kind, base or not, drawn
by hash.  Candidates that overlap no base span are added at ``ADDED`` or more.

Patterns cost linear time: each starts at the edge of its run of characters, so
a text of one megabyte of digits or letters is read a fixed number of times.
Documents are not shuffled; a task holds the texts of one Arrow batch.

Nulls: a null or empty text, or one without personal data, has no spans.  Rows
without a doc_id and repeated rows are treated like others.  Offsets are code
points, end exclusive.  Other columns are kept and none of their names matters
but ``pii``, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fitted, table

KINDS = ("email", "ip", "card", "phone")
#: Candidates of each kind, and of base and further ones apart, that the
#: classifier learns from.
SAMPLE = 3000
ADDED = 0.5
PLACES = 1 << 13
LABELERS = 7
#: Characters before and after a span that count as its surroundings.
BEFORE, AFTER = 40, 24

CANDIDATES = "array<struct<kind:int,start:int,base:boolean,votes:int,features:array<int>>>"
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,probability:double>>"

# The strict patterns
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[\x20-]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# the looser ones
_NUMBER = re.compile(r"[0-9](?<![0-9]{2})(?:[\x20()./-]{0,2}[0-9]){6,}+")
_AT = re.compile(r"\x20?[\[({<](?:at|AT|@)[\])}>]\x20?|\x20(?:at|AT|@)\x20")
#: A text without any of these holds none: a bare "at" counts with a written dot only.
_MARKS = tuple(f"{a}{w}{b}" for a, b in ("[]", "()", "{}", "<>", "  ") for w in ("at", "AT", "@", "dot", "DOT") if (a, w.lower()) != (" ", "at")) + ("[.]", "(.)", "{.}", "<.>")
_LEFT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})\Z")
_DOT = r"(?:\x20?[\[({<](?:dot|DOT|\.)[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
_RIGHT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,4}}")
_WRITTEN = re.compile(_DOT)
_SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_DEFANGED = re.compile(r"[0-9](?<![0-9]{2})[0-9]{0,2}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])")

# Gazetteers
_NEAR = (
    re.compile(r"e-?mail|mail|contact|write|kontakt|schreib|courriel|écri|correo|escrib|adresse?|@", re.I),
    re.compile(r"\bip\b|ipv[46]|host|server|serveur|servidor|client|from|address|login|von\b|depuis|desde", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment|zahlung|paiement|pago|\bpan\b", re.I),
    re.compile(r"\btel|phone|call|mobile|cell|fax|telefon|anruf|appel|llam|móvil|handy|whatsapp|\bsms\b", re.I),
)
_AGAINST = re.compile(r"order|invoice|isbn|issn|version|\bv\b|\bid\b|\bno\b|nr\b|ref|serial|sku|total|price|date|build|section|page|bestell|rechnung|commande|facture|pedido|factura|[$€£%#=]\s*\Z", re.I)
_SITES = frozenset("com org net edu gov mil int info biz io dev app eu de fr es it nl uk us ca ch at be pt ie au jp cn br mx in".split())
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./]|[0-3]?[0-9][-./](?:0?[1-9]|1[0-2])[-./](?:19|20)[0-9]{2}")
_GROUPS = re.compile(r"\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}|\+?[0-9]{1,3}[\x20.-]\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}|00[1-9][0-9]{7,13}|0[1-9](?:[\x20.-][0-9]{2}){4}")
_FOURS = re.compile(r"[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20./-])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19}")
#: Calling codes of one and two digits; those of three start otherwise.
_CALLING = re.compile(r"1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|35[0-9]|3[78][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if at % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back to the start of its run, but not into the span before."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        rest = _DOMAIN.match(text, at) if start < at else None
        if rest:
            last = rest.end()
            yield start, last
        else:
            # the run behind this @ starts after it
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, start, end) for start, end in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """spans: disjoint and sorted."""
    low, high = 0, len(spans)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if spans[mid][1] <= start else (low, mid)
    return low < len(spans) and spans[low][0] < end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that overlap no base span."""
    found = []
    for m in _AT.finditer(text) if any(mark in text for mark in _MARKS) else ():
        left, right = _LEFT.search(text[max(0, m.start() - 64) : m.start()]), _RIGHT.match(text, m.end())
        # a bare "at" counts only with a written dot
        if left and right and (m[0].strip().lower() != "at" or _WRITTEN.search(right[0])):
            found.append((0, m.start() - len(left[0]), right.end()))
    if ":" in text:
        found += [(1, *m.span()) for m in _SIX.finditer(text) if _address(m[0])]
    if "[.]" in text or "(.)" in text or "[dot]" in text:
        found += [(1, *m.span()) for m in _DEFANGED.finditer(text)]
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        n = len(_digits(m[0]))
        if text[max(start - 1, 0) : start] in ("+", "(") and (text[start - 1] == "+" or ")" in m[0]):
            start -= 1
        if 13 <= n <= 19:
            found.append((2, start, end))
        if 7 <= n <= 15:
            found.append((3, start, end))
    taken = _merged([s[1:] for s in base])
    return [c for c in found if not _overlaps(taken, c[1], c[2])]


def _address(text: str):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def votes(kind: int, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """What the labelers say: 1 personal data, -1 none, 0 nothing."""
    span, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    digits = _digits(span)
    if kind == 0:
        site = re.split(r"[.\x20\])}>]+", span)[-1].lower()
        shape = 1 if re.search(r"[._+-]|[0-9]", span.split("@")[0]) else 0
        valid = -1 if not site.isalpha() or len(site) < 2 else 1
        known = 1 if site in _SITES else -1
    elif kind == 1:
        address = _address(re.sub(r"[\[\]()]|dot(?=\])", lambda m: "." if m[0] == "dot" else "", span))
        shape = -1 if re.search(r"(?:^|[.:])0[0-9]", span) else 1
        valid = 1 if address else -1
        known = 0 if not address else -1 if address.is_unspecified or address.is_reserved or address.is_multicast else 1
    elif kind == 2:
        shape = 1 if _FOURS.fullmatch(span) else -1
        valid = 1 if luhn(digits) else -1
        known = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|62|65", digits) else -1
    else:
        shape = 1 if _GROUPS.fullmatch(span) else -1
        valid = -1 if _DATE.match(span) or len(set(digits)) < 3 or len(digits) > 15 else 1 if 9 <= len(digits) <= 13 else 0
        known = (1 if _CALLING.match(digits.removeprefix("00")) else -1) if span[:1] == "+" or digits[:2] == "00" else (1 if len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01" else 0)
    near = 1 if _NEAR[kind].search(before) or kind == 0 and _NEAR[kind].search(after) else 0
    against = -1 if _AGAINST.search(before[-20:]) else 0
    edge = -1 if before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in ("_", "$", "#", "=", ".") or re.match(r"[%$€£_]|[.,][0-9]", after) else 1
    return (1 if base else 0), shape, valid, known, near, against, edge


def _shape(span: str) -> str:
    short = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", span)
    return re.sub(r"[^\W\d_]+", "a", short)[:40]


def features(kind: int, text: str, start: int, end: int, cast: tuple[int, ...]) -> list[int]:
    """Places of a hashed feature vector."""
    span = text[start:end]
    words = re.findall(r"[^\W\d_]+", text[max(0, start - BEFORE) : start].lower())[-3:] + ["|"] + re.findall(r"[^\W\d_]+", text[end : end + AFTER].lower())[:2]
    names = ["", f"shape {_shape(span)}", f"digits {len(_digits(span))}", f"edges {text[start - 1 : start]} {text[end : end + 1]}"]
    # the strict pattern itself is no feature: the classifier must not copy it
    names += [f"vote {j} {v}" for j, v in enumerate(cast) if j] + [f"word {w}" for w in words]
    return sorted({zlib.crc32(f"{kind} {name}".encode()) % PLACES for name in names})


def _code(cast: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**j for j, v in enumerate(cast))


def cast_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**j % 3 - 1 for j in range(LABELERS))


def _candidates(texts: pa.Array) -> pa.Array:
    out = []
    for cell in texts:
        text = cell.as_py()
        row = []
        if text:
            base = base_spans(text)
            for spans, strict in ((base, True), (further_spans(text, base), False)):
                for kind, start, end in spans:
                    cast = votes(kind, text, start, end, strict)
                    row.append({"kind": kind, "start": start, "base": strict, "votes": _code(cast), "features": features(kind, text, start, end, cast)})
        out.append(row)
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])
    return pa.array(out, pa.list_(kind))


def estimate(counts: dict[int, int], rounds: int = 100, prior: float = 1.0) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of true spans, P(vote | false or true) by labeler, posterior by
    pattern of votes) from how often each pattern occurs (at least one).

    Labelers are taken to be independent given the truth, and no worse than
    chance: where a yes would speak against a span, both tables are pooled.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    cast = np.array([cast_of(c) for c in codes.tolist()]).reshape(-1, LABELERS)
    p = 1 / (1 + np.exp(-cast.sum(1).astype(float)))
    share, tables = 0.5, np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        share = float(((n * p).sum() + prior) / (n.sum() + 2 * prior))
        for y, weight in enumerate((n * (1 - p), n * p)):
            for v in range(3):
                tables[y, :, v] = (weight[:, None] * (cast == v - 1)).sum(0) + prior
            tables[y] /= tables[y].sum(1, keepdims=True)
        for v, right in ((2, 1), (0, 0)):
            worse = tables[right, :, v] < tables[1 - right, :, v]
            pooled = (1 - share) * tables[0] + share * tables[1]
            tables[:, worse] = pooled[worse]
        odds = np.log(share / (1 - share)) + sum(np.log(tables[1, j, cast[:, j] + 1] / tables[0, j, cast[:, j] + 1]) for j in range(LABELERS))
        was, p = p, 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if len(p) == 0 or np.abs(p - was).max() < 1e-9:
            break
    return share, tables, dict(zip(codes.tolist(), p.tolist()))


def fit_classifier(places: list[list[int]], target: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on hashed features with probabilities as targets."""
    weights, grades = np.zeros(PLACES), np.full(PLACES, 1e-8)
    if not places:
        return weights
    owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
    flat = np.concatenate([np.asarray(p, np.int64) for p in places])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[flat], len(places)), -40, 40)))
        slope = np.bincount(flat, (p - target)[owner], PLACES) / len(places) + decay * weights
        grades += slope * slope
        weights -= rate * slope / np.sqrt(grades)
    return weights


@dataclass
class Model:
    weights: np.ndarray
    #: by kind: share of true candidates, P(vote | false or true) by labeler
    reliabilities: dict[int, tuple[float, np.ndarray]]


def train(docs: DataFrame) -> Model:
    """Votes on all candidates of all texts; no labels."""
    each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.arrow_udf(_candidates, CANDIDATES)(F.col("text"))).alias("c"))
    # written once: counted and sampled
    met = cut(each.select("c.kind", "c.base", "c.votes", "c.features", F.xxhash64("doc_id", "c.start", "c.kind").alias("h")), "candidates")
    counts: dict[int, dict[int, int]] = {k: {} for k in range(len(KINDS))}
    for r in met.groupBy("kind", "votes").count().collect():  # 3**7 a kind at most
        counts[r["kind"]][r["votes"]] = r["count"]
    found = {k: estimate(c) for k, c in counts.items() if c}
    posterior = {(k, code): p for k, (_, _, by_code) in found.items() for code, p in by_code.items()}
    nth = F.row_number().over(Window.partitionBy("kind", "base").orderBy("h", "votes"))
    sample = met.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE).select("kind", "votes", "features")

    def build(rows: pa.Table) -> np.ndarray:
        target = np.array([posterior[k, v] for k, v in zip(rows["kind"].to_pylist(), rows["votes"].to_pylist())])
        return fit_classifier(rows["features"].to_pylist(), target)

    return Model(fitted(sample, build), {k: (share, tables) for k, (share, tables, _) in found.items()})


def all_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int, bool, float]]:
    """Base spans, and further ones that the classifier takes; of those that
    overlap the likelier stays (ties: the first, then the longer)."""

    def probability(kind: int, start: int, end: int, strict: bool) -> float:
        places = features(kind, text, start, end, votes(kind, text, start, end, strict))
        return float(1 / (1 + np.exp(-np.clip(weights[places].sum(), -40, 40))))

    base = base_spans(text)
    found = [(*s, True, probability(*s, True)) for s in base]
    further = [(-p, s) for s in further_spans(text, base) if (p := probability(*s, False)) >= ADDED]
    taken: list[tuple[int, int]] = []
    for p, (kind, start, end) in sorted(further, key=lambda c: (c[0], c[1][1], -c[1][2])):
        if not _overlaps(taken, start, end):
            taken = _merged([*taken, (start, end)])
            found.append((kind, start, end, False, -p))
    return sorted(found)


def spans(text: Column, model: Model, spark) -> Column:
    """All spans of a text by kind, then start."""
    shared = spark.sparkContext.broadcast(model.weights)

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "base", "probability")
        rows = [[dict(zip(names, s)) for s in all_spans(t, shared.value)] if (t := cell.as_py()) else [] for cell in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())])))

    return run(text)


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``pii``: every span with its kind, place and probability."""
    return docs.withColumn("pii", spans(F.col("text"), model, docs.sparkSession))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span replaced by its kind in brackets; of spans that
    overlap the one that starts first is shown."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_redacted(t, shared.value) if (t := cell.as_py()) else t for cell in texts], pa.string())

    return docs.withColumn("text", run(F.col("text")))


def _redacted(text: str, weights: np.ndarray) -> str:
    out, last = [], 0
    for kind, start, end, *_ in sorted(all_spans(text, weights), key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def _written(which: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op11_pii(spark, sf_dir: str) -> DataFrame:
    """Base spans counted and sealed, and all spans, of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])

    def count_of(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(count_of, range(len(KINDS)))
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("pii")).alias("spans"))
