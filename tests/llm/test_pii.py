"""Personal data: strict patterns against plain regular expressions, labelers,
estimation and the classifier on texts with known spans."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcwatch.llm import pii

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii string, c int, kind int, votes int, base boolean"


def plain_luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def plain_spans(text: str):
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            yield kind, *m.span()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@-+ (5é", max_size=60), st.text(alphabet="0123456789. -+()", max_size=80), st.text(max_size=40)))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == list(plain_spans(text))


@pytest.mark.parametrize("text", [
    "a@b.c@d.e", "a@b.c_x@d.e.f", "@a.b", "a@@b.c", "a@b", "x@1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "4111111111111111 +49 30 1234567", "+1 (743) 555-3824", "+1234567", "+" + "1" * 16, "++123456789", "٣٣٣.1.1.1", "ü" * 9 + "+1 743 555 3824",
    "0.0.0." + "9" * 5000,
])
def test_base_spans_of_edge_cases(text):
    sets = [s for s in plain_spans(text)] if len(text) < 4000 else []
    assert pii.base_spans(text) == sets


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "+1 ", "(", "a.", "1.1.1.", ":", "1-", " at ", "[at]a", "@ ", "a:", "(1", "[.]1"])
def test_long_runs_cost_linear_time(unit):
    """300 kB of one repeated piece."""
    began = time.process_time()
    text = unit * (300_000 // len(unit))
    base = pii.base_spans(text)
    pii.further_spans(text, base)
    assert time.process_time() - began < 5


def test_labelers_tell_spans_apart():
    def sum_of(kind, before, span, after=""):
        text = before + span + after
        return sum(pii.votes(kind, text, len(before), len(before) + len(span), False))

    assert sum_of(3, "call me: ", "(212) 555-0187") > 1 > sum_of(3, "order no ", "20240117833")
    assert sum_of(3, "token a3f", "0641917", "ea4e9f") < 0 and sum_of(3, "on ", "2024-01-17 10") < 1
    assert sum_of(2, "Karte ", "3782 822463 10005") > 1 > sum_of(2, "isbn ", "978-3-16-148410-0")
    assert sum_of(0, "mail ", "jo (at) site dot org") > 1 > sum_of(0, "", "lodash (at) 4.17.21")
    assert sum_of(1, "from host ", "2001:db8::7") > sum_of(1, "version ", "09[.]1[.]2[.]3")


def test_estimation_recovers_known_labelers():
    """Votes are drawn from known tables; truth is hidden."""
    rng = np.random.default_rng(2)
    n, share = 60_000, 0.3
    truth = rng.random(n) < share
    right = np.array([0.95, 0.8, 0.9, 0.7, 0.6, 0.85, 0.75])
    speaks = np.array([0.5, 0.9, 1.0, 0.6, 0.4, 0.8, 1.0])
    says = np.where(rng.random((n, 7)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    cast = np.where(rng.random((n, 7)) < speaks, says, 0)
    counts: dict[int, int] = {}
    for row in cast:
        code = pii._code(tuple(row.tolist()))
        assert pii.cast_of(code) == tuple(row)
        counts[code] = counts.get(code, 0) + 1
    got, tables, posterior = pii.estimate(counts)
    assert abs(got - share) < 0.02
    assert np.abs(tables[1, :, 2] - right * speaks).max() < 0.03 and np.abs(tables[0, :, 0] - right * speaks).max() < 0.03
    p = np.array([posterior[pii._code(tuple(r))] for r in cast.tolist()])
    # as good as knowing the labelers
    known = np.log(share / (1 - share)) + (cast * np.log(right / (1 - right))).sum(1)
    assert ((p > 0.5) == truth).mean() > ((known > 0) == truth).mean() - 0.002


def plain_texts():
    rng = np.random.default_rng(4)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    rows = []
    for _ in range(150):
        rows.append((f"You can call {rng.integers(2, 9)}{number(2)}-{rng.integers(2, 9)}{number(2)}-{number(4)} today.", True))
        rows.append((f"order {number(11)} was sent, ref {number(9)}x.", False))
        rows.append((f"token = a{number(10)}f and {number(7)}b", False))
        rows.append((f"write to jo{number(2)} (at) mail{number(1)} dot com please", True))
        rows.append((f"mail jo{number(2)}@mail{number(1)}.example.com or call +1 ({rng.integers(2, 9)}{number(2)}) 555-{number(4)}", None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "x", 1, 2, 3, True) for i, (t, _) in enumerate(plain_texts())]
    odd = [(9001, None), (9002, ""), (9003, "no data " * 30_000 + "jo@site.org"), (None, "call +49 30 123456789"), (0, rows[0][1])]
    return spark.createDataFrame(rows + [(i, t, None, None, None, None, None, None, None, None) for i, t in odd], SCHEMA).repartition(4).cache()


def test_classifier_adds_what_the_labelers_agree_on(docs):
    model = pii.train(docs)
    got = {(r["doc_id"], r["text"]): r["pii"] for r in pii.find_pii(docs, model).collect()}
    hits = {True: 0, False: 0}
    for i, (text, personal) in enumerate(plain_texts()):
        found = got[i, text]
        assert [tuple(s)[:3] for s in found if s["base"]] == list(plain_spans(text))
        if personal is not None:
            hits[personal] += bool(found)
        else:
            assert len(found) == 2
    assert hits[True] >= 295 and hits[False] <= 5
    assert got[9001, None] == [] and got[9002, ""] == []
    assert [(s["start"], s["end"]) for s in got[9003, "no data " * 30_000 + "jo@site.org"]] == [(240_000, 240_011)]
    clean = {r["doc_id"]: r for r in pii.redact(docs.filter("doc_id IN (4, 9001, 9002)"), model).collect()}
    assert clean[4]["text"] == "mail [EMAIL] or call [PHONE]" and clean[9001]["text"] is None and clean[9002]["text"] == ""
    assert clean[4]["pii"] == "x" and clean[4]["votes"] == 3


def test_query_seals_the_base_spans(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op11_pii(spark, str(tmp_path)).collect()
    texts = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect())
    assert len(got) == len(texts)
    by_id = {}
    for i, text in texts:
        by_id.setdefault(i, text)
    for r in got:
        base = list(plain_spans(by_id[-1 if r["doc_id"] is None else r["doc_id"]]))
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{name}"] for name in pii.KINDS] == [sum(k == n for k, *_ in base) for n in range(4)]
        assert not base or set(written.split(",")) <= set(r["spans"].split(","))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pii.op11_pii(spark, str(tmp_path / "none")).count() == 0
