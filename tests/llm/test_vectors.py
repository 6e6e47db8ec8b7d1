"""Codes and whitening of vectors against plain numpy on small tables with
nulls, odd components and lengths, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwatch.llm import codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int, component int, _none int, salt int"
ODD = [None, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [0.0] * 7]


def table_of(spark, rows, extra=()):
    made = [(i, v, label, "x", 1, 2, 3, 4) for i, v, label in rows]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


def make_rows(n: int = 400, seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, 8)) @ rng.normal(size=(8, 8))
    rows = [(int(i) * 2, v.tolist(), [0, 0, 1, None][i % 4]) for i, v in enumerate(mixed)]
    rows += [(1000 + i, mixed[3].tolist(), 2) for i in range(40)]  # a group of copies
    rows += [(2000 + i, v, 1) for i, v in enumerate(ODD)]
    return [*rows, rows[7], (None, mixed[9].tolist(), 5), (3000, [0.0] * 8, None)]


def fine(v) -> bool:
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain_codes(rows, entries, rounds, parts=4):
    kept = [r for r in rows if fine(r[1])]
    ints = [[math.floor(1024 * c) for c in v] for _, v, _ in kept]
    w = len(ints[0]) // parts
    first = sorted((i, v) for (i, _, _), v in zip(kept, ints) if i is not None)[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in ints:
                part = v[p * w : (p + 1) * w]
                met.setdefault(near(part, books[p])[1], []).append(part)
            for k, members in met.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    best = [[near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)] for v in ints]
    seal = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for (_, _, label), b in zip(kept, best):
        total[label] = total.get(label, 0) + sum(d for d, _ in b)
    return [(i, tuple(k for _, k in b), sum(d for d, _ in b), total[label]) for (i, _, label), b in zip(kept, best)], seal


@pytest.mark.parametrize("entries,rounds", [(4, 3), (256, 4), (700, 1)])
def test_codes_match_a_plain_reading(spark, entries, rounds):
    rows = make_rows()
    got, books = codes.compress(table_of(spark, rows), entries=entries, rounds=rounds)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want, seal = plain_codes(rows, entries, rounds)
    assert sorted([(r["vec_id"], tuple(r["code"]), r["error"], r["label_error"]) for r in got.collect()], key=key) == sorted(want, key=key)
    assert codes.digest(books) == seal


def test_codes_of_few_no_and_odd_rows(spark):
    none, books = codes.compress(table_of(spark, make_rows()).limit(0))
    assert none.count() == 0 and books.size == 0
    unfit, _ = codes.compress(table_of(spark, [(1, None, 1), (2, [float("nan")], 1)]))
    assert unfit.count() == 0
    # another length than most, an empty vector, a length that parts do not divide
    got, books = codes.compress(table_of(spark, [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [1.0] * 4, 1), (4, [], 2), (5, [1.0] * 7, 1)]))
    found = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got.collect()}
    assert found == {1: ([0] * 4, 0, 0), 2: ([1] * 4, 0, 0), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
    assert np.allclose(codes.decode(np.array([[0] * 4, [1] * 4]), books), [[1] * 8, [2] * 8], atol=1e-3)
    nameless, _ = codes.compress(table_of(spark, [(None, [1.0] * 8, 1)]))
    assert [tuple(r) for r in nameless.collect()] == [(None, "1", None, None, None)]


def test_codes_of_extreme_components_stay_in_64_bits(spark):
    rows = [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [1e-300] * 8, 1), (4, [60_000.5] * 8, 1)]
    got, _ = codes.compress(table_of(spark, rows), entries=1, rounds=0)
    bound = codes.bound_of(8)
    x = {1: bound, 2: -bound, 3: 0, 4: math.floor(1024 * 60_000.5)}
    assert {r["vec_id"]: r["error"] for r in got.collect()} == {i: 8 * (v - bound) ** 2 for i, v in x.items()}
    a, b = np.array([[2**40, -3]]), np.array([[2**20], [7]])
    assert vectors.product(a, b).tolist() == [[2**60 - 21]]


def test_labels_that_hold_most_rows_sum_alike(spark):
    rows = [(i, [float(i % 7)] * 8, 1 if i % 9 else i) for i in range(900)]
    got, _ = codes.compress(table_of(spark, rows), entries=3, rounds=1)
    frame = got.toPandas()
    assert (frame.groupby("label")["error"].transform("sum") == frame["label_error"]).all()


def plain_whitening(rows, k):
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v, _ in rows if fine(v)]
    x = np.array([v for _, v in kept], object)
    n, s = len(x), x.sum(0)
    far = n * x - s
    c = far.astype(float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [(i, int((f * f).sum())) for (i, _), f in zip(kept, far)], c @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_matches_a_plain_reading(spark, tmp_path):
    rows = make_rows()
    table_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13_whitening(spark, str(tmp_path)).toPandas()
    n, deviations, w, explained = plain_whitening(rows, 8)
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    order = lambda frame: frame.sort_values(["deviation", "vec_id"], kind="stable")
    for component, mine in got.groupby("component"):
        mine = order(mine.assign(vec_id=mine["vec_id"].fillna(-1)))
        theirs = sorted((d, -1 if i is None else i, w[at, component - 1]) for at, (i, d) in enumerate(deviations))
        assert mine["deviation"].tolist() == [t[0] for t in theirs] and mine["vec_id"].tolist() == [t[1] for t in theirs]
        a, b = mine["whitened"].to_numpy(), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert np.allclose(mine["explained"], explained[component - 1], rtol=1e-9)


def test_components_of_flat_and_repeated_spectra_settle():
    """Long vectors, several blocks, a restart, equal eigenvalues."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(600, 600)))[0]
    for values in (1 - np.arange(600) * 1e-4, np.repeat([5.0, 1.0, 0.5], 200), np.append([3.0, 3.0, 1.0], np.zeros(597))):
        v = (turn * values) @ turn.T
        got, axes, passes = whitening.leading(lambda q, v=v: v @ q, 600, 8, 32)
        assert np.allclose(got, values[:8], atol=1e-12) and passes < 200
        assert np.abs(v @ axes - axes * got).max() < 1e-11 and np.allclose(axes.T @ axes, np.eye(8), atol=1e-12)


def test_whitening_of_few_no_and_odd_rows(spark, tmp_path):
    def run(name, rows):
        table_of(spark, rows).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        return whitening.op13_whitening(spark, str(tmp_path / name)).orderBy("vec_id", "component").collect()

    assert run("none", [(1, None, 1)]) == []
    one = run("one", [(1, [1.0, 2.0], 1)])
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    # a line: one component varies; odd lengths are returned without values
    line = run("line", [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(9)] + [(50, [1.0], 1), (51, [], 1)])
    assert all((r["whitened"] is not None) == (r["component"] == 1 and r["vec_id"] < 50) for r in line)
    assert all((r["deviation"] is None) == (r["vec_id"] >= 50) for r in line) and len(line) == 33
    far = run("far", [(1, [1e300, 0.0], 1), (2, [-1e300, 1e-300], 1), (3, [1.0, 2.0], 1)])
    first = [r for r in far if r["component"] == 1]
    assert all(abs(r["whitened"]) < 2 for r in first) and far[0]["identity_error"] < 1e-9
    # 3 * x - S leaves 64 bits when squared
    assert first[0]["deviation"] is None


def test_sums_over_tasks_are_merged_by_key(spark):
    def of_task(batches):
        found = {}
        for batch in batches:
            for x in batch.column("id").to_pylist():
                found[x % 3] = found.get(x % 3, np.zeros(2, np.int64)) + np.array([1, x])
        return found

    got = vectors.summed(spark.range(0, 1000, 1, 150).select(F.col("id")), of_task, np.int64)
    assert {k: v.tolist() for k, v in got.items()} == {r: [len(range(r, 1000, 3)), sum(range(r, 1000, 3))] for r in range(3)}
