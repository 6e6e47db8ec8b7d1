"""Sweeps against plain windows, over cells of several widths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arcwatch.operators import behaviour, network, sweeps, windows

SPAN = 50


def made(n: int = 600, seed: int = 1):
    """One key has two thirds of the rows, and clocks, items and values repeat."""
    rng = random.Random(seed)
    keys = ["hot"] * 14 + ["a", "b", "b", None, "c", "d"]
    return [(rng.choice(keys), rng.choice([rng.randrange(2000), 700, 701]), i, rng.choice("uvwxyz") if i % 9 else None, rng.randrange(100), rng.random()) for i in range(n)] + [("hot", None, 9999, "u", 1, 0.5)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), "k string, us long, event_id long, item string, n long, x double").repartition(3).cache()


@pytest.fixture(params=[1, 7, 10_000], ids=["narrow", "some", "one"])
def width(request):
    """Cells of one clock, of few rows, and one for all."""
    return request.param


def test_ranges_match_sliding_frames(rows):
    measures = {
        "items": sweeps.Measure(SPAN, item="item"), "wide": sweeps.Measure(400, item="item"), "total": sweeps.Measure(SPAN, F.col("n")),
        "count": sweeps.Measure(170, F.lit(1).cast("long")), "exact": sweeps.Measure(SPAN, sweeps.exact(F.col("x"))),
    }
    w = lambda span: windows.trailing(["k"], span)
    plain = rows.filter("us is not null").select(
        "event_id", F.size(F.collect_set("item").over(w(SPAN))).alias("items"), F.size(F.collect_set("item").over(w(400))).alias("wide"), F.sum("n").over(w(SPAN)).alias("total"),
        F.count("*").over(w(170)).alias("count"), F.sum(sweeps.exact(F.col("x"))).over(w(SPAN)).alias("exact"),
    )
    got = sweeps.in_range(rows, ["k"], measures).select("event_id", *measures)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(got) == order(plain)
    assert sweeps.in_range(rows.limit(0), ["k"], measures).count() == 0


def test_sums_and_values_before_match_plain_windows(rows, width):
    rows = rows.filter("us is not null")
    w = Window.partitionBy("k").orderBy("us", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    order = lambda df: sorted(map(tuple, df.collect()))
    got = sweeps.sums_before(rows, ["k"], {"s": F.col("n"), "c": F.lit(1)}, width=width).select("event_id", "s", "c")
    assert order(got) == order(rows.select("event_id", F.coalesce(F.sum("n").over(before), F.lit(0)), F.count("*").over(before)))
    everything = Window.orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    got = sweeps.sums_before(rows, [], {"s": F.col("n")}, width=width, ties=width if width > 1 else None).select("event_id", "s")
    assert order(got) == order(rows.select("event_id", F.coalesce(F.sum("n").over(everything), F.lit(0))))
    # sorted by id alone: values may be null
    got = {r["event_id"]: r["b"] for r in sweeps.value_before(rows, ["k"], "item", "b", width=width).collect()}
    assert got == {r["event_id"]: r["b"] for r in rows.withColumn("b", F.lag("item").over(w)).collect()}


def test_detectors_match_sliding_frames(rows):
    rows = rows.filter("us is not null")
    plain = rows.withColumn("items", F.size(F.collect_set("item").over(windows.trailing(["k"], SPAN))))
    want = windows.first_firing(plain, ["k"], F.col("items") >= 4).select("k", "event_id", "items").collect()
    fired = windows.distinct_burst(rows, ["k"], "item", SPAN, 4)
    assert {tuple(r) for r in fired.select("k", "event_id", "n_distinct").collect()} == {tuple(r) for r in want} and want
    told = {r["k"]: r for r in windows.burst_items(rows, fired, ["k"], "item", SPAN).collect()}
    for r in fired.collect():
        if r["k"] is not None:
            assert told[r["k"]]["items"] == sorted({x[3] for x in made() if x[0] == r["k"] and x[1] is not None and r["us"] - SPAN <= x[1] <= r["us"] and x[3]})
    dns = rows.select(F.concat(F.coalesce("k", F.lit("z")), F.lit(".Example.")).alias("qname"), F.lit("A").alias("qtype"), "us", "event_id", F.array(F.concat(F.lit("10."), F.col("n") % 5, F.lit(".0."), F.col("n"))).alias("answers"), (F.col("n") * 4).alias("ttl"))
    w = windows.trailing(["qname"], 400)
    flat = dns.withColumn("qname", F.rtrim(F.lower("qname"), F.lit("."))).withColumn("ip", F.explode("answers"))
    flat = flat.withColumns({"n_ips": F.size(F.collect_set("ip").over(w)), "n_nets": F.size(F.collect_set(F.substring_index("ip", ".", 2)).over(w)), "mean_ttl": F.avg("ttl").over(w)})
    want = windows.first_firing(flat, ["qname"], F.expr("n_ips >= 8 and mean_ttl <= 300 and n_nets >= 4"), tie="ip").select("qname", "event_id", "n_ips", "n_nets", "mean_ttl").collect()
    assert sorted(map(tuple, network.fast_flux(dns, 400).select("qname", "event_id", "n_ips", "n_nets", "mean_ttl").collect())) == sorted(map(tuple, want)) and want


def plain_transitions(rows, overall, least, share):
    seen, last, out = [], {}, []
    for k, us, i, item, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        prev, known = last.get(k), k in last
        last[k] = item
        if not known or prev is None:
            continue
        before = [s for s in seen if s[1] == prev]
        step = [s for s in before if s[2] == item]
        if len(seen) >= overall and len(before) >= least and len(step) <= share * len(before) and not any(s[0] == k for s in step):
            out.append((k, i, prev, item, len(before), len(step)))
        seen.append((k, prev, item))
    return sorted(out)


def test_rare_transitions_and_items_match_a_plain_reading(spark):
    rng = random.Random(8)
    data = [(rng.choice(["p", "p", "p", "q", "r", "s"]), rng.randrange(3000), i, rng.choices("aabbcdefghij", k=1)[0], 0, 0.0) for i in range(700)]
    df = spark.createDataFrame(data, "k string, us long, event_id long, item string, n long, x double")
    got = behaviour.rare_transitions(df, "k", "item", share=0.05).select("k", "event_id", "prev", "item", "n_prev", "n_step").collect()
    want = plain_transitions(data, 20, 10, 0.05)
    assert sorted(map(tuple, got)) == want and want
    assert behaviour.rare_transitions(df.limit(3), "k", "item").count() == 0
    users: dict[str, set] = {}
    entities: set = set()
    rare = []
    for k, _, i, item, *_ in sorted(data, key=lambda r: (r[1], r[2])):
        met = users.setdefault(item, set())
        if k not in met and len(entities) >= 2 and len(met) <= 0.5 * len(entities):
            rare.append((k, item, i, len(met)))
        met.add(k)
        entities.add(k)
    got = behaviour.rare_items(df, "k", "item", population=2, share=0.5).select("k", "item", "event_id", "users").collect()
    assert sorted(map(tuple, got)) == sorted(rare) and rare
