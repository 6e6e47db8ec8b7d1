"""Profiles that merge, lookups in order, tokens anywhere."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arcwatch.operators import hosts, indicators, profiles

SCHEMA = "user string, us long, event_id long, hour double, item string, value double"


def events(n: int = 900):
    rng = random.Random(6)
    rows = [(rng.choice("aaaaabcd"), rng.randrange(5_000), i, rng.random() * 24, rng.choice("pqrst") if i % 13 else None, rng.random() * 100) for i in range(n)]
    return [*rows, ("late", 4_900, 9_000, 1.0, "p", 1.0), ("early", 10, 9_001, 1.0, "p", None), ("a", None, 9_002, 1.0, "p", 1.0), (None, 20, 9_003, 1.0, "q", 1.0), (None, 4_000, 9_004, 1.0, "r", 1.0)]


def told(profile):
    out = {}
    for name, rows in profile.items():
        for r in rows.collect():
            key = tuple(r[c] for c in rows.columns if c in ("entity", "item", "prev"))
            rest = [r[c] for c in rows.columns if c not in ("entity", "item", "prev")]
            out[name, key] = [round(v, 9) if isinstance(v, float) else v for v in rest]
    return out


def test_two_stretches_merged_are_one_run(spark, tmp_path):
    df = spark.createDataFrame(events(), SCHEMA).cache()
    learn = lambda rows: profiles.learn(rows, "user", "hour", "item", "value", keep=60)
    whole = told(learn(df))
    for cuts in ([2_500], [100, 3_000], [0], [9_999]):
        parts = [df.filter((F.col("us") >= a) & (F.col("us") < b)) for a, b in zip([-1, *cuts], [*cuts, 10**9])]
        merged = learn(parts[0])
        for part in parts[1:]:
            merged = profiles.merge(merged, learn(part), keep=60)
        assert told(merged) == whole
    path = str(tmp_path / "profile")
    profiles.save(learn(df), path)
    assert told(profiles.load(spark, path)) == whole
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        profiles.save(learn(df), path)
    assert len([k for k in whole if k[0] == "volumes" and len(whole[k][0]) == 60]) > 1


def test_later_events_are_scored_by_what_was_learnt(spark):
    past = [("a", i, i, 9.0 + (i % 3) / 10, "pq"[i % 2], 10.0 + i % 3) for i in range(40)] + [(u, 100 + i, 100 + i, 9.0, "p", 1.0) for i, u in enumerate("bcdefgh")]
    later = [("a", 500, 500, 21.0, "q", 11.0), ("a", 501, 501, 9.1, "q", 90.0), ("a", 502, 502, 9.1, "new", 11.0), ("zz", 503, 503, 9.1, "p", 5.0)]
    known = profiles.learn(spark.createDataFrame(past, SCHEMA), "user", "hour", "item", "value")
    rows = spark.createDataFrame(later, SCHEMA)
    assert [r["event_id"] for r in profiles.odd_hours(known, rows, "user", "hour").collect()] == [500]
    assert [r["event_id"] for r in profiles.odd_volumes(known, rows, "user", "value").collect()] == [501]
    assert [(r["user"], r["item"], r["users"]) for r in profiles.new_items(known, rows, "user", "item").collect()] == [("a", "new", 0)]
    # the profile's last item of a is q: q to q is new, as is q to new
    got = {(r["event_id"], r["prev"], r["n_prev"], r["n_step"]) for r in profiles.new_steps(known, rows, "user", "item").collect()}
    assert got == {(500, "q", 19, 0), (501, "q", 19, 0), (502, "q", 19, 0)}


def test_the_first_of_overlapping_blocks(spark):
    number = lambda a, b, c, d: ((a * 256 + b) * 256 + c) * 256 + d
    blocks = [("wide", number(10, 0, 0, 0), 8, 2), ("mid", number(10, 1, 0, 0), 16, 1), ("thin", number(10, 1, 2, 0), 24, 3), ("all", 0, 0, 9)]
    df = spark.createDataFrame(blocks, "name string, first long, bits int, at int").withColumn("back", -F.col("at"))
    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("10.1.7.7",), ("11.0.0.1",), ("x",), ("10.1.2.3",)], "ip string")
    got = {order: {r["ip"]: r["name"] for r in indicators.locate_in(ips, df, order=order).collect()} for order in ("at", "back", None)}
    assert got["at"] == {"10.1.2.3": "mid", "10.9.9.9": "wide", "10.1.7.7": "mid", "11.0.0.1": "all", "x": None}
    assert got["back"] == {"10.1.2.3": "all", "10.9.9.9": "all", "10.1.7.7": "all", "11.0.0.1": "all", "x": None}
    assert got[None] == {"10.1.2.3": "thin", "10.9.9.9": "wide", "10.1.7.7": "mid", "11.0.0.1": "all", "x": None}
    assert indicators.locate_in(ips, df, order="at").count() == 6


def test_tokens_of_any_form_are_found_anywhere(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "xxABCyy"), (2, "bc"), (3, None), (4, ""), (5, "the key is k é1 and ABC ABC"), (6, "aab")], "n int, text string")
    tokens = spark.createDataFrame([("ABC", 1), ("BCy", 2), ("é1", 3), ("", 4), (None, 5), ("ab", 6), ("aab", 7)], "token string, id int")
    want = [(1, 1), (1, 2), (5, 1), (5, 3), (6, 6), (6, 7)]
    for size in (1 << 20, 3):  # one block, and one a token or two
        monkeypatch.setattr(hosts, "TOKEN_TEXT", size)
        assert sorted((r["n"], r["id"]) for r in hosts.leaked_anywhere(texts, tokens).collect()) == want
    assert hosts.leaked_anywhere(texts, tokens.limit(0)).count() == 0
