"""The corpus operators against brute force on small fixtures with nulls,
empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwatch.llm import common, decontamination, embeddings, kernels, language, language_model, minhash, mixing, quality, sharding, suffixes, toxicity
from arcwatch.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, label string"
SPACE = r"[^\x20\x09-\x0D]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def make_docs(seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghé"), 5)) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocab, n))
    base, passage = words(80), words(30)
    texts = [None, "", " \n\t ", "One", "one two", "ONE two three", base, base, base.upper(), words(3000), words(1)]
    for i in range(24):  # near copies of varying distance
        w = base.split(" ")
        for j in rng.choice(80, i % 9, replace=False):
            w[j] = "x" + str(i)
        texts.append(" ".join(w))
    texts += [words(20) + " " + passage + "\n" + words(20) for _ in range(12)]
    texts += [words(int(rng.integers(5, 120))) for _ in range(40)]
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], len(t or ""), i, "z") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "lost words here now", "en", "a", 1, 1, "z")]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles_match_a_plain_reading():
    import pyarrow as pa

    texts = ["", "A b  C\x0bd", None, " x", "é é b\n", "one two three four five"]
    read = [kernels.Words(data, offs) for _, _, data, offs in kernels.pieces(pa.array(texts))]
    got = [w.data[s:e].tobytes() for w in read for s, e in zip(w.starts, w.ends)]
    assert got == [w.encode() for t in texts for w in re.findall(SPACE, lower(t or ""))]
    for _, _, data, offs in kernels.pieces(pa.array(texts)):
        _, bounds = kernels.shingles(kernels.Words(data, offs), 4)
        counts = [len(re.findall(SPACE, t or "")) for t in texts]
        assert np.diff(bounds).tolist() == [max(n - 3, 0) or int(n > 0) for n in counts]


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 130)) and all(found[i] == 200 for i in (200, 201, 202))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, k, percent):
    sets, root = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            w = re.findall(SPACE, lower(t or ""))
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
            root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_components_are_exact(docs, rows, k):
    got = minhash.near_components(docs, k=k).collect()
    assert len(got) == len(rows)
    expected = brute_components(rows, k, 80)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_minhash_finds_links_that_hubs_miss(spark):
    """A chain where neighbours are alike and ends are not."""
    words = [f"w{i}" for i in range(100)]
    chain = []
    for step in range(6):
        chain.append((step, " ".join(words[step * 7 : step * 7 + 60]), None, None, 0, 0, ""))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(spark.createDataFrame(chain, SCHEMA), k=1, percent=75).collect()}
    assert got == {d: c for d, (_, c) in brute_components(chain, 1, 75).items()}


def test_minhash_recall_at_the_threshold(spark):
    """Pairs whose sets share exactly four fifths: 400 pairs, none lost, and
    none that share just less is linked."""
    rng = np.random.default_rng(18)
    rows = []
    for i in range(400):
        words = [f"p{i}w{j}" for j in rng.permutation(90)]
        # 80 of 100, or 79 of 101, distinct words in both
        shared = 80 if i % 2 else 79
        own = (100 if i % 2 else 101) - shared
        rows += [(2 * i, " ".join(words[:shared] + [f"p{i}a{j}" for j in range(own // 2)])), (2 * i + 1, " ".join([f"p{i}b{j}" for j in range(own - own // 2)] + words[:shared]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80).collect()}
    assert all(got[2 * i + 1] == (2 * i if i % 2 else 2 * i + 1) for i in range(400))


def test_minhash_splits_large_hubs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_ROWS", 4)
    base = [f"w{j}" for j in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 + 1 :]])) for i in range(120)]
    got = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80).collect()
    assert {r["component_id"] for r in got} == {0}


def test_very_long_texts_are_read_whole(spark):
    """Texts of more than a piece: what lies past the first megabyte counts."""
    import pyarrow as pa

    rng = np.random.default_rng(19)
    vocab = [f"w{j}" for j in range(5000)]
    long = " ".join(rng.choice(vocab, 260_000))
    assert len(long) > kernels.PIECE
    other = " ".join(long.split(" ")[:-2000] + [f"y{j}" for j in range(2000)])
    rows = [(1, long), (2, other), (3, long[: len(long) // 2]), (4, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    bench = spark.createDataFrame([(7, " ".join(long.split(" ")[-40:-10]))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(df, bench).collect()} == {(1, 7)}
    texts = pa.array([long + " vile scum", "fine " * 50, "vile scum here", "good words"] * 30)
    sample = pa.table({"label": [1, 0, 1, 0] * 30, "draw": list(range(120)), "text": pa.array(["vile scum " + str(i) if i % 2 == 0 else "fine words " + str(i) for i in range(120)])})
    model = toxicity.build(sample, 0.5)
    alone, together = toxicity.score_texts(texts.slice(0, 1), model), toxicity.score_texts(texts.slice(0, 4), model)
    assert alone[0] == together[0] and together[2] > 0.5 > together[3]


def test_minhash_dedup_keeps_rows_and_columns(docs, empty):
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert minhash.near_components(empty).count() == 0


def test_poisson_counts_invert_the_distribution(docs, rows, empty, spark):
    out = mixing.mix_sources(docs, weights={"a": 3.0, "b": 1.0}, rows=4000).collect()
    assert {r["source"] for r in out} == {"a", "b"}
    sources = Counter(r[3] for r in rows)
    for d in {r[0] for r in rows if r[3] in ("a", "b")}:
        source = next(r[3] for r in rows if r[0] == d)
        rate = 4000 * {"a": 0.75, "b": 0.25}[source] / sources[source]
        parts = max(1, math.ceil(rate / mixing.STEP))
        count = 0
        for i in range(1, parts + 1):
            ident = d if d is not None else "null:" + hashlib.md5(next(r[1] for r in rows if r[0] is None).encode()).hexdigest()
            u = int(hashlib.md5(f"{mixing.SEED}:{ident}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            mean, p, total, n = rate / parts, math.exp(-rate / parts), math.exp(-rate / parts), 0
            while total <= u:
                n += 1
                p *= mean / n
                total += p
            count += n
        copies = sum(r[0] == d for r in rows)
        assert sum(r["doc_id"] == d for r in out) == count * copies
    assert sum(r["source"] == "a" for r in out) / len(out) == pytest.approx(0.75, abs=0.05)
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs, weights={"b": 1.0}).filter("source is null").count() == 0


CLASHES = ["rate", "n_copies", "copy_no", "shuffle_key", "row", "key", "ident", "_source", "_id", "_hash", "_shard", "_k", "_h", "at", "size", "tokens", "text_hash", "shards"]


def test_clashing_columns_are_kept(docs, rows):
    """Columns named as an operator's own come back as they were."""
    odd = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("node").cast("string")) for c in CLASHES})
    for out in (mixing.mix_sources(odd), sharding.shard_documents(odd, 3), minhash.near_dedup(odd)):
        assert set(odd.columns) <= set(out.columns)
        assert all(r[c] == f"{c}:{r['node']}" for r in out.collect() for c in CLASHES)
    assert mixing.fact_names(odd.columns) == ["rate_", "n_copies_", "copy_no_", "shuffle_key_"]


def test_mixing_deals_null_ids_by_their_text(spark):
    rows = [(None, f"text {i}", "s") for i in range(200)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    keys = [r["shuffle_key"] for r in out.collect()]
    assert len(set(keys)) == len(keys) and keys == sorted(keys)


def group_of(text):
    return len((text or "").encode()) + 1, text or ""


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_balance_and_keep_groups(docs, rows, shards):
    out = sharding.shard_rows(docs, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, group_of(t)[0], zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    # no group is larger than a shard here but the one of the longest text
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    homes = {}
    for r in out:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= max(1.05 * largest, 1.3 * total / shards)


@pytest.mark.parametrize("shards", [2, 5])
def test_place_matches_a_plain_reading(shards):
    rng = np.random.default_rng(15)
    weights = rng.integers(1, 50, (60, 3)).astype(float)
    residual = np.tile(weights.sum(0) / shards, (shards, 1))
    left, scale = residual.tolist(), residual.sum(0)
    expected = [0] * 60
    for i in sorted(range(60), key=lambda i: (-max(weights[i] / scale), i)):
        dots = [sum(left[s][k] / scale[k] * weights[i][k] / scale[k] for k in range(3)) for s in range(shards)]
        best = max(range(shards), key=lambda s: (round(dots[s], 12), -s))
        expected[i] = best
        left[best] = [a - b for a, b in zip(left[best], weights[i])]
    got = sharding.place(weights, residual)
    assert got.tolist() == expected
    assert residual == pytest.approx(np.array(left))
    loads = np.stack([weights[got == s].sum(0) for s in range(shards)])
    assert (loads.max(0) <= 1.25 * loads.mean(0)).all()


def test_shards_are_balanced_in_bytes_tokens_and_rows(spark):
    rng = np.random.default_rng(17)
    many = [(i, "w " * int(rng.zipf(1.6) % 400) + str(i % 900)) for i in range(4000)]
    out = sharding.shard_rows(spark.createDataFrame(many, "doc_id long, text string"), 8).collect()
    for weigh in (lambda r: r["size"], lambda r: 1):
        sizes = Counter()
        for r in out:
            sizes[r["shard"]] += weigh(r)
        assert len(sizes) == 8 and max(sizes.values()) <= 1.03 * min(sizes.values())


@pytest.mark.parametrize("ids", [True, False])
def test_shards_split_a_group_larger_than_a_shard(spark, ids):
    many = [(i if ids else None, "same text here") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    sizes = [r["b"] for r in sharding.shard_rows(df, 4).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    counts = [r["count"] for r in sharding.shard_documents(df, 4).groupBy("shard").count().collect()]
    assert len(counts) == 4 and sum(counts) == 800 and max(counts) < 1.5 * min(counts)


def test_shard_documents_keeps_columns(docs, rows, empty):
    out = sharding.shard_documents(docs.withColumn("shard", F.lit("x")), 4)
    assert out.columns == [*docs.columns, "shard"] and Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def brute_removals(rows):
    """(n_bytes, n_removed, n_spans, sha256) of every (doc_id, text)."""
    seen, out = {}, {}
    byte_texts = {(r[0], (r[1] or "").encode()) for r in rows}
    for d, b in byte_texts:
        for i in range(len(b) - suffixes.WINDOW + 1) if d is not None else ():
            w = b[i : i + suffixes.WINDOW]
            seen[w] = min(seen.get(w, d), d)
    for d, b in byte_texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - suffixes.WINDOW + 1) if d is not None else ():
            if seen[b[i : i + suffixes.WINDOW]] < d:
                gone[i : i + suffixes.WINDOW] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] = (d, b)
    return out


def removals_match(df, rows, hot=suffixes.HOT):
    got = suffixes.remove_repeats(df, keep_text=True, hot=hot).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert found == brute_removals(rows).keys()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("hot", [suffixes.HOT, 3, 1])
def test_repeats_are_removed_exactly(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 4000)  # many batches on the driver's side
    removals_match(docs, rows, hot)
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [suffixes.HOT, 4])
def test_repeats_of_one_doc_id_with_other_texts(spark, hot):
    """Rows of one doc_id take nothing from each other, and only what is theirs."""
    rng = np.random.default_rng(12)
    words = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, other = words(90), words(70)
    rows = [(1, words(60) + shared), (2, words(40) + shared + words(30)), (2, words(144)), (2, other + words(9)), (2, words(5) + other), (3, other), (3, other), (None, shared), (4, None), (4, "")]
    removals_match(spark.createDataFrame(rows, "doc_id long, text string"), rows, hot)


@pytest.mark.parametrize("hot", [suffixes.HOT, 5])
def test_repeats_in_periodic_and_very_long_text(spark, hot):
    rng = np.random.default_rng(13)
    long = "".join(rng.choice(list("abcdefghij \n"), 1_300_000))
    rows = [(1, "ab" * 60), (2, "x" + "ab" * 40 + "y"), (3, "b" * 49), (4, "b" * 200), (5, "b" * 51), (6, long), (7, long[700_000:700_300] + "é" * 40), (8, "zz" + long[1000:2000] + long[-80:])]
    removals_match(spark.createDataFrame(rows, "doc_id long, text string"), rows, hot)


def test_radix_order_sorts_groups():
    rng = np.random.default_rng(0)
    group, digits = rng.integers(0, 5, 400), rng.integers(0, 2, (400, 16)).astype(np.uint8)
    order = suffixes.radix_order(group, digits)
    keys = [(group[i], digits[i].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_base_scores_and_counts(docs, rows, empty):
    got = language_model.score_texts(docs).collect()
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 != 0
    tokens = lambda t: [*re.findall(SPACE, lower(t or "")), None]
    counts = Counter(w for d, t, *_ in rows if train(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t, *_ in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        expected[d, not train(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model.score_texts(empty).count() == 0


def test_scores_match_a_plain_reading(spark, monkeypatch):
    """The score of every text is the sum of its tokens' probabilities, each
    found one by one, and the probabilities of all words sum to one."""
    monkeypatch.setattr(language_model, "HEAD", 20)
    monkeypatch.setattr(language_model, "GROWTH", 0)
    monkeypatch.setattr(language_model, "KIND", 7)
    held = {}
    whole = language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: held.setdefault("model", whole(*a)))
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 60)) for i in range(80)] + [(80, None), (81, "unseen w1"), (None, "W1 w2")]
    got = language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    model, kinds = held["model"], language_model.kinds_of(20)
    hashed = lambda w: int(kernels.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash[0])
    tokens = lambda t: re.findall(SPACE, lower(t or ""))
    train = [tokens(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    head = sorted(counts, key=lambda w: (-counts[w], signed(hashed(w))))[:20]
    kind = {w: int(language_model.kind_of(np.array([hashed(w)], np.uint64), kinds)[0]) for w in {*counts, *(w for _, t in rows for w in tokens(t))}}
    rare = [w for w in counts if w not in head]
    n, v = Counter(), Counter()
    for w in rare:
        n[kind[w]] += counts[w]
        v[kind[w]] += 1
    outcome = lambda w: 20 if w is None else head.index(w) if w in head else 21 + kind[w]
    span = language_model.class_size(21 + kinds)

    def p(w, one, two):
        q = model["r"][one] * model["c1"] + model["r"][two] * model["c2"]
        own = np.exp(model["t"] @ q + model["b"])
        every = np.exp(model["u"] @ q + model["d"])
        o = outcome(w)
        share = (counts[w] + 0.1) / (n[kind[w]] + 0.1 * (v[kind[w]] + 1)) if o > 20 else 1
        c = o // span
        return share * every[c] / every.sum() * own[o] / own[c * span : (c + 1) * span].sum()

    start = 21 + kinds
    expected = []
    for d, t in rows:
        one, two, total = start, start, 0.0
        for w in [*tokens(t), None]:
            total += math.log10(p(w, one, two))
            one, two = outcome(w), one
        expected.append((-1 if d is None else d, total))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got) == [(d, pytest.approx(s, abs=1e-3)) for d, s in sorted(expected)]
    never = sum((0.1 / (n[k] + 0.1 * (v[k] + 1))) * p_kind for k, p_kind in enumerate(p_kinds(model, kinds, span, 3, 5)))
    assert sum(p(w, 3, 5) for w in [*counts, None]) + never == pytest.approx(1, abs=1e-4)


def p_kinds(model, kinds, span, one, two):
    q = model["r"][one] * model["c1"] + model["r"][two] * model["c2"]
    own, every = np.exp(model["t"] @ q + model["b"]), np.exp(model["u"] @ q + model["d"])
    return [every[o // span] / every.sum() * own[o] / own[o // span * span : (o // span + 1) * span].sum() for o in range(21, 21 + kinds)]


def test_log_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(5)
    unigram = np.full(language_model.HEAD + 2, 1.0 / (language_model.HEAD + 2))
    model = language_model.start_model(unigram)
    every = np.arange(language_model.HEAD + 2)
    p = np.exp(language_model.log_probability(every, np.full(len(every), 3), np.full(len(every), 4), model))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    trainer = language_model.Trainer(model, unigram, 0)
    for _ in range(60):  # each word is followed by the next of ten
        one = rng.integers(0, 10, 512)
        trainer.step((one + 1) % 10, one, rng.integers(0, 10, 512))
    before, after = (language_model.log_probability(np.array([4]), np.array([3]), np.array([7]), m)[0] for m in (model, trainer.p))
    assert after > before + 1


def test_language_model_vocabulary_grows_with_the_input(spark):
    # 3000 words of equal count, each always after the same other: more than HEAD learn it
    rng = np.random.default_rng(6)
    pairs = lambda: " ".join(f"a{i} b{i}" for i in rng.permutation(1500))
    texts = [(i, pairs()) for i in range(90)]
    odd = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0][:1500]
    texts += [(d, f"a{i} b{i}") for i, d in enumerate(odd[:750])] + [(d, f"a{i} b{(i + 1) % 750}") for i, d in enumerate(odd[750:])]
    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    own, swapped = [got[d] for d in odd[:750]], [got[d] for d in odd[750:]]
    # a word outside the vocabulary scores alike wherever it stands
    assert np.mean([a != b for a, b in zip(own, swapped)]) > 0.95
    assert language_model.head_size(100 * 10**6) > 3 * language_model.head_size(10**7) > 3 * language_model.HEAD


def brute_links(rows, cosine):
    """Per row: (vec_id, links, component) by comparing all pairs; repeated
    vec_ids are vectors each."""
    ok = [(at, i, l, np.array(v, float)) for at, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = Counter()
    root = {at: at for at in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[3]) == len(b[3]) and a[3] @ b[3] / math.sqrt((a[3] @ a[3]) * (b[3] @ b[3])) >= cosine:
            links[a[0]] += 1
            links[b[0]] += 1
            x, y = find(a[0]), find(b[0])
            root[max(x, y)] = min(x, y)
    least = {}
    for at, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(at)] = min(i, least.get(find(at), i))
    return Counter((i, links[at], None if i is None else least[find(at)]) for at, (i, *_) in enumerate(rows))


def vectors(seed, n, groups, spread, d=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    return [(i, [float(x) for x in (centre[i % groups] + rng.normal(0, spread, d)).astype(np.float32)], int(i % 2)) for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, node long, v string"


def test_embedding_links(spark):
    rows = vectors(2, 300, 12, 0.15)
    rows += [(400 + i, rows[0][1], 0) for i in range(20)]  # equal vectors
    rows += [(500, None, 0), (501, [0.0] * 4, 0), (502, [1.0, None, 0.0, 0.0], 0), (503, [float("nan"), 1.0, 1.0, 1.0], 0), (504, [float("inf"), 1.0, 1.0, 1.0], 1), (505, rows[0][1], None)]
    rows += [(506, [1.0], 0), (507, [], 0), (508, [2.0], 0), (None, rows[0][1], 0), (509, [1.0, 2.0, 3.0], 0), (510, [1.0, 2.0, 3.1], 0), (3, rows[0][1], 0), (3, rows[40][1], 0), rows[7]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = embeddings.link_embeddings(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows, embeddings.COSINE)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.link_embeddings(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "groups", "spread"), [(400, 40, 0.16), (1600, 60, 0.16), (5000, 40, 0.17)])
def test_embedding_recall_against_brute_force(spark, monkeypatch, n, groups, spread):
    """Links found of all links, in 16 dimensions, at three sizes; many lie near
    the threshold. """
    monkeypatch.setattr(embeddings, "CELL", 16)  # up to 13 codes a half
    rows = vectors(n, n, groups, spread, 16)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.link_embeddings(df).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.array([l for *_, l in rows])
    near = (x @ x.T >= embeddings.COSINE) & (label[:, None] == label[None, :])
    true = near.sum(1) - 1
    found = np.array([got[i] for i in range(n)])
    assert true.sum() > n and (found <= true).all()
    assert found.sum() >= 0.98 * true.sum() and found.sum() % 2 == 0


def test_traversal_is_in_multi_sequence_order():
    rng = np.random.default_rng(9)
    one, two = rng.random((30, 7)), rng.random((30, 5))
    rows, cells = embeddings.traverse(one, two, 0.4)
    for r in range(30):
        sums = (one[r][:, None] + two[r][None, :]).reshape(-1)
        own = cells[rows == r]
        assert (np.diff(sums[own]) >= 0).all()
        assert set(own.tolist()) == set(np.flatnonzero(sums <= sums.min() + 0.4).tolist())


def test_spaced_seeds_are_lossless():
    for missed in itertools.combinations(range(decontamination.WINDOW), decontamination.MISSES):
        assert any(all(at + p not in missed for p in mask) for mask in decontamination.MASKS for at in range(decontamination.WINDOW - max(mask)))
    for length in range(4, decontamination.WINDOW):
        _, misses = decontamination.allowed(length)
        for missed in itertools.combinations(range(length), misses):
            assert any(all(at + p not in missed for p in mask) for mask in decontamination.SHORT_MASKS for at in range(length - max(mask)))


def brute_overlaps(rows, items):
    read = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t or ""))
    out = set()
    for d, t, *_ in rows:
        w = read(t)
        for i, it in items:
            own = read(it)
            run, misses = decontamination.allowed(len(own))
            if len(own) < 4:
                continue
            for shift in range(-len(own), len(w)):
                same = [w[j + shift] == own[j] if 0 <= j + shift < len(w) else None for j in range(len(own))]
                if any(None not in same[a : a + run] and run - sum(same[a : a + run]) <= misses for a in range(len(own) - run + 1)):
                    out.add((d, i))
    return out


def test_overlaps_match_brute_force(spark, docs, rows, empty, monkeypatch):
    passage = rows[36][1].split()
    changed = list(passage)
    changed[3], changed[9] = "zzz", "yyy"
    items = [(1, " ".join(passage[:25])), (2, " ".join(changed[:14])), (3, "nothing alike " * 9), (4, None), (5, ""), (6, " ".join(passage[2:12])), (7, "ONE. two, three!"), (8, ", ".join(passage[4:9])), (9, " ".join(passage[20:44]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_overlaps(docs, bench)
    expected = brute_overlaps(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected and expected
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 150)  # several blocks
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(docs, bench).collect()} == expected
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, *_ in rows if d not in {x for x, _ in expected})
    assert decontamination.find_overlaps(empty, bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


def labelled(spark, good, bad, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, (good if i % 3 else bad)(rng), None, None, 0, 0, "") for i in range(600)]
    labels = [(i, int(bool(i % 3)), int(not i % 3)) for i in range(600)] + [(9999, 1, 0), (5, None, None), (None, 1, 1)]
    return spark.createDataFrame([*rows, (700, None, *[None] * 5), (701, "", *[None] * 5), (None, "a b", *[None] * 5), rows[3]], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain(rng, extra=()):
    vocab = [f"w{i}" for i in range(400)]
    words = [*rng.choice(vocab, 60), *extra]
    rng.shuffle(words)
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, 60, 12))


def test_toxicity_learns_and_handles_odd_rows(spark, empty):
    docs, labels = labelled(spark, plain, lambda rng: plain(rng, ["vile", "scum"]))
    model = toxicity.train(docs, labels, common.crc_mod("doc_id", 5) != 0)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_long_texts_end_no_sample(spark):
    texts = [(i, "vile é " * (2000 if i < 2 else 5)) for i in range(40)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), size=2000).collect()
    whole = dict(texts)
    for label in (0, 1):
        own = [r["text"] for r in got if r["label"] == label]
        assert len(own) == 20 and 1990 <= sum(len(t.encode()) for t in own) <= 2000
        assert sorted(own)[:19] == [whole[2]] * 19 and whole[0].startswith(max(own))
    with pytest.warns(UserWarning, match="toxic = 1"):
        toxicity.labelled_sample(docs, labels.filter("toxic = 0"), "toxic", F.lit(True))


def test_quality_learns_and_handles_odd_rows(spark, empty):
    docs, labels = labelled(spark, plain, lambda rng: "\n".join(" | ".join(rng.choice(["Home", "Buy", "Menu", "x!!"], 6)) for _ in range(6)))
    model = quality.train(docs, labels, common.crc_mod("doc_id", 4) != 2)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in held]) > 0.95
    assert quality.score_quality(empty, model).count() == 0


def test_mixed_documents_get_mixed_marginals(spark):
    """Bad documents are junk with a few good lines between: the field learns
    from document labels alone which lines are good."""
    import pyarrow as pa

    rng = np.random.default_rng(14)
    vocab = [f"w{i}" for i in range(300)]
    fine = lambda: " ".join(rng.choice(vocab, 12)).capitalize() + "."
    junk = lambda: " | ".join(rng.choice(["Home", "Buy", "Menu", "x!!"], 6))
    mixed = lambda: [fine() if k in (2, 3) else junk() for k in range(8)]
    texts = ["\n".join(mixed() if i % 2 else [fine() for _ in range(8)]) for i in range(300)]
    sample = pa.table({"label": [1 - i % 2 for i in range(300)], "draw": list(range(300)), "text": texts})
    model = quality.build(sample, 0.5)
    data, offs = next((d, o) for _, _, d, o in kernels.pieces(pa.array(["\n".join(mixed()) for _ in range(20)])))
    lines = quality.Lines(data, offs, model["common"])
    theta = model["theta"]
    good, _ = quality.marginals(((lines.x - model["mean"]) / model["std"]) @ theta[:-5] + theta[-5], lines.offs, theta[-4:].reshape(2, 2))
    good = good.reshape(20, 8)
    assert good[:, [2, 3]].mean() > 0.6 and good[:, [0, 1, 5, 6, 7]].mean() < 0.2
    scores = quality.score_texts(pa.array([texts[0], texts[1]]), model)
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_line_features_and_aggregation_match_a_plain_reading():
    import pyarrow as pa

    text = "Home | Buy!\n\nSome words here, some words.\nHome | Buy!"
    data, offs = next((d, o) for _, _, d, o in kernels.pieces(pa.array(["one line", text, ""])))
    lines = quality.Lines(data, offs, np.zeros(0, np.uint64))
    assert np.diff(lines.offs).tolist() == [1, 4, 1]
    own = text.split("\n")
    width = quality.FEATURES
    for k, line in enumerate(own):
        row = lines.x[1 + k]
        size, words = max(len(line), 1), line.split()
        assert row[0] == pytest.approx(sum(c.isupper() for c in line) / size)
        assert row[5] == pytest.approx(line.count("|") / size)
        tail = dict(zip(["size", "words", "mean", "square", "again", "distinct", "common", "short", "twin", "stop", "capital", "blank"], row[width - 12 : width]))
        assert tail["size"] == pytest.approx(math.log1p(len(line))) and tail["words"] == pytest.approx(math.log1p(len(words)))
        assert tail["distinct"] == pytest.approx(len({lower(w) for w in words}) / max(len(words), 1))
        assert (tail["twin"], tail["stop"], tail["capital"], tail["blank"]) == (own.count(line) > 1, line.endswith((".", "!", "?")), line[:1].isupper(), not line)
        assert np.array_equal(row[width : 2 * width], lines.x[k][:width] if k else np.zeros(width))
        assert np.array_equal(row[2 * width : 3 * width], lines.x[2 + k][:width] if k < 3 else np.zeros(width))
        assert row[-2:].tolist() == [k == 0, k == 3]
    good = np.array([0.5, 0.1, 0.9, 0.4, 0.2, 0.7])
    expected = np.average(good[1:5], weights=[len(line) + 1 for line in own])
    assert quality._aggregate(good, lines.size, lines.offs) == pytest.approx([0.5, expected, 0.7])


def test_kneser_ney_probabilities_match_counts_by_hand():
    """Every probability against dictionaries, and that they sum to one."""
    words = ["ab", "abc", "abd", "b", "ba", "bab", "ab" * 12]
    docs = np.array([[4, 1, 0, 3, 1, 0, 1], [1, 2, 5, 1, 0, 1, 1]])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    letters, at = toxicity.spelling(data, ends - [len(w) for w in words], ends)
    classes, p, spare = toxicity.probabilities(letters, at, docs)
    spelled = [f"<{w}>" for w in words]
    depth = toxicity.DEPTH
    grams = lambda w, n: [(w[max(0, i - n + 1) : i], w[i]) for i in range(1, len(w))]

    def counts(n, rows):
        out = Counter()
        for w, c in zip(spelled, docs[rows].sum(0)):
            for g in grams(w, n):
                out[g] += int(c)
        return +out

    d = lambda c: (lambda one, two: one / (one + 2 * two) if one and two else 0.5)(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    pooled, own = counts(depth, [0, 1]), [counts(depth, [c]) for c in (0, 1)]
    # (context, letter): in how many distinct longer contexts it was met
    longer = {(w[i - n - 1 : i], w[i]) for w in spelled for i in range(1, len(w)) for n in range(depth - 1) if min(i, depth - 1) > n}
    followed = Counter((context[1:], letter) for context, letter in longer)
    by_length = {n: {g: x for g, x in followed.items() if len(g[0]) == n} for n in range(depth)}

    def discounted(c, context, letter, strength, lower):
        inside = {g: x for g, x in c.items() if g[0] == context}
        total = sum(inside.values()) + strength
        if not total:
            return lower
        return max(c.get((context, letter), 0) - d(c), 0) / total + (strength + sum(min(x, d(c)) for x in inside.values())) / total * lower

    def shorter(context, letter):
        return discounted(by_length[len(context)], context, letter, 0, shorter(context[1:], letter) if context else 1 / 256)

    def brute(cls, context, letter):
        return discounted(own[cls], context, letter, toxicity.STRENGTH, discounted(pooled, context, letter, 0, shorter(context[1:], letter)))

    order, seen = toxicity.steps(letters, at, depth), set()
    pairs = [g for w in spelled for g in grams(w, depth)]
    for gram, (context, letter) in zip(order[1], pairs):
        k = int(np.searchsorted(classes.grams, gram))
        assert p[:, k] == pytest.approx([brute(c, context, letter) for c in (0, 1)])
        seen.add(context)
    for context in seen:
        assert sum(brute(1, context, x) for x in "abcd>") + 251 * brute(1, context, "?") == pytest.approx(1)
    assert followed["", "b"] == 2 and followed["b", ">"] == 2


def test_toxicity_finds_inflections_of_a_learnt_stem(spark):
    rng = np.random.default_rng(16)
    syllables = ["ka", "lo", "mi", "ten", "ru", "sa", "po", "ve"]
    word = lambda n: "".join(rng.choice(syllables, n))
    text = lambda *extra: " ".join(rng.permutation([*(word(int(rng.integers(1, 4))) for _ in range(60)), *extra]))
    docs = [(i, text(*[f"grrak{word(2)}" for _ in range(3)] if i % 3 == 0 else [])) for i in range(900)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, common.crc_mod("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.97


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    unary, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for path in itertools.product((0, 1), repeat=5):
        weight[path] = math.exp(sum(u * y for u, y in zip(unary, path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    good, pairs = quality.marginals(np.concatenate([unary, unary[:1]]), np.array([0, 5, 6]), trans)
    for t in range(5):
        assert good[t] == pytest.approx(sum(w for p, w in weight.items() if p[t]) / total)
    assert pairs[0][3] == pytest.approx(sum(w * sum(a and b for a, b in zip(p, p[1:])) for p, w in weight.items()) / total)
    assert pairs[1].tolist() == [0, 0, 0, 0]


def test_language_learns_and_names_the_undetermined(spark, empty):
    rng = np.random.default_rng(8)
    kinds = {"aa": list("abcde"), "bb": list("vwxyz")}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 4)) for _ in range(20)), k, None, 0, 0, "") for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa", *[None] * 4), (901, "12 !!", "aa", *[None] * 4), (902, "", None, *[None] * 4), (None, "abc bcd", None, *[None] * 4), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs, common.crc_mod("doc_id", 3) != 1)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows[:120]}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (900, 901, 902))
    many = spark.createDataFrame([(i, " ".join([chr(0x4E00 + i // 3)] * 30), f"l{i // 3:03}") for i in range(900)], "doc_id long, text string, lang string")
    told = language.identify(many, language.train(many, F.lit(True))).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] // 3:03}" for r in told]) > 0.9  # 300 languages
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_embeddings_of_any_size_link(spark):
    """Components near the ends of what a double holds."""
    rng = np.random.default_rng(3)
    plain = [(i, rng.normal(size=4).tolist(), 1) for i in range(40)]
    tiny, huge = rng.normal(size=4), rng.normal(size=4)
    rows = plain + [(50, (tiny * 1e-200).tolist(), 1), (51, (tiny * 3e-308).tolist(), 1), (52, (huge * 1e200).tolist(), 1), (53, (huge * 2e300).tolist(), 1), (54, [5e-324, 0.0, 0.0, 0.0], 2), (55, [1e308, 0.0, 0.0, 0.0], 2)]
    got = {r["vec_id"]: r for r in embeddings.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {i: k for i, _, k in rows}
    want = {i: sum(j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93 for j in unit) for i in unit}
    assert {i: r["n_links"] for i, r in got.items()} == want and want[50] and want[52] and want[54]


def test_clustered_labels_are_not_compared_as_a_whole(spark, monkeypatch):
    """Labels whose vectors crowd around a point of their own."""
    rng = np.random.default_rng(8)
    labels, each, d = 4, 1500, 32
    rows, unit, kind = [], [], []
    for k in range(labels):
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        for i in range(each):
            v = centre + rng.normal(size=d) * 0.12
            if i % 10 == 1:
                v = last + rng.normal(size=d) * 0.02
            last = v
            rows.append((k * each + i, v.tolist(), k))
            unit.append(v / np.linalg.norm(v))
            kind.append(k)
    monkeypatch.setattr(embeddings, "CELL", 16)
    unit, kind = np.array(unit), np.array(kind)
    close = (unit @ unit.T >= 0.93) & (kind[:, None] == kind)
    want = close.sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.98 * want.sum() and want.sum() > 500


def test_repeated_words_meet_on_stretches_of_diagonals(monkeypatch):
    """Runs of one word, periods and edges against all diagonals."""
    import pyarrow as pa

    monkeypatch.setattr(decontamination, "AT_ONCE", 64)
    rng = np.random.default_rng(1)

    def plain(doc, item):
        a, b = doc.split(), item.split()
        run, misses = decontamination.allowed(len(b))
        for diagonal in range(-len(b), len(a)) if len(b) >= 4 else ():
            cells = [(diagonal + j, j) for j in range(len(b)) if 0 <= diagonal + j < len(a)]
            same = [a[i] == b[j] for i, j in cells]
            good = [k for k in range(len(same) - run + 1) if sum(same[k : k + run]) >= run - misses]
            while good:
                k = next((n for n in range(1, len(good)) if good[n] - good[n - 1] > run), len(good))
                lo, hi = good[0], good[k - 1] + run
                yield diagonal + cells[lo][1], cells[lo][1], hi - lo, sum(same[lo:hi])
                good = good[k:]

    for _ in range(40):
        some = ["a", "b", "c"][: rng.integers(1, 4)]
        words = lambda n: " ".join(rng.choice(some, rng.integers(0, n)))
        docs = [*(words(50) for _ in range(3)), "a " * int(rng.integers(0, 50)), "x " + "a " * 20 + "b " * 15, ""]
        items = [*(words(40) for _ in range(3)), "a " * int(rng.integers(0, 40)), "b " * 9 + "a " * 12, "q"]
        index = decontamination.build_index(pa.array(range(6), pa.int64()), pa.array(items, pa.string()))
        got = sorted((first + int(t), *map(int, rest)) for first, _, data, offs in kernels.pieces(pa.array(docs)) for t, *rest in decontamination.overlaps(kernels.Words(data, offs, kernels.PUNCTUATION), index))
        assert got == sorted((t, i, *r) for t, doc in enumerate(docs) for i, item in enumerate(items) for r in plain(doc, item))
    monkeypatch.undo()
    index = decontamination.build_index(pa.array([1]), pa.array(["a " * 400]))
    for _, _, data, offs in kernels.pieces(pa.array(["a " * 100_000])):
        assert len(decontamination.overlaps(kernels.Words(data, offs, kernels.PUNCTUATION), index)) == 100_000 + 400 - 25


def test_language_model_kernels_give_plain_sums():
    rng = np.random.default_rng(3)
    rows, values = rng.integers(0, 50, 1000), rng.normal(size=(1000, 3))
    keys, sums = language_model._scatter(rows, values)
    assert list(keys) == sorted(set(rows)) and np.allclose(sums, [values[rows == k].sum(0) for k in keys])
    # small products, and products whose exponential would overflow
    for scale in (0.1, 1e3):
        q, vectors, bias = (rng.normal(0, scale, shape).astype(np.float32) for shape in ((1500, 4), (9, 4), 9))
        plain = np.minimum((q @ vectors.T + bias).astype(float), float(language_model.LARGEST))
        with np.errstate(divide="ignore"):
            got, want = language_model._log_sums(q, vectors, bias), np.log(np.exp(plain).sum(1))
        far = want < -80
        assert np.allclose(got[~far], want[~far], atol=1e-3)
