"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash permutations gives two signature values, the
smallest and the largest, so half as many hashes are evaluated as values are
banded.  Documents that share a band are candidates; every link is confirmed
on the full shingle sets.

How whole groups are kept cheap and whole:

1. Documents with the same shingle set are one node (aggregation by set
   fingerprint), so exact copies never pair.
2. In each band bucket every node is compared with the bucket's hub, the
   member that shares most buckets with others: rows, not pairs.
3. Links lost by looking at hubs alone are found exactly: wherever a bucket
   still holds nodes of several components, the nodes outside its largest
   component are compared with all its nodes, in blocks of up to ``BLOCK``.
   Pairs inside one component need no comparison.

Nulls: a null text has no shingles; a row with null doc_id gets its size and a
null component.  Rows that repeat a doc_id are one document, linked by any of
their texts that is compared.  Texts without words link with nothing.  Ties: of
equal sets the smallest doc_id stands for all, of equal hubs the smallest node.
Other columns are ignored, and kept in filtering.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join
from .components import components
from .kernels import Words, mix, pieces, shingles

#: Rows to a band, bands: a pair at similarity 0.8 misses all bands with
#: probability (1 - 0.8**7)**48 = 1.2e-5.
BAND_ROWS, BANDS = 7, 48
PERMUTATIONS = BAND_ROWS * BANDS // 2
BLOCK = 512
#: Nodes that one task compares with a hub.
HUB_ROWS = 1024
_SEED = 20240517

_U = np.uint64


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    draw = rng.integers(0, 1 << 32, (2, PERMUTATIONS, 1), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offs in pieces(column):
        hashes, bounds = shingles(Words(data, offs), k)
        for i in range(end - first):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def signature(values: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima then maxima of one set under all permutations."""
    low = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros(len(mul), np.uint32)
    short = (values >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        hashed = short[None, at : at + 2048] * mul + add
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return np.concatenate([low, high])


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    one = np.sum(mix(values), dtype=_U).view(np.int64)
    two = np.sum(mix(values ^ _U(0xA5A5A5A55A5A5A5A)), dtype=_U).view(np.int64)
    return int(one), int(two)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _permutations()
        bands = mix(np.arange(1, BANDS + 1, dtype=_U))
        for batch in batches:
            rows = len(batch)
            sizes, prints, kept = np.zeros(rows, np.int64), np.zeros((2, rows), np.int64), []
            for i, values in enumerate(_sets(batch.column(1), k)):
                sizes[i] = len(values)
                if len(values):
                    prints[:, i] = _fingerprint(values)
                    kept.append(signature(values, mul, add))
            keys = np.zeros(0, np.int64)
            if kept:
                sig = np.stack(kept).reshape(len(kept), BANDS, BAND_ROWS).astype(_U)
                key = np.broadcast_to(bands, (len(kept), BANDS)).copy()
                for j in range(BAND_ROWS):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, j])
                keys = key.reshape(-1).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                names=["doc_id", "n_shingles", "fp1", "fp2", "keys"],
            )

    return run


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(k: int, percent: int):
    """Candidate pairs with both texts -> the pairs that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            xs, hubs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, ok = batch.column(3), np.zeros(len(batch), bool)
            for i, values in enumerate(_sets(batch.column(2), k)):
                if hubs[i] != hub:
                    hub, hub_set = hubs[i], next(_sets(texts.slice(i, 1), k))
                ok[i] = _alike(values, hub_set, percent)
            yield pa.record_batch([pa.array(xs[ok]), pa.array(hubs[ok])], names=["a", "b"])

    return run


def _search(k: int, percent: int):
    """One block of nodes against the queries sent to it: a link from each
    query to every other component it touches there."""

    def run(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        members = block.column("node").to_numpy()
        labels = block.column("label").to_numpy()
        sets = list(_sets(block.column("text"), k))
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        a, b = [], []
        ids, own = queries.column("node").to_numpy(), queries.column("label").to_numpy()
        for i, values in enumerate(_sets(queries.column("text"), k)):
            lo, hi = np.searchsorted(every, values), np.searchsorted(every, values, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero((100 * both >= percent * (len(values) + sizes - both)) & (labels != own[i]))
            for j in hit[np.unique(labels[hit], return_index=True)[1]]:
                a.append(ids[i])
                b.append(members[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links documents whose k-word shingle sets have at least percent/100
    Jaccard similarity; component_id is the smallest doc_id reachable.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = cut(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>"), "signatures")
    prints = ["fp1", "fp2", "n_shingles"]
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("node"))

    # bucket rows of one row per class, where a bucket has more than one class
    nodes = signed.join(classes, prints).filter("doc_id = node").dropDuplicates(["node"] + prints).select("node", F.col("n_shingles").alias("n"), "keys")
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = cut(rows.join(shared, "key"), "buckets")

    degree = buckets.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = cut(buckets.join(degree, "node"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("h"))
    hubs = hubs.select("key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    starred = ranked.join(hubs, "key").filter("node <> hub").select("node", "n", "hub", "hub_n")
    starred = starred.groupBy("node", "n", "hub", "hub_n").agg(F.count("*").alias("times"))
    star = cut(starred, "star")
    fits = star.filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))

    wanted = buckets.select("node").distinct()
    texts = cut(docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node"), "texts")
    # a hub of very many nodes goes to as many tasks as they fill, with its text
    crowds = fits.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).alias("ways"))
    met = spread_join(fits.select("node", "hub"), crowds, ["hub"], "node").withColumn("way", F.pmod(F.xxhash64("node"), F.col("ways"))).drop("ways")
    hub_texts = texts.join(crowds, F.col("node") == F.col("hub")).withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    pairs = met.join(texts, "node").join(hub_texts.select("hub", "way", F.col("text").alias("hub_text")).hint("merge"), ["hub", "way"])
    links = cut(pairs.select("node", "hub", "text", "hub_text").mapInArrow(_verify(k, percent), "a long, b long"), "links")
    found = cut(components(links), "labels")

    # what hubs alone can miss
    label = F.coalesce("label", "node").alias("label")
    placed = buckets.join(found, "node", "left").select("key", "node", label)
    tally = placed.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("largest"), F.count("*").alias("labels"))
    open_keys = tally.filter("labels > 1").select("key", "largest")
    home = star.groupBy("node").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("home"))
    homed = placed.join(open_keys, "key").join(home, "node", "left").withColumn("home", F.coalesce("home", "node"))
    homed = cut(homed, "open")
    crowd = homed.select("home", "node").distinct().groupBy("home").agg(F.count("*").alias("size"))
    homed = spread_join(homed, crowd, ["home"], "node").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))))
    block_of = cut(homed.select("key", "node", "label", "largest", "block"), "blocks")
    asked = block_of.filter("label <> largest").select("key", "node", "label")
    asked = asked.join(block_of.select("key", "block").distinct(), "key").select("node", "label", "block").distinct()
    salts = asked.groupBy("block").agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("salts"))
    asked = asked.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    blocks = block_of.select("node", "label", "block").distinct().join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    left = asked.select("block", "salt", "node", "label").join(texts, "node").toDF("node", "block", "salt", "label", "text").groupBy("block", "salt")
    right = blocks.select("block", "salt", "node", "label").join(texts, "node").toDF("node", "block", "salt", "label", "text").groupBy("block", "salt")
    more = cut(left.cogroup(right).applyInArrow(_search(k, percent), "a long, b long"), "more")
    if more.isEmpty():
        labels = found
    else:
        labels = cut(components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "labels")

    member = signed.drop("keys").join(classes, prints, "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "node", "doc_id"))
    return member.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, with one document of each group of
    near-duplicates (the smallest doc_id); rows with null doc_id stay."""
    member = near_components(docs, k, percent)
    gone = member.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_components(table(spark, sf_dir, "documents"), k=4, percent=80)
