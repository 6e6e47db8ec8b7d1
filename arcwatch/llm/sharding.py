"""Sharding by vector bin packing.

Groups of equal texts are placed one after the other, largest first, on the
shard where the dot product of the group's (bytes, tokens, rows) with the
shard's residual capacity is highest.

A strictly global greedy pass would be serial, so it is done in two layers
that share one rule.  Heavy groups, whose share of any of the three sums
exceeds 1/(shards * HEAVY), number at most 3 * shards * HEAVY and are placed
first, in one pass on the driver.  The rest are dealt by hash into cells of
about CELL groups; each cell fills its own part of the capacity that the heavy
groups left.  A group larger than a whole shard cannot stay together and is
split by doc_id over as many shards as it fills.

Nulls: a null text has size 1 and the empty text's group.  Null doc_ids are
rows like others; in a split group they are dealt by their place in the input.
Repeated rows are rows of one group.  Ties of weight go by size and hash of the
group, ties of residual capacity to the smaller shard.  An empty table gives no
rows.  Documents keep all their columns; one named ``shard`` is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

HEAVY = 256
CELL = 20_000
SLOTS = 50_000

_GROUP = ["size", "text_crc32", "text_hash"]
_DIMS = ["bytes", "tokens", "rows"]


def place(weights: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shards of the weight rows, largest first; residual is used up in place."""
    scale = np.maximum(residual.clip(min=0).sum(0), 1e-300)
    items, left = weights / scale, residual / scale
    out = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -items.max(1))):
        at = int(np.argmax(left @ items[i]))
        left[at] -= items[i]
        out[i] = at
    residual[:] = left * scale
    return out


def _packer(part: np.ndarray):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(_GROUP, ignore_index=True)
        weights = cell[_DIMS].to_numpy(float)
        residual = weights.sum(0) * part
        return cell[_GROUP].assign(shard=place(weights, residual))

    return run


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        *more,
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("at"),
    )


def _tokens() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long").alias("tokens")


def placements(groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Shards of the heavy groups (a list each, more than one where a group is
    split), and the shard of every other group."""
    spark = groups.sparkSession
    sums = groups.agg(*[F.sum(d).alias(d) for d in _DIMS], F.count("*").alias("n")).first()
    totals = np.array([max(sums[d] or 0, 1) for d in _DIMS], float)
    is_heavy = F.greatest(*[F.col(d) / float(t) for d, t in zip(_DIMS, totals)]) >= 1 / (shards * HEAVY)

    residual = np.tile(totals / shards, (shards, 1))
    heavy = groups.filter(is_heavy).orderBy(*_GROUP).collect()  # at most 3 * shards * HEAVY
    split = [max(1, min(g["rows"], math.ceil(max(g[d] / t for d, t in zip(_DIMS, totals)) * shards))) for g in heavy]
    weights = np.array([[g[d] / n for d in _DIMS] for g, n in zip(heavy, split) for _ in range(n)], float).reshape(-1, 3)
    chosen = iter(place(weights, residual).tolist())
    placed = [(*(g[c] for c in _GROUP), [next(chosen) for _ in range(n)]) for g, n in zip(heavy, split)]
    heavy_at = spark.createDataFrame(placed, "size long, text_crc32 long, text_hash long, shards array<int>")

    part = residual.clip(min=0) + 1e-9
    cells = max(1, round(sums["n"] / CELL))
    light = groups.filter(~is_heavy).withColumn("cell", F.pmod(F.xxhash64("text_hash", "size"), F.lit(cells)))
    return heavy_at, light.groupBy("cell").applyInPandas(_packer(part / part.sum(0)), "size long, text_crc32 long, text_hash long, shard int")


def _grouped(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy(*_GROUP).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")


def _placed(rows: DataFrame, heavy_at: DataFrame, light_at: DataFrame) -> DataFrame:
    """rows (with the columns of their group, doc_id and at) with their shard."""
    known = rows.join(F.broadcast(heavy_at), _GROUP, "left")
    piece = F.pmod(F.xxhash64(F.coalesce("doc_id", "at")), F.size("shards").cast("long")).cast("int")
    hot = known.filter("shards is not null").withColumn("shard", F.get("shards", piece)).drop("shards")
    rest = known.filter("shards is null").drop("shards").join(light_at, _GROUP)
    return hot.unionByName(rest)


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, shard, slot for every row of docs."""
    rows = cut(_measured(docs, _tokens()), "measured")
    placed_rows = cut(_placed(rows.drop("tokens"), *placements(_grouped(rows), shards)), "placed")

    spread = max(1, math.ceil(rows.count() / SLOTS))
    placed_rows = placed_rows.withColumn("lot", F.pmod(F.xxhash64("at"), F.lit(spread)))
    lots = placed_rows.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    before = lots.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("lot")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("doc_id", *_GROUP)) - 1
    return placed_rows.drop("at").withColumn("within", within).join(before, ["shard", "lot"]).withColumn("slot", F.col("base") + F.col("within")).drop("lot", "base", "within")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with a ``shard`` column; any column of that name is replaced."""
    docs = docs.drop("shard")
    groups = _grouped(_measured(docs, _tokens()))
    # the row as one value, so that no name of its columns matters
    placed = _placed(_measured(docs, F.struct("*").alias("row")), *placements(groups, shards))
    return placed.select("row.*", "shard")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
