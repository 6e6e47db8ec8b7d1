"""Benchmark decontamination by spaced-seed hashing.

A seed reads the words at fixed positions of a window and ignores the others,
so it survives substitutions at the ignored positions.  Seeds of documents are
looked up among the seeds of the benchmark; every hit fixes an alignment of
document and item, which is then compared word by word around the hit.

A document overlaps an item if some alignment has a run of ``WINDOW`` words
with at most ``MISSES`` substitutions.  Items shorter than ``WINDOW`` must be
met in full, with one substitution from eight words on and none below; items
under four words are no evidence.  Words are runs of letters and digits, ASCII
letters lower-cased, so punctuation and line ends do not hide a passage.

The masks are lossless: however two substitutions fall in thirteen words, one
mask has a place that avoids both, so no overlap is missed.

The benchmark is the stated query set.  It is broadcast in blocks of at most
``BLOCK_BYTES`` of text, one pass of the documents for each, so its size is
bounded whatever it grows to; documents are never shuffled.

Nulls: null texts and items have no words.  A null doc_id or item_id is
carried as null.  Repeated rows give repeated results, and equal items are met
each.  A text and an item that repeat one word overlap on every diagonal where
their runs meet, and each is a row, found in time linear in the text.  A document keeps its other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .kernels import PUNCTUATION, Words, mix, pieces

WINDOW, MISSES = 13, 2
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SHORT_MASKS = ((0, 1, 2, 3),)
BLOCK_BYTES = 16 << 20
#: Hits, or words of diagonals, that are held at once.
AT_ONCE = 1 << 21

_U = np.uint64
_BITS = 20


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - max(mask)
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, len(mask), _U)
    for p in mask:
        out = out * _U(0x9E3779B97F4A7C15) + words[p : n + p]
    return mix(out)


def allowed(length: int) -> tuple[int, int]:
    """(run of words, substitutions) that an item of this length must show."""
    if length >= WINDOW:
        return WINDOW, MISSES
    return length, int(length >= 8)


def _runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of one repeated word of this length at least."""
    edge = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]])) if len(words) else np.zeros(1, np.int64)
    start, length = edge[:-1], np.diff(edge)
    return start[length >= least], length[length >= least]


def _inside(n: int, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Which of n places begin a window of this width inside one of the runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(start, n), 1)
    np.add.at(step, np.minimum(start + length - width + 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def build_index(item_ids: pa.Array, texts: pa.Array) -> dict:
    """Words of the items, and sorted seed tables for one block: for each mask
    those of windows of several words, and those inside runs of one repeated
    word, which come with the runs."""
    hashes, lengths = [np.zeros(0, _U)], []
    for _, _, data, offs in pieces(texts):
        words = Words(data, offs, PUNCTUATION)
        hashes.append(words.hash)
        lengths.append(np.diff(words.offs))
    words = np.concatenate(hashes)
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    offs = np.concatenate([[0], np.cumsum(length)])
    tables = []
    for masks, fits in ((MASKS, length >= WINDOW), (SHORT_MASKS, (length >= 4) & (length < WINDOW))):
        for mask in masks:
            width = max(mask) + 1
            seed, item, place, within = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for i in np.flatnonzero(fits):
                own = words[offs[i] : offs[i + 1]]
                start, size = _runs(own, width)
                for at, n in zip(start.tolist(), size.tolist()):
                    runs.setdefault(int(own[at]), []).append((int(i), at, n))
                seeds = _seeds(own, mask)
                within.append(_inside(len(seeds), start, size, width))
                seed.append(seeds)
                item.append(np.full(len(seeds), i))
                place.append(np.arange(len(seeds)))
            seed, item, place, within = map(np.concatenate, (seed, item, place, within))
            for inside in (False, True):
                chosen = np.flatnonzero(within == inside)
                order = chosen[np.argsort(seed[chosen], kind="stable")]
                seen = np.zeros(1 << _BITS, bool)
                seen[seed[order] >> _U(64 - _BITS)] = True
                tables.append((mask, seed[order], item[order], place[order], seen, runs if inside else None))
    return {"ids": item_ids.to_pylist(), "words": words, "offs": offs, "tables": tables}


def _hits(words: Words, index: dict) -> np.ndarray:
    """Distinct (text, item, diagonal) of all seed hits.

    Two runs of one word meet on a stretch of diagonals, which is written down
    as such rather than seed by seed, as all seeds inside them are alike; other
    hits are made distinct AT_ONCE at a time, as one number each.
    """
    owner = np.repeat(np.arange(len(words.offs) - 1), np.diff(words.offs))
    items = len(index["offs"]) - 1
    longest = int(np.diff(index["offs"]).max(initial=0))
    # a diagonal is over -longest; texts of a piece, items of a block and words fit
    span = longest + int(np.diff(words.offs).max(initial=0)) + 1
    found = [np.zeros(0, np.int64)]

    def met(text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> None:
        found.append(np.unique((text * items + item) * span + diagonal + longest))

    for mask, seeds, of_item, places, seen, runs in index["tables"]:
        width = max(mask) + 1
        own = _seeds(words.hash, mask)
        alike = np.zeros(len(own), bool)
        if runs:
            here = np.isin(words.hash, np.array(list(runs), _U))
            for text in np.unique(owner[here]).tolist():
                first, end = words.offs[text], words.offs[text + 1]
                start, size = _runs(words.hash[first:end], width)
                alike[first : min(end, len(own))] |= _inside(end - first, start, size, width)[: max(0, len(own) - first)]
                for at, n in zip(start.tolist(), size.tolist()):
                    for item, place, m in runs.get(int(words.hash[first + at]), ()):
                        stretch = np.arange(at - place - m + width, at + n - width - place + 1)
                        met(np.full(len(stretch), text), np.full(len(stretch), item), stretch)
        if not len(own) or not len(seeds):
            continue
        at = np.flatnonzero(seen[own >> _U(64 - _BITS)] & ~alike & (owner[: len(own)] == owner[width - 1 :]))
        lo, hi = np.searchsorted(seeds, own[at]), np.searchsorted(seeds, own[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        ends = np.cumsum(n)
        while len(at):
            many = max(1, int(np.searchsorted(ends, ends[0] - n[0] + AT_ONCE, "right")))
            k = n[:many]
            entry = np.repeat(lo[:many] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            place = np.repeat(at[:many], k)
            text = owner[place]
            met(text, of_item[entry], place - words.offs[text] - places[entry])
            at, lo, n, ends = at[many:], lo[many:], n[many:], ends[many:]
    codes = np.unique(np.concatenate(found))
    pair, diagonal = codes // span, codes % span - longest
    return np.stack([pair // max(items, 1), pair % max(items, 1), diagonal], 1)


def _verified(words: Words, index: dict, text: int, item: int, diagonals: np.ndarray) -> np.ndarray:
    """Rows of overlaps on some diagonals of a text and an item."""
    first, end = words.offs[text], words.offs[text + 1]
    own = index["words"][index["offs"][item] : index["offs"][item + 1]]
    run, misses = allowed(len(own))
    n, size = int(end - first), len(own)
    padded = np.concatenate([np.zeros(size, _U), words.hash[first:end], np.zeros(size, _U)])
    at = diagonals + size
    # neighbouring diagonals are a view, others are copied row by row
    at = slice(int(at[0]), int(at[-1]) + 1) if at[-1] - at[0] == len(at) - 1 else at
    same = np.lib.stride_tricks.sliding_window_view(padded, size)[at] == own
    kind = np.int16 if size < 1 << 15 else np.int32
    edge = (diagonals < 0) | (diagonals + size > n)
    if edge.any():
        place = diagonals[edge, None] + np.arange(size)
        same[edge] &= (place >= 0) & (place < n)
    total = np.zeros((len(diagonals), size + 1), kind)
    np.cumsum(same, 1, out=total[:, 1:], dtype=kind)
    good = total[:, run:] - total[:, :-run] >= run - misses
    if edge.any():
        # the run itself lies in the text
        start = diagonals[edge, None] + np.arange(size - run + 1)
        good[edge] &= (start >= 0) & (start + run <= n)
    row, at = np.nonzero(good)
    if not len(row):
        return np.zeros((0, 6), np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(row) > 0) | (np.diff(at) > run)]))
    last = np.append(new[1:], len(row)) - 1
    row, lo, hi = row[new], at[new], at[last] + run
    return np.stack([np.full(len(row), text), np.full(len(row), item), diagonals[row] + lo, lo, hi - lo, total[row, hi] - total[row, lo]], 1)


def overlaps(words: Words, index: dict) -> np.ndarray:
    """Rows (text, item, first word in text, first word in item, words, same
    words) of every verified overlap; runs that overlap on a diagonal are one."""
    hits = _hits(words, index)
    out = [np.zeros((0, 6), np.int64)]
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(hits[:, :2], axis=0) != 0).any(1)])) if len(hits) else []
    for a, b in zip(edges, [*edges[1:], len(hits)]):
        text, item = hits[a, :2].tolist()
        size = max(1, AT_ONCE // max(1, int(index["offs"][item + 1] - index["offs"][item])))
        for at in range(a, b, size):
            out.append(_verified(words, index, text, item, hits[at : min(at + size, b), 2]))
    return np.concatenate(out)


def _passes(benchmark: DataFrame, through: Callable) -> Iterator[DataFrame]:
    """through(index) for the broadcast index of each bounded block of the
    benchmark.  With several blocks each result is written, so that one index at
    a time is held."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        index = spark.sparkContext.broadcast(build_index(block.column("item_id").combine_chunks(), block.column("text").combine_chunks()))
        found = through(index)
        if blocks > 1:
            found = cut(found, "pass")
            index.unpersist()
        yield found


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_same: verified overlaps."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def of(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0), []
                for first, _, data, offs in pieces(batch.column(1)):
                    met = overlaps(Words(data, offs, PUNCTUATION), index.value)
                    met[:, 0] += first
                    rows.append(met)
                cols = np.concatenate(rows or [np.zeros((0, 6), np.int64)]).T
                yield pa.record_batch(
                    [ids.take(pa.array(cols[0])), pa.array(index.value["ids"], pa.int64()).take(pa.array(cols[1])), *map(pa.array, cols[2:])],
                    names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same"],
                )

        return run

    schema = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_same long"
    return reduce(DataFrame.union, _passes(benchmark, lambda index: docs.mapInArrow(of(index), schema)))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that overlap no benchmark item."""
    at = docs.columns.index("text")

    def of(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for first, _, data, offs in pieces(batch.column(at)):
                    clean[first + overlaps(Words(data, offs, PUNCTUATION), index.value)[:, 0]] = False
                yield batch.filter(pa.array(clean))

        return run

    left = docs

    def through(index) -> DataFrame:
        nonlocal left
        return left.mapInArrow(of(index), docs.schema)

    for left in _passes(benchmark, through):
        pass
    return left


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_spans"), F.max("n_words").alias("longest"), F.max(F.col("n_same") / F.col("n_words")).alias("identity"))
