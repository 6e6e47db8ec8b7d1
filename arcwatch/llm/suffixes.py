"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte goes if it lies in a window of ``WINDOW`` bytes that also starts in a
document of smaller doc_id.  Suffixes need ordering only through the window's
depth: suffixes equal so far stay one group, and groups that reach the full
depth are exactly the repeated windows.

The first digits are passed on the cluster, and prune nearly everything:

1. Equal texts: all but the smallest doc_id go whole, and need no sorting.
2. The window's *anchor*, the ``ANCHOR`` bytes of least hash in it, is chosen
   by content alone, so equal windows agree on it and none is lost.  Anchors
   are radix-bucketed by their hash; an anchor that one document alone has ends
   its group there.
3. Occurrences of the remaining anchors are bucketed with the bytes around
   them.  Inside a bucket, suffixes to the right and (reversed) prefixes to the
   left of an anchor are ordered by most-significant-digit passes over eight
   bytes at a time, dropping groups of one as they appear.  Prefix classes at
   each depth follow from the order, and a window's group is its pair of
   classes.  These groups are of equal bytes, not of equal hashes.
4. An anchor met ``HOT`` times or more (a passage that very many documents
   share) would gather all of them in one bucket.  Its windows are reduced
   where they are instead: a batch sends each distinct window once, with its
   smallest doc_id, known by 128 bits of hash and dealt by them; what returns
   to the batch is which of its windows have a smaller document elsewhere.

Buckets grow in number with the input and no anchor fills one, so a task stays
as large as it is.

Nulls: a null text is empty.  A null doc_id matches nothing and loses nothing.
Texts shorter than a window lose nothing.  Rows that repeat a doc_id do not
count as smaller than each other, whether their texts are alike or not; windows
repeated within one document stay.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, table
from .kernels import lookup, mix, pieces, prefix_hash, span_hash

WINDOW = 50
ANCHOR = 18
SIDE = WINDOW - ANCHOR
BATCH = 8 << 20
#: Bytes of text whose anchors are found at once.
PART = 1 << 19
BUCKET = 32 << 20
#: Occurrences from which an anchor's windows are reduced in their batches.
HOT = 4096

_U = np.uint64
#: A second reading of the bytes, for a hash that does not follow from the first.
_OTHER = (np.arange(256, dtype=np.uint16) * 167 % 256).astype(np.uint8) ^ np.uint8(0x5A)


def _sliding(v: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over v[i : i + width] for every i with a full span."""
    out, done = v, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in data, hash) of the anchors of all windows of a piece."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    if len(data) < WINDOW:
        return none
    starts = np.arange(len(data) - ANCHOR + 1)
    grams = span_hash(prefix_hash(data), starts, starts + ANCHOR)
    v = (grams >> _U(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(v, SIDE + 1, np.minimum)
    # windows that cross the end of a text are none
    inside = np.zeros(len(least) + 1, np.int32)
    size = np.diff(offs)
    long = np.flatnonzero(size >= WINDOW)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - WINDOW + 1, -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint32(0))
    edge = np.zeros(SIDE, np.uint32)
    best = _sliding(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum)
    at = np.flatnonzero(best == v)
    # least hashes are small numbers; mixed again, they spread over buckets
    return np.searchsorted(offs, at, "right") - 1, at, mix(grams[at] + _U(1))


def _lists(columns: list[np.ndarray], start: np.ndarray) -> list[pa.Array]:
    """Arrow lists of consecutive values, one list from each start."""
    offsets = pa.array(np.append(start, len(columns[0])).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal values starts."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _flat(column: pa.ChunkedArray, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row each came from; a null list is
    empty."""
    column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy().astype(kind), np.repeat(np.arange(len(column)), sizes)


def kept_bits(bits: int) -> int:
    """Bits of an anchor's hash that are kept beside those of its bucket."""
    return min(48, 63 - bits)


ANCHORS = "bucket long, batch long, anchors array<long>, busy array<long>, times array<long>"


def _first_pass(bits: int):
    """(batch, text) -> the anchors of a block of rows (``BATCH`` bytes of text)
    by bucket and batch: once for one document and twice for more.  Anchors met
    more than twice come with how often they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in pieces(batch.column(1), BATCH):
                yield block(batch.column(0).slice(first, end - first).to_numpy(), batch.column(1).slice(first, end - first))

    def block(number: np.ndarray, text: pa.Array) -> pa.RecordBatch:
        docs, found = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        for first, _, data, offs in pieces(text, PART):
            rows, _, h = anchors(data, offs)
            docs.append(first + rows)
            found.append(h)
        doc, h = np.concatenate(docs), np.concatenate(found)
        owner = number[doc] if len(doc) else doc
        by = np.lexsort((doc, h, owner))
        doc, h, owner = doc[by], h[by], owner[by]
        run_at = _starts(owner, h)
        times = np.diff(np.append(run_at, len(h)))
        new_doc = np.zeros(len(h), np.int64)
        new_doc[_starts(owner, h, doc)] = 1
        rank = np.cumsum(new_doc) - np.repeat(np.cumsum(new_doc)[run_at], times)
        kept = (new_doc > 0) & (rank < 2)
        # a busy anchor's count stands beside its first row; the others count 0
        count = np.zeros(len(h), np.int64)
        count[run_at] = np.where(times > 2, times, 0)
        owner, h, count = owner[kept], h[kept], count[kept]
        bucket = (h >> _U(64 - bits)).astype(np.int64)
        low = ((h << _U(bits)) >> _U(64 - kept_bits(bits))).astype(np.int64)
        start = _starts(owner, bucket)
        busy = count > 0
        anchors_list = _lists([low], start)
        busy_lists = _lists([low[busy], count[busy]], np.searchsorted(np.flatnonzero(busy), start))
        return pa.record_batch([pa.array(bucket[start]), pa.array(owner[start]), *anchors_list, *busy_lists], names=["bucket", "batch", "anchors", "busy", "times"])

    return run


def _shared_anchors(bits: int, hot: int):
    """One bucket -> (batch, keys, hot): its anchors that two documents have,
    and those of them that are met very often."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        low, row = _flat(part.column("anchors"))
        number = part.column("batch").to_numpy()[row]
        by = np.argsort(low, kind="stable")
        low, number = low[by], number[by]
        same = low[1:] == low[:-1]
        shared = np.append(same, False) | np.append(False, same)
        names, met = np.unique(low, return_counts=True)
        busy, times = _flat(part.column("busy"))[0], _flat(part.column("times"))[0]
        met = met + np.bincount(np.searchsorted(names, busy), times, len(names)).astype(np.int64)
        often = names[met >= hot]
        low, number = low[shared], number[shared]
        full = (int(key[0].as_py()) << kept_bits(bits)) | low
        is_hot = np.isin(low, often)
        by = np.lexsort((full, number))
        full, number, is_hot = full[by], number[by], is_hot[by]
        one = _starts(number, full)
        full, number, is_hot = full[one], number[one], is_hot[one]
        start = _starts(number)
        lists = _lists([full, is_hot.astype(np.int64)], start)
        return pa.table({"batch": pa.array(number[start]), "keys": lists[0], "hot": lists[1]})

    return run


def _copy_set(side: pa.Table) -> set[tuple[int, int]]:
    """(doc_id, text hash) of the copies named in a side table."""
    copies = side.filter(pc.equal(side.column("kind"), COPY))
    return set(zip(copies.column("doc_id").to_pylist(), copies.column("face").to_pylist()))


#: What a row of a side table is.
COPY, SPAN, MARKS, GONE, KEYS = range(5)
_LONGS = ("h", "doc", "face", "pos", "left", "right")
OCCURRENCES = "bucket long, batch long, " + ", ".join(f"{c} array<long>" for c in _LONGS) + ", around binary"


def window_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window from each start."""
    one = span_hash(prefix_hash(data), starts, starts + WINDOW)
    two = span_hash(prefix_hash(_OTHER[data]), starts, starts + WINDOW)
    return one.view(np.int64), mix(two).view(np.int64)


def windows_around(pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, start in its text) of every window that holds an anchor."""
    first, last = np.maximum(pos - SIDE, 0), np.minimum(pos, size - WINDOW)
    n = np.maximum(last - first + 1, 0)
    return np.repeat(np.arange(len(pos)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _least(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by class, where each class starts, and its smallest
    doc_id."""
    order = np.lexsort((doc, two, one))
    start = _starts(one[order], two[order])
    return order, start, doc[order[start]]


def _occurrences(bits: int, buckets: int):
    """One batch of texts and its shared anchors -> occurrences with the bytes
    around them by bucket; of hot anchors the distinct windows by bucket, and
    where they were, for the batch itself (bucket -1 - batch).  Copies of a
    smaller document are left out."""

    def run(key: tuple, docs: pa.Table, side: pa.Table) -> pa.Table:
        keys, known_hot = _flat(side.column("keys"))[0], _flat(side.column("hot"))[0]
        by = np.argsort(keys, kind="stable")
        keys, known_hot = keys[by].view(_U), known_hot[by].astype(bool)
        copies = _copy_set(side)
        if copies:
            own = [pair not in copies for pair in zip(docs.column("doc_id").to_pylist(), docs.column("face").to_pylist())]
            docs = docs.filter(pa.array(own, pa.bool_()))
        ids, faces = docs.column("doc_id").to_numpy(), docs.column("face").to_numpy()
        held: dict[int, list] = {}
        hot = []
        for first, _, data, offs in pieces(docs.column("text"), PART) if len(keys) else ():
            rows, at, h = anchors(data, offs)
            place, known = lookup(keys, h >> _U(64 - bits - kept_bits(bits)))
            busy = known & known_hot[place]
            size = np.diff(offs)
            if busy.any():
                row, start = rows[busy], (at - offs[rows])[busy]
                which, begin = windows_around(start, size[row])
                begin = np.unique(offs[row[which]] + begin)
                owner = first + np.searchsorted(offs, begin, "right") - 1
                hot.append((*window_hashes(data, begin), ids[owner], ids[first + row], faces[first + row], start))
            known &= ~busy
            rows, at, h = rows[known], at[known], h[known]
            left = np.minimum(at - offs[rows], SIDE)
            right = np.minimum(offs[rows + 1] - at - ANCHOR, SIDE)
            padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
            around = np.lib.stride_tricks.sliding_window_view(padded, 2 * SIDE + ANCHOR)[at]
            bucket = (mix(h) % _U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = by[edges[b] : edges[b + 1]]
                longs = (h[own].view(np.int64), ids[first + rows[own]], faces[first + rows[own]], (at - offs[rows])[own], left[own], right[own])
                held.setdefault(int(b), []).append((*longs, around[own]))
        out = []
        for b, parts in held.items():
            *longs, around = (np.concatenate(c) for c in zip(*parts))
            out.append((b, longs, around.tobytes()))
        number = key[0].as_py()
        if hot:
            one, two, doc = (np.concatenate(c) for c in list(zip(*hot))[:3])
            order, start, least = _least(one, two, doc)
            one, two = one[order[start]], two[order[start]]
            bucket = (mix(one.view(_U)) % _U(buckets)).astype(np.int64)
            for b in np.unique(bucket):
                own = bucket == b
                out.append((int(b), (one[own], least[own], two[own], *[np.zeros(0, np.int64)] * 3), None))
            marks = [np.concatenate(c) for c in list(zip(*hot))[3:]]
            out.append((-1 - number, (np.zeros(0, np.int64), *marks, *[np.zeros(0, np.int64)] * 2), None))
        lists = [pa.array([longs[i] for _, longs, _ in out], pa.list_(pa.int64())) for i in range(len(_LONGS))]
        return pa.table([pa.array([b for b, *_ in out], pa.int64()), pa.array([number] * len(out), pa.int64()), *lists, pa.array([a for *_, a in out], pa.binary())], names=["bucket", "batch", *_LONGS, "around"])

    return run


def radix_order(group: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Order by group, then by the byte rows ``digits``, most significant eight
    bytes first; a group of one is left alone from then on."""
    words = digits.view(">u8").astype(_U)
    order = np.argsort(group, kind="stable")
    current = group[order]
    for d in range(words.shape[1]):
        same = current[1:] == current[:-1]
        active = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(active):
            break
        rows = order[active]
        digit = words[rows, d]
        by = np.lexsort((digit, current[active]))
        order[active] = rows[by]
        # groups split where the digit changes; positions number them anew
        new = np.ones(len(order), bool)
        new[1:] = ~same
        digit, kept = digit[by], current[active]
        split = np.zeros(len(order), bool)
        split[active[1:]] = (digit[1:] != digit[:-1]) & (kept[1:] == kept[:-1])
        current = np.cumsum(new | split)
    return order


def _depths(group: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order, and the length of the common prefix of each row with the one
    before it (-1 at the start of a group)."""
    order = radix_order(group, digits)
    rows = digits[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), digits.shape[1])
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.append(-1, common)


def covered(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each occurrence the smallest and largest offset of the anchor in a
    window that a smaller document has too (first > last: none)."""
    n = len(key)
    group = np.unique(key, return_inverse=True)[1]
    # the anchor's own bytes join the right side, so hashes need not be trusted
    after = np.zeros((n, -(-(ANCHOR + SIDE) // 8) * 8), np.uint8)
    after[:, : ANCHOR + SIDE] = around[:, SIDE:]
    before = np.ascontiguousarray(around[:, :SIDE][:, ::-1])
    right_order, right_common = _depths(group, after)
    left_order, left_common = _depths(group, before)
    first, last = np.full(n, SIDE + 1), np.full(n, -1)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SIDE + 1):
        valid = (left >= o) & (right >= SIDE - o)
        if not valid.any():
            continue
        left_class[left_order] = np.cumsum(left_common < o)
        right_class[right_order] = np.cumsum(right_common < ANCHOR + SIDE - o)
        rows = np.flatnonzero(valid)
        pair = left_class[rows] * (n + 1) + right_class[rows]
        by = np.argsort(pair, kind="stable")
        pair = pair[by]
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        least = np.minimum.reduceat(doc[rows[by]], start)
        least = np.repeat(least, np.diff(np.append(start, len(rows))))
        gone = rows[by][least < doc[rows[by]]]
        first[gone] = np.minimum(first[gone], o)
        last[gone] = o
    return first, last


SIDES = "batch long, kind int, doc_id long, face long, start long, end long, a array<long>, b array<long>, c array<long>"


def _sides(n: int, kind: int, **columns) -> pa.Table:
    """Rows of a side table; columns that are not named are null."""
    given = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
    longs = pa.list_(pa.int64())
    types = {"batch": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "face": pa.int64(), "start": pa.int64(), "end": pa.int64(), "a": longs, "b": longs, "c": longs}
    return pa.table({c: pa.array(given[c], t) if c in given and not isinstance(given[c], pa.Array) else given.get(c, pa.nulls(n, t)) for c, t in types.items()})


def _removals(key: tuple, part: pa.Table) -> pa.Table:
    """One bucket -> byte spans to remove, and windows of hot anchors that have
    a smaller document in another batch; marks pass through to their batch."""
    if key[0].as_py() < 0:
        return _sides(len(part), MARKS, batch=part.column("batch").combine_chunks(), a=part.column("doc").combine_chunks(), b=part.column("face").combine_chunks(), c=part.column("pos").combine_chunks())
    plain = part.filter(pc.is_valid(part.column("around")))
    out = []
    if len(plain):
        h, doc, face, pos, left, right = (_flat(plain.column(c))[0] for c in _LONGS)
        around = np.frombuffer(b"".join(plain.column("around").to_pylist()), np.uint8).reshape(len(h), 2 * SIDE + ANCHOR)
        first, last = covered(h, doc, left, right, around)
        gone = first <= last
        out.append(_sides(int(gone.sum()), SPAN, doc_id=doc[gone], face=face[gone], start=(pos - last)[gone], end=(pos - first + WINDOW)[gone]))
    windows = part.filter(pc.is_null(part.column("around")))
    if len(windows):
        one, row = _flat(windows.column("h"))
        two, doc = _flat(windows.column("face"))[0], _flat(windows.column("doc"))[0]
        number = windows.column("batch").to_numpy()[row]
        order, start, least = _least(one, two, doc)
        least = np.repeat(least, np.diff(np.append(start, len(order))))
        lost = order[least < doc[order]]
        lost = lost[np.argsort(number[lost], kind="stable")]
        start = _starts(number[lost])
        a, b = _lists([one[lost], two[lost]], start)
        out.append(_sides(len(start), GONE, batch=number[lost][start], a=a, b=b))
    return pa.concat_tables(out) if out else _sides(0, SPAN)


def _runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans (touching spans are one run)."""
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist()))


def _hot_spans(docs: pa.Table, side: pa.Table) -> list[np.ndarray]:
    """(row of docs, start) of the windows of hot anchors that a smaller
    document has, in this batch or in another."""
    marks, gone = side.filter(pc.equal(side.column("kind"), MARKS)), side.filter(pc.equal(side.column("kind"), GONE))
    if not len(marks):
        return [np.zeros(0, np.int64)] * 2
    doc, face, pos = (_flat(marks.column(c))[0] for c in "abc")
    # one row for each document and text, whatever number of rows repeat it
    row_of: dict[tuple, int] = {}
    for row, pair in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("face").to_pylist())):
        row_of.setdefault(pair, row)
    row = np.array([row_of[pair] for pair in zip(doc.tolist(), face.tolist())], np.int64)
    by = np.lexsort((pos, row))
    row, pos = row[by], pos[by]
    chosen, local = np.unique(row, return_inverse=True)
    ids, text = docs.column("doc_id").to_numpy(zero_copy_only=False)[chosen].astype(np.int64), docs.column("text").take(pa.array(chosen))
    found = []
    for first, end, data, offs in pieces(text, PART):
        mine = slice(np.searchsorted(local, first), np.searchsorted(local, end))
        own = local[mine] - first
        which, begin = windows_around(pos[mine], np.diff(offs)[own])
        begin = np.unique(offs[own[which]] + begin)
        at = np.searchsorted(offs, begin, "right") - 1
        found.append((first + at, begin - offs[at], *window_hashes(data, begin)))
    text_row, start, one, two = (np.concatenate(c) for c in zip(*found))
    order, first, least = _least(one, two, ids[text_row])
    least = np.repeat(least, np.diff(np.append(first, len(order))))
    lost = np.zeros(len(order), bool)
    lost[order] = least < ids[text_row[order]]
    elsewhere = {*zip(_flat(gone.column("a"))[0].tolist(), _flat(gone.column("b"))[0].tolist())}
    if elsewhere:
        maybe = np.flatnonzero(np.isin(one, np.array([a for a, _ in elsewhere])))
        lost[maybe] |= [pair in elsewhere for pair in zip(one[maybe].tolist(), two[maybe].tolist())]
    return [chosen[text_row[lost]], start[lost]]


def _apply(keep_text: bool):
    def run(key: tuple, docs: pa.Table, side: pa.Table) -> pa.Table:
        copies = _copy_set(side)
        spans = side.filter(pc.equal(side.column("kind"), SPAN))
        ids, faces = docs.column("doc_id").to_pylist(), docs.column("face").to_pylist()
        hot_row, hot_start = _hot_spans(docs, side)
        hot_doc, hot_face = (np.array([of[r] for r in hot_row], np.int64) for of in (ids, faces))
        owner, face, start, end = (np.concatenate([spans.column(c).to_numpy(), more]) for c, more in (("doc_id", hot_doc), ("face", hot_face), ("start", hot_start), ("end", hot_start + WINDOW)))
        by = np.lexsort((face, owner))
        owner, face, start, end = owner[by], face[by], start[by], end[by]
        first = _starts(owner, face)
        of = {pair: (a, b) for *pair, a, b in zip(owner[first].tolist(), face[first].tolist(), first, np.append(first[1:], len(owner))) for pair in [tuple(pair)]}
        sizes, removed, counts, digests, kept = [], [], [], [], []
        row = 0
        for text in (t for chunk in docs.column("text").chunks for t in chunk):
            raw, pair = memoryview(text.as_buffer()), (ids[row], faces[row])
            n = len(raw)
            if pair in copies:
                runs = [(0, n)]
            elif pair in of:
                a, b = of[pair]
                runs = _runs(start[a:b], end[a:b])
            else:
                runs = []
            edges = [0, *(x for r in runs for x in r), n]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            sizes.append(n)
            removed.append(n - len(left))
            counts.append(len(runs))
            digests.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                kept.append(left)
            row += 1
        out = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if
    asked for) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = 1 + int(size) // BATCH
    bits = max(3, int(np.ceil(np.log2(1 + size / BUCKET))))
    buckets = max(8, int(size) // (2 * BATCH))
    batch = F.pmod(F.xxhash64("doc_id", "face"), F.lit(batches)).cast("long").alias("batch")
    dealt = docs.withColumn("face", F.xxhash64("text")).select("doc_id", "text", "face", batch)
    searched = dealt.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW))

    faces = searched.select("doc_id", "face", "batch", F.xxhash64(F.lit(9), "text").alias("face2"), F.octet_length("text").alias("n"))
    same = ["face", "face2", "n"]
    classes = faces.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    copies = spread_join(faces, classes, same, "doc_id").filter("doc_id > least").select("batch", F.lit(COPY).alias("kind"), "doc_id", "face").distinct()
    copies = cut(copies, "copies")

    hashed = searched.select("batch", "text").mapInArrow(_first_pass(bits), ANCHORS)
    shared = cut(hashed.groupBy("bucket").applyInArrow(_shared_anchors(bits, hot), "batch long, keys array<long>, hot array<long>"), "anchors")
    side = shared.withColumn("kind", F.lit(KEYS)).unionByName(copies, allowMissingColumns=True)
    found = searched.groupBy("batch").cogroup(side.groupBy("batch")).applyInArrow(_occurrences(bits, buckets), OCCURRENCES)
    spans = cut(found.groupBy("bucket").applyInArrow(_removals, SIDES), "spans")
    side = spans.withColumn("batch", F.when(F.col("kind") == SPAN, batch).otherwise(F.col("batch"))).unionByName(copies, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return dealt.groupBy("batch").cogroup(side.groupBy("batch")).applyInArrow(_apply(keep_text), schema)


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
