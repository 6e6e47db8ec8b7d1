"""Array kernels shared by the text operators.

Every function takes one *piece* of an Arrow string column: the UTF-8 bytes of
some consecutive whole texts (``data``) and their boundaries (``offs``, one
more than texts).  Nothing here makes a Python object per word, so the cost is
a few nanoseconds a byte, and memory is bounded by the piece (about a
megabyte, or the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
PIECE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: True for the six bytes that end a word: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for every ASCII byte that is neither letter nor digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: ASCII A-Z to a-z, everything else as it is.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.full(size, base, _U)
            out[0] = 1
            _powers[name] = np.cumprod(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-shift rounds)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offs) over whole texts; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off_buf, data_buf = column.buffers()
    offs = np.frombuffer(off_buf, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` reads any substring's hash from them."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _power(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a piece, ASCII letters lower-cased.

    starts/ends: byte positions; hash: 64 bits each; offs: word boundaries of
    the texts.  ``between`` marks the bytes that separate words.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE):
        self.data = _LOWER[data]
        solid = np.zeros(len(data) + 1, bool)
        solid[:-1] = ~between[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = offs[1:-1][offs[1:-1] < len(data)]
        begin[inner] = solid[inner]
        self.starts = np.flatnonzero(begin)
        # a word ends at the next space, the next text or the end
        stop = ~solid
        stop[offs] = True
        stops = np.flatnonzero(stop)
        self.ends = stops[np.searchsorted(stops, self.starts, "right")] if len(self.starts) else self.starts
        self.hash = span_hash(prefix_hash(self.data), self.starts, self.ends)
        self.offs = np.searchsorted(self.starts, offs)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and their boundaries.

    A text with fewer words (but any) has its whole sequence as one shingle.
    """
    h, offs = words.hash, words.offs
    n = np.diff(offs)
    weights = [_U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    many = np.maximum(n - k + 1, 0)
    counts = np.where((n > 0) & (n < k), 1, many)
    out_offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(out_offs[-1]), _U)
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, _U)
        for i, w in enumerate(weights):
            full += h[i : len(h) - k + 1 + i] * w
        keep = np.zeros(len(full) + 1, np.int64)
        at = np.flatnonzero(many > 0)
        if len(at):
            np.add.at(keep, offs[at], 1)
            np.add.at(keep, offs[at] + many[at], -1)
            whole = np.cumsum(keep[:-1]) > 0
            put = np.ones(len(out), bool)
            put[out_offs[:-1][(n > 0) & (n < k)]] = False
            out[put] = mix(full[whole] + _U(k))
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = h[offs[d] : offs[d + 1]]
        out[out_offs[d]] = mix(np.sum(own * np.array(weights[: len(own)], _U), keepdims=True) + _U(n[d]))[0]
    return out, out_offs


def lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return at, table[at] == values
