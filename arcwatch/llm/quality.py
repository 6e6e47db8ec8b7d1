"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad from features of itself and of both
neighbours; forward-backward marginals of "good", weighted by line length,
make the document's quality, which a logistic fitted on held-back documents
turns into a probability.

Lines have no labels of their own, so they are hidden: fitting takes their
expected labels under the field, given that a good document has a share of
``GOOD`` good lines at least and a bad one ``BAD`` at most (by length), and fits
the field to these expectations in ``ROUNDS`` rounds, by Adam.  A document of
mixed lines so teaches changes from good to bad.  All in one task, on a bounded
sample: per class the ``SAMPLE`` labelled documents of smallest hash, the
longest cut so that ``SAMPLE_BYTES`` of text hold them all, weighed back to the
share of each label.

Nulls: a null or empty text is one empty line and is scored as such.  Null
labels teach nothing.  With no label of a class every score is the share of
good labels.  Repeated rows are scored alike; equal texts of a class teach
once, and ties of the drawing hash go by doc_id.  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fitted, table
from .kernels import Words, lookup, pieces, prefix_hash, span_hash
from .toxicity import _logistic, by_class, label_share, labelled_sample

SAMPLE = 3000
SAMPLE_BYTES = 6 << 20
CALIBRATE = 3
COMMON = 512
STEPS, RATE, RIDGE = 100, 0.08, 1e-4
ROUNDS, BISECTIONS = 3, 8
#: Least share of good lines in a good document, and most in a bad one.
GOOD, BAD = 0.8, 0.4
THRESHOLD = 0.7

#: Byte classes whose share of a line is a feature.
_CLASSES = [
    np.isin(np.arange(256), list(chars))
    for chars in (range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"!?", b"|", b".", b",;:", b"-_=*#~+", b"@/\\<>{}[]()&%$^", b"\"'`")
]
FEATURES = len(_CLASSES) + 12


class Lines:
    """Feature rows of the lines of a piece, and where each text's lines start."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, common: np.ndarray):
        texts = len(offs) - 1
        breaks = np.flatnonzero(data == 10)
        owner = np.concatenate([np.arange(texts), np.searchsorted(offs, breaks, "right") - 1])
        start = np.concatenate([offs[:-1], breaks + 1])
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        last = np.append(owner[1:] != owner[:-1], True)
        end = np.where(last, offs[owner + 1], np.append(start[1:] - 1, 0))
        self.offs = np.searchsorted(owner, np.arange(texts + 1))
        self.size = (end - start).astype(float)

        def within(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            return (total[end] - total[start]).astype(float)

        size = np.maximum(self.size, 1)
        out = [within(of[data]) / size for of in _CLASSES]

        words = Words(data, offs)
        lo, hi = np.searchsorted(words.starts, start), np.searchsorted(words.starts, end)
        n = np.maximum(hi - lo, 1)
        line = np.repeat(np.arange(len(start)), hi - lo)

        def among(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            return (total[hi] - total[lo]) / n

        h = words.hash
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        by = np.lexsort((h, line))
        new = np.ones(len(h), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (line[by][1:] != line[by][:-1])
        distinct = np.zeros(len(h), bool)
        distinct[by] = new
        length = words.ends - words.starts
        mean = np.concatenate([[0], np.cumsum(length)])
        mean = (mean[hi] - mean[lo]) / n

        line_hash = span_hash(prefix_hash(data), start, end)
        by = np.lexsort((line_hash, owner))
        same = (line_hash[by][1:] == line_hash[by][:-1]) & (owner[by][1:] == owner[by][:-1])
        twin = np.zeros(len(start), bool)
        twin[by[1:]] |= same
        twin[by[:-1]] |= same
        final = np.where(end > start, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
        opening = np.where(end > start, data[np.minimum(start, max(len(data) - 1, 0))] if len(data) else 0, 0)
        out += [
            np.log1p(self.size), np.log1p(hi - lo), mean / 10, np.minimum(mean, 40) ** 2 / 100,
            among(again), among(distinct), among(lookup(common, h)[1]), among(length <= 2),
            twin.astype(float), np.isin(final, list(b".!?")).astype(float), (opening >= 65) & (opening <= 90), (end == start).astype(float),
        ]
        own = np.stack(out, 1).astype(np.float32)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        first = np.append(True, owner[1:] != owner[:-1])
        before[first], after[last] = 0, 0
        self.x = np.concatenate([own, before, after, first[:, None], last[:, None]], 1)


def _steps(offs: np.ndarray) -> list[np.ndarray]:
    """For each position the indexes of the lines there, longest texts first."""
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    starts, n = offs[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    return [starts[:a] + t for t, a in enumerate(active)]


def marginals(unary: np.ndarray, offs: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the summed pairwise marginals of each text
    as rows (from bad/good to bad/good).

    unary: score of good over bad; trans[i, j]: score of j after i.
    """
    lines = len(unary)
    score = np.zeros((lines, 2))
    score[:, 1] = unary
    forward, backward = np.zeros((lines, 2)), np.zeros((lines, 2))
    steps = _steps(offs)
    for t, at in enumerate(steps):
        if t == 0:
            forward[at] = score[at]
        else:
            f = forward[at - 1]
            forward[at] = score[at] + np.logaddexp(f[:, :1] + trans[0], f[:, 1:] + trans[1])
        forward[at] -= forward[at].max(1, keepdims=True)
    for t in range(len(steps) - 2, -1, -1):
        at = steps[t + 1] - 1
        b = backward[at + 1] + score[at + 1]
        backward[at] = np.logaddexp(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
        backward[at] -= backward[at].max(1, keepdims=True)
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if lines else np.zeros(0, np.int64)
    joint = forward[inner][:, :, None] + trans[None] + (backward + score)[inner + 1][:, None, :]
    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
    joint /= joint.sum((1, 2), keepdims=True)
    pairs = np.zeros((len(offs) - 1, 4))
    np.add.at(pairs, owner[inner], joint.reshape(-1, 4))
    return good, pairs


def _aggregate(good: np.ndarray, size: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text."""
    total = np.concatenate([[0], np.cumsum(good * (size + 1))])
    weight = np.concatenate([[0], np.cumsum(size + 1)])
    return (total[offs[1:]] - total[offs[:-1]]) / np.maximum(weight[offs[1:]] - weight[offs[:-1]], 1e-9)


def constrained(unary: np.ndarray, offs: np.ndarray, trans: np.ndarray, label: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of lines and pairs given the labels of documents: the good
    share of a good document is ``GOOD`` at least, that of a bad one ``BAD`` at
    most.  A document that breaks this gets one bias for all its lines, found by
    bisection, which keeps the differences between them."""
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    bound = np.where(label == 1, GOOD, BAD)
    good, pairs = marginals(unary, offs, trans)
    side = np.where(label == 1, 1.0, -1.0)
    broken = side * (_aggregate(good, size, offs) - bound) < 0
    low, high = np.zeros(len(label)), np.where(broken, 16.0, 0.0)
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        good, pairs = marginals(unary + (side * middle)[owner], offs, trans)
        short = side * (_aggregate(good, size, offs) - bound) < 0
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return good, pairs


def fit(x: np.ndarray, offs: np.ndarray, label: np.ndarray, weight: np.ndarray, size: np.ndarray) -> dict:
    """Weights and transitions by expectation and maximisation.

    The lines of a document start with its label and are read by themselves,
    without neighbours or transitions (which would make all lines of a document
    alike).  Each round then takes the expected labels and label pairs of
    lines, given the document's label, as what Adam fits the field to.
    """
    mean, std = x.mean(0), x.std(0) + 1e-3
    x = np.concatenate([(x - mean) / std, np.ones((len(x), 1))], 1)
    n = np.diff(offs)
    # a document is one witness however many lines it has
    share = weight / np.sqrt(n)
    share = share / share.sum()
    w = np.repeat(share, n)
    theta = np.zeros(x.shape[1] + 4)

    alone = np.append(np.arange(x.shape[1] - 1) < FEATURES, True)

    def maximise(line: np.ndarray, seen: np.ndarray | None, count: int) -> None:
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, count + 1):
            good, pairs = marginals(x @ theta[:-4], offs, theta[-4:].reshape(2, 2))
            grad = np.concatenate([x.T @ (w * (line - good)), share @ (pairs if seen is None else seen) - share @ pairs]) - RIDGE * theta
            if seen is None:
                grad[:-4] *= alone
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta[:] += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    maximise(np.repeat(label, n), None, STEPS)
    for _ in range(ROUNDS):
        line, seen = constrained(x @ theta[:-4], offs, theta[-4:].reshape(2, 2), label, size)
        maximise(line, seen, STEPS // 2)
    return {"mean": mean, "std": std, "theta": theta}


def _raw(lines: Lines, model: dict) -> np.ndarray:
    theta = model["theta"]
    unary = ((lines.x - model["mean"]) / model["std"]) @ theta[:-5] + theta[-5]
    good, _ = marginals(unary, lines.offs, theta[-4:].reshape(2, 2))
    return _aggregate(good, lines.size, lines.offs)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def build(sample: pa.Table, share: float) -> dict:
    """The model of a sample (label, draw, text)."""
    texts = by_class(sample)
    label = [np.full(len(t), c) for c, t in enumerate(texts)]
    if not all(len(t) for t in texts):
        return {"share": share}
    text, label = pa.concat_arrays(texts), np.concatenate(label)
    counted = [np.unique(Words(data, offs).hash, return_counts=True) for _, _, data, offs in pieces(texts[1])]
    keys, at = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    often = np.bincount(at, np.concatenate([c for _, c in counted]))
    common = np.sort(keys[np.lexsort((keys, -often))[:COMMON]])

    parts = [Lines(data, offs, common) for _, _, data, offs in pieces(text)]
    x, size = np.concatenate([p.x for p in parts]), np.concatenate([p.size for p in parts])
    n = np.concatenate([np.diff(p.offs) for p in parts])
    offs = np.concatenate([[0], np.cumsum(n)])
    weight = np.where(label == 1, share / (label == 1).sum(), (1 - share) / (label == 0).sum())
    held = np.arange(len(label)) % CALIBRATE == 0

    def subset(mask: np.ndarray) -> tuple:
        rows = np.repeat(mask, n)
        return x[rows], np.concatenate([[0], np.cumsum(n[mask])]), size[rows]

    own_x, own_offs, own_size = subset(~held)
    model = fit(own_x, own_offs, label[~held].astype(float), weight[~held], own_size)
    cal = Lines.__new__(Lines)
    cal.x, cal.offs, cal.size = subset(held)
    raw = _logit(_raw(cal, model))
    slope, intercept = _logistic(raw, label[held].astype(float))
    drawn = (label[held].sum() + 1) / (held.sum() + 2)
    intercept += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model | {"common": common, "slope": max(slope, 0.0), "intercept": float(intercept), "share": share}


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> dict:
    """The model, fitted in one task from the bounded sample."""
    share = label_share(labels, "quality", learn)
    return fitted(labelled_sample(docs, labels, "quality", learn, SAMPLE, SAMPLE_BYTES), lambda sample: build(sample, share))


def score_texts(column: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(column), model["share"])
    if "theta" in model:
        for first, end, data, offs in pieces(column):
            raw = _logit(_raw(Lines(data, offs, model["common"]), model))
            out[first:end] = 1 / (1 + np.exp(-(model["slope"] * raw + model["intercept"])))
    return out


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_texts(batch.column(1), shared.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_mod("doc_id", 4) != 2)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
