"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, spell every word letter by
letter: a letter is predicted from all letters before it in the word (``DEPTH``
at most).  Counts are of documents, so that one long text is one witness.  Both
models discount their counts by n1 / (n1 + 2 n2) of their own and back off to
one model that both share.  That is interpolated Kneser-Ney over both classes:
documents of either class in the whole context, then, letter by letter shorter,
in how many distinct longer contexts a letter followed, down to single letters.
``STRENGTH`` is how many documents the shared model counts for in every context:
where a class has met a beginning rarely, both say nearly the same, and a rare
inflection of a frequent stem is read through the stem.

A text's evidence is the difference of its log-likelihoods under the two, over
its words.  One insult in a long text would drown in that, so the evidence of
single words is a second feature: every word counts by the softplus of its own
difference less a margin (so that many small differences of ordinary words don't
add up to an insult), and the sum is divided by the square root of the number of
words, as its noise grows.  The margin is chosen, and the logistic that makes a
probability of both features is fitted, on rows held back from the models; its
intercept is moved to the share of toxic labels.

The models are fitted in one task on a bounded sample of labelled rows: per
class the ``SAMPLE`` documents of smallest hash, one in ``CALIBRATE`` of them
held back.  Each of them teaches: where their text exceeds ``SAMPLE_BYTES``, the
longest give their first bytes only.  Scoring covers every whole text.

Nulls: null and empty texts score as texts without evidence.  Null labels and
labels without a document teach nothing.  A repeated doc_id teaches once per
row, equal texts of a class once.  Ties of the drawing hash go by doc_id.  With
no label of a class, every score is the share of toxic labels.  Other columns
are ignored in scoring and kept in filtering.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, first_bytes, fitted, table
from .kernels import PUNCTUATION, Words, lookup, pieces, prefix_hash, span_hash

SAMPLE = 4000
SAMPLE_BYTES = 6 << 20
CALIBRATE = 3
DEPTH = 16
STRENGTH = 20.0
MARGINS = (1.5, 2.0, 2.5, 3.0)
#: How sharply the softplus bends at the margin.
SHARPNESS = 4.0
THRESHOLD = 0.5

#: Marks around a word, bytes that no word holds.
_START, _END = 2, 3


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words, each between a start and an end mark, and where
    each word starts."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n + 2)])
    letters = np.full(at[-1], _END, np.uint8)
    letters[at[:-1]] = _START
    word = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    letters[at[word] + 1 + k] = data[starts[word] + k]
    return letters, at


def steps(letters: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter after a start mark: its word, and the hashes of the
    letters up to and with it, and up to it."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pos = np.flatnonzero(np.arange(len(letters)) != at[word])
    begin = np.maximum(at[word[pos]], pos - depth + 1)
    prefix = prefix_hash(letters)
    return word[pos], span_hash(prefix, begin, pos + 1), span_hash(prefix, begin, pos)


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts; a half where there are none."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


class Counts:
    """Counts of what follows each context, aligned with the distinct grams."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, weight: np.ndarray):
        """weight: one row of weights of the occurrences for each class."""
        self.grams, first, own = np.unique(gram, return_index=True, return_inverse=True)
        self.first = first
        self.n = np.stack([np.bincount(own, w, len(self.grams)) for w in weight])
        self.contexts, self.of = np.unique(context[first], return_inverse=True)
        self.total = np.stack([np.bincount(self.of, n, len(self.contexts)) for n in self.n])

    def discounted(self, strength: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Of each class: the probability that counts give each gram, and the
        weight of the backoff in each context."""
        d = [discount(n[n > 0]) for n in self.n]
        total = np.maximum(self.total, 1e-9) + strength
        own = np.stack([np.maximum(n - x, 0) for n, x in zip(self.n, d)]) / total[:, self.of]
        spare = np.stack([np.bincount(self.of, np.minimum(n, x), len(self.contexts)) for n, x in zip(self.n, d)])
        return own, np.where(self.total + strength > 0, (strength + spare) / total, 1.0)


def continuation(letters: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For every letter of ``steps`` the probability that the shared model gives
    it one letter short of its whole context.

    Interpolated Kneser-Ney from single letters up: a context of L letters counts
    in how many distinct longer contexts a letter followed it, less a discount of
    its order, and hands the rest to L - 1 letters; below single letters all
    bytes are alike.
    """
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pos = np.flatnonzero(np.arange(len(letters)) != at[word])
    whole = pos - np.maximum(at[word[pos]], pos - depth + 1)
    prefix = prefix_hash(letters)
    p = np.full(len(pos), 1 / 256)
    for length in range(depth - 1):
        # contexts of this length that have a longer one
        on = np.flatnonzero(whole > length)
        if not len(on):
            break
        here = pos[on]
        gram, context = span_hash(prefix, here - length, here + 1), span_hash(prefix, here - length, here)
        _, first = np.unique(span_hash(prefix, here - length - 1, here + 1), return_index=True)
        counts = Counts(gram[first], context[first], np.ones((1, len(first))))
        own, spare = counts.discounted()
        place = np.searchsorted(counts.grams, gram)
        p[on] = own[0][place] + spare[0][counts.of[place]] * p[on]
    return p


def probabilities(letters: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[Counts, np.ndarray, np.ndarray]:
    """Probabilities of the grams met in words, and backoff weights of the
    contexts, under both classes; docs: documents of each class with each word."""
    word, gram, context = steps(letters, at, DEPTH)
    pooled = Counts(gram, context, docs.sum(0, keepdims=True)[:, word])
    own, spare = pooled.discounted()
    shared = own[0] + spare[0][pooled.of] * continuation(letters, at, DEPTH)[pooled.first]
    classes = Counts(gram, context, docs[:, word])
    own, spare = classes.discounted(STRENGTH)
    return classes, own + spare[:, classes.of] * shared, spare


def fit(letters: np.ndarray, at: np.ndarray, docs: np.ndarray) -> dict:
    """Tables of log-likelihood differences, toxic less ordinary."""
    counts, p, spare = probabilities(letters, at, docs)
    differ = lambda x: (np.log(x[1]) - np.log(x[0])).astype(np.float32)
    return {"grams": counts.grams, "gram_ratio": differ(p), "contexts": counts.contexts, "context_ratio": differ(spare)}


def evidence(words: Words, model: dict) -> np.ndarray:
    """The log-likelihood difference of every word of a piece."""
    _, first, own = np.unique(words.hash, return_index=True, return_inverse=True)
    letters, at = spelling(words.data, words.starts[first], words.ends[first])
    word, gram, context = steps(letters, at, DEPTH)
    ratio = np.zeros(len(gram), np.float32)
    place, known = lookup(model["grams"], gram)
    ratio[known] = model["gram_ratio"][place[known]]
    # a letter that neither class has met there: both give the shared backoff
    new = np.flatnonzero(~known)
    place, known = lookup(model["contexts"], context[new])
    ratio[new[known]] = model["context_ratio"][place[known]]
    return np.bincount(word, ratio, len(first))[own]


def _features(words: Words, model: dict) -> np.ndarray:
    """Of each text the difference of its log-likelihoods over its words, and
    for each margin the softplus of its words' evidence above it, summed and
    divided by the square root of the number of words."""
    found = evidence(words, model)
    bent = [np.logaddexp(0, SHARPNESS * (found - m)) / SHARPNESS for m in MARGINS]
    total = np.concatenate([np.zeros((1, 1 + len(bent))), np.cumsum(np.stack([found, *bent], 1), 0)])
    n = np.maximum(np.diff(words.offs), 1)[:, None]
    sums = total[words.offs[1:]] - total[words.offs[:-1]]
    return np.concatenate([sums[:, :1] / n, sums[:, 1:] / np.sqrt(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the columns of x and the intercept, by Newton steps with a
    little ridge."""
    x = x[:, None] if x.ndim == 1 else x
    design = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w[:-1] + w[-1]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int = SAMPLE, size: int = SAMPLE_BYTES) -> DataFrame:
    """(label, draw, text) of at most per_class labelled rows and size bytes of
    text of each class, in the order of a hash of doc_id.

    The ids are drawn from the labels, a table of ids, so drawing scans no
    text; then they are met with documents by a bounded broadcast.  No row is
    left out for its length: if a class has more bytes, all its texts are cut
    to one length, the largest that fits, and shorter ones stay whole.
    """
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    drawn = [known.filter(F.col(column) == c).select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("label"), F.xxhash64("doc_id").alias("draw")).orderBy("draw", "_id").limit(per_class) for c in (0, 1)]
    ids = drawn[0].union(drawn[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = docs.select("doc_id", text).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("label", "draw", "text")
    # the window is over lengths, of rows whose number is bounded above
    by_length = Window.partitionBy("label").orderBy("n")
    shares = found.select("label", F.octet_length("text").cast("long").alias("n")).withColumn("at", F.row_number().over(by_length))
    shares = shares.withColumn("before", F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("rows", F.count("*").over(Window.partitionBy("label")))
    fair = F.greatest(F.lit(1), F.floor((F.lit(size) - F.col("before")) / (F.col("rows") - F.col("at") + 1)))
    # the first text over its fair share of what shorter ones leave sets the length
    most = {row["label"]: row["most"] for row in shares.groupBy("label").agg(F.max(F.when(F.col("n") > fair, fair)).alias("most")).collect()}
    for label in {0, 1} - most.keys():
        warnings.warn(f"no labelled text has {column} = {label}: every score will be the share of labels", stacklevel=2)
    limit = F.when(F.col("label") == 1, F.lit(most.get(1))).otherwise(F.lit(most.get(0))).cast("int")
    return found.withColumn("text", F.coalesce(first_bytes(F.col("text"), limit), F.col("text")))


def label_share(labels: DataFrame, column: str, learn: Column) -> float:
    """Share of label 1 among the rows to learn from, smoothed."""
    sums = labels.filter(F.col(column).isin(0, 1) & learn).agg(F.sum(column), F.count("*")).first()
    return (float(sums[0] or 0) + 1) / (float(sums[1]) + 2)


def by_class(sample: pa.Table) -> list[pa.Array]:
    """The distinct texts of each class, in drawing order: copies are one witness."""
    sample = sample.sort_by([("draw", "ascending"), ("text", "ascending")])
    return [sample.filter(pa.compute.equal(sample.column("label"), c)).column("text").unique().cast(pa.large_string()) for c in (0, 1)]


def _vocabulary(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the distinct words of the texts of both classes, where each
    word starts, and the documents of each class that have it."""
    hashes, docs, letters, ends = [np.zeros(0, np.uint64)], [np.zeros((2, 0))], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    size = 0
    for label, text in enumerate(texts):
        for _, _, data, offs in pieces(text):
            words = Words(data, offs, PUNCTUATION)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(words.offs))
            by = np.lexsort((doc, words.hash))
            new = np.append(True, (words.hash[by][1:] != words.hash[by][:-1]) | (doc[by][1:] != doc[by][:-1]))[: len(by)]
            found, first, n = np.unique(words.hash[by][new], return_index=True, return_counts=True)
            one = by[new][first]
            own, at = spelling(words.data, words.starts[one], words.ends[one])
            hashes.append(found)
            docs.append(np.stack([n * (label == c) for c in (0, 1)]))
            letters.append(own)
            ends.append(size + at[1:])
            size += len(own)
    letters, ends, hashes, docs = np.concatenate(letters), np.concatenate(ends), np.concatenate(hashes), np.concatenate(docs, 1)
    starts = np.append(0, ends[:-1])[: len(ends)]
    _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
    letters, at = spelling(letters, starts[first] + 1, ends[first] - 1)
    return letters, at, np.stack([np.bincount(own, d, len(first)) for d in docs])


def build(sample: pa.Table, share: float) -> dict:
    """The model of a sample (label, draw, text)."""
    texts = by_class(sample)
    held = [text.take(pa.array(np.arange(0, len(text), CALIBRATE))) for text in texts]
    texts = [text.filter(pa.array(np.arange(len(text)) % CALIBRATE > 0)) for text in texts]
    letters, at, docs = _vocabulary(texts)
    if not docs.any(1).all():
        return {"share": share}
    model = fit(letters, at, docs)
    found, labels = [], []
    for label, text in enumerate(held):
        for _, _, data, offs in pieces(text):
            found.append(_features(Words(data, offs, PUNCTUATION), model))
            labels.append(np.full(len(offs) - 1, float(label)))
    x, y = np.concatenate(found), np.concatenate(labels)
    fits = {k: _logistic(x[:, [0, k]], y) for k in range(1, len(MARGINS) + 1)}
    margin = min(fits, key=lambda k: _loss(x[:, [0, k]], y, fits[k]))
    weights = fits[margin]
    drawn = (y.sum() + 1) / (len(y) + 2)
    weights[-1] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model | {"margin": margin, "weights": weights, "share": share}


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> dict:
    """The model, fitted in one task from the bounded sample."""
    share = label_share(labels, "toxic", learn)
    return fitted(labelled_sample(docs, labels, "toxic", learn), lambda sample: build(sample, share))


def score_texts(column: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(column), model["share"])
    if "weights" in model:
        *slopes, intercept = model["weights"]
        for first, end, data, offs in pieces(column):
            x = _features(Words(data, offs, PUNCTUATION), model)[:, [0, model["margin"]]]
            out[first:end] = 1 / (1 + np.exp(-np.clip(x @ slopes + intercept, -700, 700)))
    return out


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_texts(batch.column(1), shared.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_mod("doc_id", 5) != 0)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
