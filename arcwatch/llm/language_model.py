"""Language-model scoring with a log-bilinear neural model.

Words are counted over all training documents.  Every word is an outcome of a
log-bilinear model: the vectors of the two words before, each scaled by a
weight vector of its place, add up to a predicted vector.  The most frequent
words (``GROWTH`` times the square root of the training tokens, ``HEAD`` at
least) and the end of text have vectors of their own.  All others, words never
met in training among them, are dealt by hash into *kinds*, one to
``KIND`` words of the head, which have vectors as a word has, as outcomes and
as words before; a word has its smoothed share of the counts of its kind.
Head and kinds grow with the input, and every text has a proper probability:
each kind keeps the mass of one word never met.

Outcomes are split by frequency into classes, about as many as a class has
members.  The products of the predicted vector with the class vectors, plus
biases, are normalised over the classes, and those with the outcome vectors
over the members of the class; both together are the probability.

Fitting is noise-contrastive, in numpy, over all training documents: in each of
``ROUNDS`` rounds every task takes gradient steps over its share of the
documents from the same start, and what the tasks moved is averaged by tokens,
each row over the tasks that met it.

Counts never pass through the driver, but those of the head.  Documents are
dealt by hash into batches of about ``BATCH`` bytes; the distinct words of a
batch outside the head (at most one row a batch and word) are joined to the
counts and return to their batch, where texts are scored piece by piece.

Words are known by a 64-bit hash.  Nulls: a null text is empty, its only token
the end.  A null doc_id counts as a training row.  Repeated rows count and are
scored each; texts alike in words and count of words score alike.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, table
from .kernels import Words, lookup, mix, pieces

HEAD = 1022
GROWTH = 4
KIND = 64
WIDTH = 16
NOISE = 64
CLASS_NOISE = 32
BATCH = 16 << 20
ROUNDS = 2
STEP = 4096
RATE = 0.1

#: Bytes of text scored at once.
PART = 1 << 20
#: Rows of a parameter that are averaged at once.
ROWS = 2048
#: Scores above this would overflow the exponential of a single-precision number.
LARGEST = np.float32(80)
#: Distinct words of a batch that are held while counting.
HELD = 1_000_000

_U = np.uint64


# -- counting ---------------------------------------------------------------


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, train, text) -> (batch, word, n): distinct words of a batch and
    their tokens in training documents."""
    held: dict[int, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for number, parts in held.items():
            keys, counts = _merge(parts)
            for at in range(0, len(keys), 1 << 17):
                k = keys[at : at + (1 << 17)]
                yield pa.record_batch([pa.array(np.full(len(k), number)), pa.array(k.view(np.int64)), pa.array(counts[at : at + (1 << 17)])], names=["batch", "word", "n"])
        held.clear()

    for batch in batches:
        number, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for b in np.unique(number):
            rows = np.flatnonzero(number == b)
            for first, end, data, offs in pieces(batch.column(2).take(pa.array(rows))):
                words = Words(data, offs)
                learn = np.repeat(train[rows[first:end]], np.diff(words.offs))
                keys, at = np.unique(words.hash, return_inverse=True)
                held.setdefault(int(b), []).append((keys, np.bincount(at, learn, len(keys))))
                size += len(keys)
        if size > HELD:
            for b, parts in held.items():
                held[b] = [_merge(parts)]
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > HELD // 2:
                yield from flush()
                size = 0
    yield from flush()


# -- the model --------------------------------------------------------------


def head_size(tokens: int) -> int:
    """How many words get vectors of their own, of so many training tokens."""
    return max(HEAD, int(GROWTH * tokens**0.5))


def kinds_of(head: int) -> int:
    """Kinds of the words outside a head of this size."""
    return max(1, head // KIND)


def kind_of(words: np.ndarray, kinds: int) -> np.ndarray:
    return (mix(words + _U(29)) % _U(kinds)).astype(np.int64)


def class_size(outcomes: int) -> int:
    """Members of a frequency class (outcome i is in class i // size)."""
    return int(np.ceil(outcomes**0.5))


def outcomes(words: Words, head: np.ndarray, order: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outcome, word before, word before that, and index of the word (-1: end)
    of every token of a piece, the end of each text included.

    After the words of the head come the end, the kinds of other words and, as
    a word before only, the start."""
    end, other, start = len(head), len(head) + 1, len(head) + 1 + kinds
    texts = len(words.offs) - 1
    total = len(words.hash) + texts
    ends = words.offs[1:] + np.arange(texts)
    is_word = np.ones(total, bool)
    is_word[ends] = False
    at, known = lookup(head, words.hash)
    out = np.full(total, end, np.int64)
    out[is_word] = np.where(known, order[at] if len(order) else 0, other + kind_of(words.hash, kinds))
    place = np.full(total, -1, np.int64)
    place[is_word] = np.arange(len(words.hash))
    one, two = np.full(total, start, np.int64), np.full(total, start, np.int64)
    one[1:], two[2:] = out[:-1], out[:-2]
    starts = np.concatenate([[0], ends[:-1] + 1])
    one[starts] = start
    two[starts] = start
    second = starts + 1
    two[second[second < total]] = start
    return out, one, two, place


def start_model(unigram: np.ndarray, kinds: int = 0) -> dict:
    rng = np.random.default_rng(11)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    size = len(unigram)
    classes = np.add.reduceat(unigram, np.arange(0, size, class_size(size)))
    r, t = draw(size + 1, WIDTH), draw(size, WIDTH)
    # a kind says nothing until it has learnt something
    r[size - kinds : size] = t[size - kinds :] = 0
    return {
        "r": r, "t": t, "b": np.log(unigram).astype(np.float32),
        "u": draw(len(classes), WIDTH), "d": np.log(classes).astype(np.float32),
        "c1": np.ones(WIDTH, np.float32), "c2": np.full(WIDTH, 0.5, np.float32),
    }


def _scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, and the sums of the value rows of each."""
    # rows and places sorted as one number: a stable order at the speed of np.sort
    bits = len(rows).bit_length()
    both = np.sort((rows << bits) | np.arange(len(rows)))
    order, rows = both & ((1 << bits) - 1), both >> bits
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values.take(order, 0), first, axis=0)


class Trainer:
    """Noise-contrastive steps with AdaGrad; the noise words of a step are
    shared by its tokens."""

    def __init__(self, model: dict, unigram: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in model.items()}
        self.g = {k: np.full_like(v, 1e-2) for k, v in model.items()}
        self.met = {k: np.zeros(len(v), bool) for k, v in model.items()}
        self.span = class_size(len(unigram))
        classes = np.add.reduceat(unigram, np.arange(0, len(unigram), self.span))
        self.noise = {k: (n, np.log(share * n).astype(np.float32), np.cumsum(share)) for k, n, share in (("t", NOISE, unigram), ("u", CLASS_NOISE, classes))}
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def contrast(self, q: np.ndarray, target: np.ndarray, vectors: str, bias: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Gradients by q, and by the rows of the vectors and their biases."""
        p, (size, log_noise, cdf) = self.p, self.noise[vectors]
        noise = np.minimum(np.searchsorted(cdf, self.rng.random(size) * cdf[-1]), len(cdf) - 1)
        t, away = p[vectors].take(target, 0), p[vectors][noise]
        hit = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, t) + p[bias][target] - log_noise[target])))
        # the logistic of q . noise + bias - log of the noise's rate, in place;
        # a column of ones takes the biases along in the products
        wide = np.concatenate([q, np.ones((len(q), 1), np.float32)], 1)
        miss = wide @ np.concatenate([-away, (log_noise[noise] - p[bias][noise])[:, None]], 1).T
        with np.errstate(over="ignore"):
            np.exp(miss, out=miss)
        miss += 1
        e_hit, e_miss = (1 - hit)[:, None], np.divide(np.float32(-1), miss, out=miss)
        rows = np.concatenate([target, noise])
        by_row = np.concatenate([e_hit * wide, e_miss.T @ wide])
        return e_hit * t + e_miss @ away, _scatter(rows, by_row)

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(target)
        r1, r2 = p["r"].take(one, 0), p["r"].take(two, 0)
        q = r1 * p["c1"] + r2 * p["c2"]
        dq, (words, grad_t) = self.contrast(q, target, "t", "b")
        dq_class, (classes, grad_u) = self.contrast(q, target // self.span, "u", "d")
        dq = dq + dq_class
        every = np.arange(WIDTH)
        grad = {
            "r": _scatter(np.concatenate([one, two]), np.concatenate([dq * p["c1"], dq * p["c2"]])),
            "t": (words, grad_t[:, :-1]), "b": (words, grad_t[:, -1]), "u": (classes, grad_u[:, :-1]), "d": (classes, grad_u[:, -1]),
            "c1": (every, (dq * r1).sum(0)), "c2": (every, (dq * r2).sum(0)),
        }
        for k, (rows, g) in grad.items():
            g = g * np.float32(64 / n)
            held = self.g[k].take(rows, 0) + g * g
            self.g[k][rows] = held
            p[k][rows] += RATE * g / np.sqrt(held)
            self.met[k][rows] = True
        self.tokens += n


def _train(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, order, kinds, unigram, model = shared.value
        trainer = Trainer(model, unigram, seed)
        for batch in batches:
            for _, _, data, offs in pieces(batch.column(0)):
                out, one, two, _ = outcomes(Words(data, offs), head, order, kinds)
                for at in range(0, len(out), STEP):
                    trainer.step(out[at : at + STEP], one[at : at + STEP], two[at : at + STEP])
        for name, met in trainer.met.items():
            for at in range(0, len(met), ROWS):
                rows = np.flatnonzero(met[at : at + ROWS])
                if len(rows):
                    moved = (trainer.p[name][at + rows] - model[name][at + rows]).astype(np.float16)
                    yield pa.record_batch([pa.array([name]), pa.array([at]), pa.array([trainer.tokens]), pa.array([rows.astype(np.int16).tobytes()]), pa.array([moved.tobytes()])], names=["name", "at", "tokens", "rows", "moved"])

    return run


def _average(key: tuple, part: pa.Table) -> pa.Table:
    """Mean move of a block of rows, each weighed by the tokens of its tasks."""
    sums = weights = None
    for tokens, rows, moved in zip(*(part.column(c) for c in ("tokens", "rows", "moved"))):
        rows = np.frombuffer(rows.as_py(), np.int16)
        moved = np.frombuffer(moved.as_py(), np.float16).reshape(len(rows), -1).astype(np.float64)
        if sums is None:
            sums, weights = np.zeros((ROWS, moved.shape[1])), np.zeros((ROWS, 1))
        sums[rows] += moved * tokens.as_py()
        weights[rows] += tokens.as_py()
    mean = (sums / np.maximum(weights, 1)).astype(np.float32)
    return pa.table({"name": [key[0].as_py()], "at": [key[1].as_py()], "mean": pa.array([mean.tobytes()], pa.binary())})


def fit(texts: DataFrame, head: np.ndarray, order: np.ndarray, kinds: int, unigram: np.ndarray) -> dict:
    """Averaged parameters after ``ROUNDS`` rounds over texts (text, round)."""
    model = start_model(unigram, kinds)
    for number in range(ROUNDS):
        shared = texts.sparkSession.sparkContext.broadcast((head, order, kinds, unigram, model))
        local = texts.filter(F.col("round") == number).select("text").mapInArrow(_train(shared, number), "name string, at long, tokens long, rows binary, moved binary")
        mean = local.groupBy("name", "at").applyInArrow(_average, "name string, at long, mean binary").toArrow()
        model = {name: old.copy() for name, old in model.items()}
        for name, at, block in zip(*(mean.column(c) for c in ("name", "at", "mean"))):
            rows = model[name.as_py()][at.as_py() : at.as_py() + ROWS]
            rows += np.frombuffer(block.as_buffer(), np.float32).reshape(ROWS, -1)[: len(rows)].reshape(rows.shape)
        shared.unpersist()
    return model


def _log_sums(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over the vectors of exp(q . vector + bias)."""
    out = np.empty(len(q), np.float32)
    wide = np.concatenate([vectors, bias[:, None]], 1).T
    ones = np.ones(len(vectors), np.float32)
    # no product is above the lengths' product, so most need no limit
    length = lambda rows: np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0))
    low = length(q) * length(vectors) + bias.max(initial=0) <= LARGEST
    for s in range(0, len(q), 1024):
        part = q[s : s + 1024]
        score = np.concatenate([part, np.ones((len(part), 1), np.float32)], 1) @ wide
        if not low:
            np.minimum(score, LARGEST, out=score)
        out[s : s + 1024] = np.log(np.exp(score, out=score) @ ones)
    return out


def log_probability(target: np.ndarray, one: np.ndarray, two: np.ndarray, model: dict) -> np.ndarray:
    """Normalised natural log-probabilities; contexts that recur are done once."""
    size, span, classes = len(model["r"]), class_size(len(model["t"])), len(model["u"])
    key, at = np.unique(one * size + two, return_inverse=True)
    before = key // size
    q = model["r"].take(before, 0) * model["c1"] + model["r"].take(key - before * size, 0) * model["c2"]
    chosen = target // span
    # each class is normalised over its members for the contexts that need it
    pair, pair_at = np.unique(chosen * len(key) + at, return_inverse=True)
    edges = np.searchsorted(pair, np.arange(classes + 1) * len(key))
    within = np.empty(len(pair), np.float32)
    for c in np.flatnonzero(np.diff(edges)):
        mine, members = slice(edges[c], edges[c + 1]), slice(c * span, (c + 1) * span)
        within[mine] = _log_sums(q.take(pair[mine] - c * len(key), 0), model["t"][members], model["b"][members])
    out = model["b"][target] + model["d"][chosen] - within[pair_at] - _log_sums(q, model["u"], model["d"])[at]
    for s in range(0, len(at), 1 << 16):
        part = slice(s, s + (1 << 16))
        out[part] += np.einsum("ij,ij->i", q.take(at[part], 0), model["t"].take(target[part], 0) + model["u"].take(chosen[part], 0))
    return out


def _score(shared):
    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        head, order, often, model, n, v, ends, n_kind, v_kind = shared.value
        words = counts.column("word").to_numpy().view(_U)
        # a batch whose words were counted in parts names some of them again
        words, by = np.unique(words, return_index=True)
        count = counts.column("c").to_numpy()[by]
        kinds, other = len(n_kind), len(head) + 1
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for _, _, data, offs in pieces(docs.column("text"), PART):
            w = Words(data, offs)
            at, known = lookup(words, w.hash)
            c_word = np.where(known, count[at] if len(count) else 0, 0).astype(float)
            out, one, two, place = outcomes(w, head, order, kinds)
            c = np.where(place < 0, float(ends), c_word[place] if len(c_word) else 0.0)
            own = out < other - 1
            c[own] = often[out[own]]
            log_p = log_probability(out, one, two, model) / np.log(10)
            rare = np.flatnonzero(out >= other)
            kind = out[rare] - other
            log_p[rare] += np.log10((c[rare] + 0.1) / (n_kind[kind] + 0.1 * (v_kind[kind] + 1)))
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            lengths = np.diff(w.offs) + 1
            first = np.cumsum(lengths) - lengths
            parts.append((lengths, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(log_p.astype(float), first)))
        n_tokens, n_known, base_score, score = map(np.concatenate, zip(*parts))
        train = np.full(len(docs), n)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": train, "base_score": base_score, "score": score})

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row of docs; rows whose crc32(doc_id) is 0 modulo 10 are held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_mod("doc_id", 10) == 0).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    batches = 1 + int(size[0] or 0) // BATCH
    ends = int(size[1] or 0)
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.left("text", F.lit(64))), F.lit(batches)))

    used = dealt.select("batch", (~F.col("held_out")).alias("train"), "text").repartition(batches, "batch").mapInArrow(_count, "batch long, word long, n long")
    used = cut(used, "words")
    counts = cut(used.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    sums = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = int(sums[0] or 0) + ends, int(sums[1]) + (ends > 0)

    frequent = cut(counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(head_size(n)), "head")
    top = frequent.orderBy(F.desc("c"), "word").toArrow()
    words, often = top.column("word").to_numpy().view(_U), top.column("c").to_numpy()
    order = np.argsort(words)
    kinds = kinds_of(len(words))
    rare = counts.join(F.broadcast(frequent.select("word")), "word", "left_anti")
    n_kind, v_kind = _by_kind(rare, kinds)
    unigram = np.concatenate([often, [ends], n_kind]) + 0.5
    unigram /= unigram.sum()
    learn = docs.filter(~F.col("held_out")).select("text", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(ROUNDS)).alias("round"))
    model = fit(learn, words[order], order, kinds, unigram)

    shared = spark.sparkContext.broadcast((words[order], order, often, model, n, v, ends, n_kind, v_kind))
    wanted = used.select("batch", "word").join(rare, "word").select("batch", "word", "c").toDF("batch", "word", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(_score(shared), schema)


def _by_kind(rare: DataFrame, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words in training of each kind of other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
        for batch in batches:
            c = batch.column(1).to_numpy()
            kind = kind_of(batch.column(0).to_numpy().view(_U), kinds)
            n += np.bincount(kind, c, kinds).astype(np.int64)
            v += np.bincount(kind, c > 0, kinds).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(kinds)), pa.array(n), pa.array(v)], names=["kind", "n", "v"])

    sums = rare.mapInArrow(run, "kind long, n long, v long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow().sort_by("kind")
    return (sums.column("n").to_numpy(), sums.column("v").to_numpy()) if len(sums) else (np.zeros(kinds, np.int64), np.zeros(kinds, np.int64))


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
