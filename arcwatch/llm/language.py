"""Language identification by string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence
vectors: which n-grams of one to ``N`` bytes occur at all, hashed to ``BINS``
places, ASCII letters lower-cased and runs of other ASCII bytes read as one
space.  A Nystroem map over ``LANDMARKS`` texts and one-versus-rest kernel
ridge regression give one weight column a language, so scoring is two matrix
products a batch: texts by landmarks, and by weights.

Fitted on a bounded sample: about ``SAMPLE`` rows with a language in all, as
many of each language but ``LEAST`` at least (all, if it has fewer), drawn by a
hash threshold from their counts (no sort, no gathering).  Texts of more than
``TEXT_BYTES`` teach by their first bytes.  Every language met is told apart,
however many there are; scoring reads whole texts.

Ties: of languages that score alike the first by name wins.  Nulls: a null
text, or one without a letter, is ``und`` with score 0, and so
is every text when no row has a language.  Rows without a language teach
nothing.  Repeated rows are scored alike.  Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, first_bytes, fitted, table
from .kernels import pieces

N = 3
BINS = 1 << 13
LANDMARKS = 96
SAMPLE = 2000
LEAST = 16
TEXT_BYTES = 1 << 14
RIDGE = 1e-3
SHARPNESS = 8.0
#: Texts whose presence vectors are held at once.
ROWS = 512

#: Letters to lower case, all other ASCII to a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint32)


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Normalised presence vectors of the texts of a piece, one a row."""
    rows = len(offs) - 1
    out = np.zeros((rows, BINS), np.float32)
    flat = out.reshape(-1)
    code = _FOLD[data]
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offs))
    doubled = np.zeros(len(code), bool)
    doubled[1:] = (code[1:] == 32) & (code[:-1] == 32) & (owner[1:] == owner[:-1])
    code, owner = code[~doubled], owner[~doubled]
    gram = np.zeros(len(code), np.uint32)
    for n in range(1, N + 1):
        if len(code) < n:
            break
        gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        same = owner[: len(gram)] == owner[n - 1 :]
        place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        flat[(owner[: len(gram)] * BINS + place)[same]] = 1
    norm = np.sqrt(out.sum(1, keepdims=True))
    return out / np.maximum(norm, 1)


def _vectors(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, end, data, offs in pieces(column):
        for at in range(0, end - first, ROWS):
            stop = min(at + ROWS, end - first)
            yield first + at, first + stop, presence(data[offs[at] : offs[stop]], offs[at : stop + 1] - offs[at])


def fit(texts: pa.Array, langs: list[str]) -> dict:
    """Landmarks and weights from labelled texts."""
    names = sorted(set(langs))
    if not names:
        return {"names": []}
    x = np.concatenate([v for _, _, v in _vectors(texts)])
    y = np.array([names.index(v) for v in langs])
    each = max(1, LANDMARKS // len(names))
    chosen = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(names))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T).astype(float) @ whiten
    # each language weighs the same, however many rows it has
    weight = 1 / np.bincount(y, minlength=len(names))[y]
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    solved = np.linalg.solve(gram, (z * weight[:, None]).T @ target)
    return {"names": names, "marks": np.ascontiguousarray(marks.T), "weights": (whiten @ solved).astype(np.float32)}


def predict(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its share of a softmax over all."""
    best, share = np.zeros(len(column), np.int64), np.zeros(len(column))
    for first, end, x in _vectors(column):
        score = SHARPNESS * ((x @ model["marks"]) @ model["weights"]).astype(float)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best[first:end] = p.argmax(1)
        share[first:end] = p.max(1)
    return best, share


def train(docs: DataFrame, learn: Column) -> dict:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return {"names": []}
    each = max(LEAST, SAMPLE / len(counts))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # a language with fewer rows than its part gives all of them
    part = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, each / r["n"]))) for r in counts], F.lit(0.0))
    text = first_bytes(F.col("text"), F.lit(TEXT_BYTES))
    drawn = known.filter(draw < part).select("lang", text.alias("text"), F.xxhash64("doc_id", "text").alias("_o"))

    def build(sample: pa.Table) -> dict:
        sample = sample.sort_by([("_o", "ascending"), ("text", "ascending")])
        return fit(sample.column("text").combine_chunks(), sample.column("lang").to_pylist())

    return fitted(drawn, build)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value["names"], "und"], pa.string())
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, share = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            if len(names) > 1 and lettered.any():
                best, share = predict(batch.column(1), shared.value)
                best[~lettered], share[~lettered] = len(names) - 1, 0
            yield pa.record_batch([batch.column(0), names.take(pa.array(best)), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lettered.alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
