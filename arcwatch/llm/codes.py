"""Compression of vectors to short codes by integer codebooks.

A vector is cut into ``parts`` equal parts, and each part is replaced by the
index of its nearest codebook entry.  All arithmetic is on integers
(floor(1024 * x)), so results do not depend on the number of tasks or the order
of sums.  Every round is one pass: the codebooks (entries x length x 8 bytes, of
a fixed number of entries) are broadcast, Arrow batches compute all squared
distances by norm expansion with exact int64 products and take the first
smallest, and sums and counts of each entry are merged by a grouped shuffle.
The driver holds the codebooks alone.

Ties go to the lower index; unused entries stay.  Repeated rows and repeated
vec_ids are rows of their own: the starting entries are the first rows by
(vec_id, vector), and rows without a vec_id start nothing.  With fewer rows than
entries the codebooks are as short.  Nulls: vectors that are null or hold null
or non-finite components are left out; a null label is a label of its own.
Vectors of another length than most have (of lengths that the number of parts
divides), empty ones included, are returned with null code and error.  Integer
components are held within +-sqrt(2**60 / length), 131,072 in the vector's own
units at length 64, so that no distance leaves 64 bits; a label's error beyond
them is the largest long.  Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, table
from .vectors import chunks, integers, kept_vectors, product, summed

PARTS = 4
ENTRIES = 256
ROUNDS = 4
LONGEST = (1 << 63) - 1


def bound_of(d: int) -> int:
    return int((2**60 / d) ** 0.5)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every row's parts;
    books: parts x entries x width."""
    parts, _, width = books.shape
    code, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p, book in enumerate(books):
        part = x[:, p * width : (p + 1) * width]
        far = (part * part).sum(1)[:, None] - 2 * product(part, book.T) + (book * book).sum(1)
        code[:, p] = far.argmin(1)
        error[:, p] = far[np.arange(len(x)), code[:, p]]
    return code, error


def _sums(shared, d: int):
    """Counts and sums of the parts of each entry, one array a (part, entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        books = shared.value
        parts, entries, width = books.shape
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in chunks(batches, max(d, entries)):
            x = integers(batch.column("v"), d, bound_of(d))
            code, _ = assign(x, books)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                ids, first = np.unique(code[order, p], return_index=True)
                part = np.concatenate([np.ones((len(x), 1), np.int64), x[:, p * width : (p + 1) * width]], 1)
                total[p * entries + ids] += np.add.reduceat(part[order], first, axis=0)
        used = np.flatnonzero(total[:, 0])
        return dict(zip(used.tolist(), total[used]))

    return run


def fit_codebooks(rows: DataFrame, d: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """parts x entries x width integers after so many rounds over rows, whose
    vectors ``v`` all have length d."""
    # the entries the rounds start from: a fixed number of rows
    start = rows.filter("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    x = integers(start, d, bound_of(d))
    books = np.ascontiguousarray(x.reshape(len(x), parts, d // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(x) else 0):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        books = books.copy()
        for k, row in summed(rows.select("v"), _sums(shared, d), np.int64).items():
            books[k // books.shape[1], k % books.shape[1]] = row[1:] // row[0]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, d: int, books: np.ndarray) -> DataFrame:
    """Rows with ``code``, an array of entry indexes, and ``error`` in place of v."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    others = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, max(d, shared.value.shape[1])):
            code, error = assign(integers(batch.column("v"), d, bound_of(d)), shared.value)
            made = pa.FixedSizeListArray.from_arrays(pa.array(code.astype(np.int32).reshape(-1)), code.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.record_batch({**{c: batch.column(c) for c in others}, "code": made, "error": pa.array(error.sum(1))})

    kinds = dict(rows.dtypes)
    return rows.select(*others, "v").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", code array<int>, error long")


def decode(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in the vectors' own units."""
    parts, _, width = books.shape
    return (books[np.arange(parts), code].reshape(len(code), parts * width) + 0.5) / 1024


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code array<int>, error, label_error of every kept vector;
    the codebooks)."""
    rows, d = kept_vectors(vectors, [F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label")], parts)
    odd = rows.filter(F.size("v") != d).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if not d:
        return odd.withColumn("label_error", F.lit(None).cast("long")), np.zeros((parts, 0, 0), np.int64)
    fit = rows.filter(F.size("v") == d)
    books = fit_codebooks(fit, d, parts, entries, rounds)
    if not books.shape[1]:  # no row has a vec_id: nothing to start from
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error")), books
    # written once, as errors are summed by label and met by row
    coded = cut(encode(fit, d, books).unionByName(odd), "codes")
    coded = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(""))})
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("_none", "_label").agg(total.alias("label_error"))
    # a label may hold any share of the rows
    joined = spread_join(coded, sums, ["_none", "_label"], "vec_id")
    return joined.select("vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error")), books


def op12_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all rows of embeddings, two hex digits an index."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return coded.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as common tables.  Distances are expanded norms in doubles,
    whole numbers below 2**53 for components of ordinary size."""
    steps = [
        """kept AS (SELECT vec_id, label, [floor(1024 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0)""",
        "cuts AS (SELECT vec_id, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS x FROM kept, range(4) AS r(p))",
        "book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cuts QUALIFY e < 256)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""near{n} AS (SELECT vec_id, p, any_value(c.x) AS x, min(ROW(list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.x)
  + list_inner_product(b.x, b.x), b.e)) AS best FROM cuts c JOIN book{n} b USING (p) GROUP BY vec_id, p)""")
        if n < ROUNDS:
            steps.append(f"""flat{n} AS (SELECT p, best[2] AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM near{n}),
mean{n} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS m FROM flat{n} GROUP BY p, e, i) GROUP BY p, e),
book{n + 1} AS (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m USING (p, e))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
seal AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(x::BIGINT[], ',') AS t FROM book{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), seal"""


OP12_SQL = _sql()
