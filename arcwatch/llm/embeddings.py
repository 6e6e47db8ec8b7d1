"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors, less the mean of their label, are cut in two halves with a codebook
each; the pair of nearest codes is a cell of the product grid.  Labels that are
clusters would else have their vectors in few cells.  A query visits cells by multi-sequence
traversal: both lists of code distances are sorted, and the next pair in order
of the summed squared distances is taken from the heads of the sequences, until
the sum exceeds that of the query's own cell by ``excess``.  The excess is
measured: sampled vectors are turned by exactly the threshold angle in random
directions, the hardest links there are, and it is the ``RECALL`` quantile of
what reaching the turned vectors' cells took.  Candidates are verified by
cosine in double precision, so no link is false.

Equal vectors of a label are one node with a count.  Every visited cell is
compared in blocks: queries and members are dealt by salts once a cell exceeds
``BLOCK``, and a task returns a count for each query and a spanning forest of
the links, never all pairs.  A pair met from one side alone counts for both:
members carry the cells that they visit.

Codebooks grow with the square root of the largest label, so cells stay as large
as they are; they are fitted on ``SAMPLE`` rows, which hold ``SAMPLE`` / 8 codes
at most.  Every row is indexed.  Each length of vector has an index of its own;
beyond the ``LENGTHS`` most frequent, vectors of one length are one cell.

Nulls: vectors that are null, empty, zero or that hold null or non-finite
components link with nothing, and neither do rows whose label is null or whose
vec_id is null.  Vectors of different lengths do not link.  Rows that repeat a
vec_id are one vector each, and equal ones count as links of each other.  Very
large and very small components are scaled by powers of two first.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join, table
from .components import components

COSINE = 0.93
SAMPLE = 8192
LENGTHS = 8
#: Nodes of a label that its mean is taken from.
LABEL_SAMPLE = 256
#: Vectors of one label to a cell of the grid.
CELL = 512
BLOCK = 2048
RECALL = 0.99


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows of x."""
    k = max(1, min(k, len(x)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(0)
    return np.unique(centres, axis=0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _unit(column: pd.Series) -> np.ndarray:
    """Unit vectors.  The largest component is made 1 first, so that no square
    leaves what a double holds."""
    x = np.stack(column.to_numpy()).astype(float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _means(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _halves(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the halves of each row to the codes of their book."""
    half = x.shape[1] // 2
    return _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])


def traverse(one: np.ndarray, two: np.ndarray, excess: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) in multi-sequence order: for every row the pairs of codes by
    their summed distances, as far as the least sum plus the excess.  All rows
    take a step at once; a row that has ended leaves."""
    width = two.shape[1]
    first, second = np.argsort(one, 1, kind="stable"), np.argsort(two, 1, kind="stable")
    one, two = np.take_along_axis(one, first, 1), np.take_along_axis(two, second, 1)
    limit = one[:, 0] + two[:, 0] + excess
    row = np.arange(len(one))
    at = np.zeros(one.shape, np.int64)
    heads = one + two[:, :1]
    rows, cells = [], []
    while len(row):
        i = heads.argmin(1)
        every = np.arange(len(row))
        on = heads[every, i] <= limit[row]
        if not on.all():
            row, at, heads, i = row[on], at[on], heads[on], i[on]
            every = np.arange(len(row))
        j = at[every, i]
        rows.append(row)
        cells.append(first[row, i] * width + second[row, j])
        at[every, i] = j + 1
        heads[every, i] = np.where(j + 1 < width, one[row, i] + two[row, np.minimum(j + 1, width - 1)], np.inf)
    return np.concatenate(rows), np.concatenate(cells)


def excess_for_recall(x: np.ndarray, means: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float) -> float:
    """How far past its own cell's sum a query must go, so that this share of
    links at the threshold is met."""
    rng = np.random.default_rng(7)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-12)
    one, two = _halves(x - means, books)
    far_one, far_two = _halves(cosine * x + np.sqrt(1 - cosine**2) * side - means, books)
    every = np.arange(len(x))
    needed = one[every, far_one.argmin(1)] + two[every, far_two.argmin(1)] - one.min(1) - two.min(1)
    return float(np.quantile(needed, recall, method="higher")) + 1e-9


def _route(shared):
    """Each node once for every cell it visits; in its own cell with the list
    of them all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, same in frame.groupby(frame["v"].map(len)):
                for at in range(0, len(same), 4096):
                    yield route(same.iloc[at : at + 4096], d)

    def route(part: pd.DataFrame, d: int) -> pd.DataFrame:
        row, cell = np.arange(len(part)), np.zeros(len(part), np.int64)
        if d in shared.value:
            books, excess = shared.value[d]
            row, cell = traverse(*_halves(_unit(part["v"]) - _means(part["mean"]), books), excess)
        by = np.argsort(row, kind="stable")
        row, cell = row[by], cell[by]
        first = np.searchsorted(row, np.arange(len(part)))
        home = cell[first]
        visited = np.split(cell, first[1:])
        own = cell == home[row]
        picked = part.iloc[row]
        seen = [visited[r] if mine else None for r, mine in zip(row, own)]
        return pd.DataFrame({"label": picked["label"].to_numpy(), "d": d, "cell": cell, "home": home[row], "node": picked["node"].to_numpy(), "visited": seen})

    return run


def _forest(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Indexes of links that form a spanning forest."""
    names, flat = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    a, b = flat[: len(rows)], flat[len(rows) :]
    parent = np.arange(len(names))
    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[i] = j
            keep.append(k)
    return np.array(keep, np.int64)


def _compare(cosine: float):
    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        out = [pd.DataFrame(none)]
        if len(queries) and len(members):
            x, y = _unit(queries["v"]), _unit(members["v"])
            q, m = queries["node"].to_numpy(), members["node"].to_numpy()
            home, copies, own_copies = queries["home"].to_numpy(), members["copies"].to_numpy(), queries["copies"].to_numpy()
            seen = members["visited"].to_numpy()
            sizes = np.array([len(s) for s in seen])
            visits = np.stack([np.repeat(np.arange(len(seen)), sizes), np.concatenate(seen)], 1)
            span = max(int(visits[:, 1].max()), int(home.max())) + 1
            visits = np.unique(visits[:, 0] * span + visits[:, 1])
            for at in range(0, len(x), 1024):
                hit = x[at : at + 1024] @ y.T >= cosine
                hit &= q[at : at + 1024, None] != m[None, :]
                row, col = np.nonzero(hit)
                if not len(row):
                    continue
                count = np.bincount(row, copies[col], minlength=min(1024, len(x) - at)).astype(np.int64)
                tree = _forest(q[at + row], m[col])
                out.append(pd.DataFrame({"a": q[at : at + len(count)], "b": -1, "n": count}))
                out.append(pd.DataFrame({"a": q[at + row[tree]], "b": m[col[tree]], "n": 0}))
                # members that do not visit the query's own cell meet it here alone
                alone = ~np.isin(col * span + home[at + row], visits)
                back = np.bincount(col[alone], own_copies[at + row[alone]], minlength=len(m)).astype(np.int64)
                out.append(pd.DataFrame({"a": m[back > 0], "b": -1, "n": back[back > 0]}))
        return pd.concat(out)[["a", "b", "n"]]

    return run


def train_index(placed: DataFrame, d: int, count: int, cosine: float, recall: float) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Codebooks by k-means of each half of the residuals of length d, and the
    excess, from the ``SAMPLE`` vectors of smallest hash."""
    sample = placed.filter(F.col("d") == d).orderBy("h1", "h2", "label").limit(SAMPLE).select("v", "mean").toPandas()
    x, means = _unit(sample["v"]), _means(sample["mean"])
    half = x.shape[1] // 2
    codes = min(SAMPLE // 8, max(1, int(np.ceil((count / CELL) ** 0.5))))
    books = _kmeans((x - means)[:, :half], codes), _kmeans((x - means)[:, half:], codes)
    return books, excess_for_recall(x[:2048], means[:2048], books, cosine, recall)


def label_means(nodes: DataFrame) -> DataFrame:
    """d, label and the mean of the unit vectors of its ``LABEL_SAMPLE`` nodes of
    smallest hash: where residuals are taken from, so any point near the label's
    vectors does."""
    nth = F.row_number().over(Window.partitionBy("d", "label").orderBy("h1", "h2"))
    drawn = nodes.withColumn("_n", nth).filter(F.col("_n") <= LABEL_SAMPLE)
    # scaled first, as in _unit
    scaled = F.transform("v", lambda c: c.cast("double") / F.array_max(F.transform("v", lambda e: F.abs(e.cast("double")))))
    drawn = drawn.select("d", "label", scaled.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    flat = drawn.withColumn("_length", length).select("d", "label", "_length", F.posexplode("v").alias("at", "c"))
    by_place = flat.groupBy("d", "label", "at").agg(F.avg(F.col("c") / F.col("_length")).alias("m"))
    return by_place.groupBy("d", "label").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("_m")).select("d", "label", F.col("_m.m").alias("mean"))


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0)
    rows = rows.withColumns({"fit": F.coalesce(fit, F.lit(False)), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})
    same = ["label", "h1", "h2"]
    nodes = rows.filter("fit").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    # numbered once and written, so a lost task cannot number anew
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    # a label may hold any share of the nodes
    placed = nodes.select("label", "node", "v", "h1", "h2", F.size("v").alias("d"))
    placed = cut(spread_join(placed, label_means(placed), ["d", "label"], "node"), "placed")
    by_label = nodes.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n"))
    lengths = by_label.groupBy("d").agg(F.sum("n").alias("all"), F.max("n").alias("n")).filter("d > 1").orderBy(F.desc("all"), "d").limit(LENGTHS).collect()
    index = vectors.sparkSession.sparkContext.broadcast({r["d"]: train_index(placed, r["d"], r["n"], cosine, recall) for r in lengths})
    routed = placed.select("label", "node", "v", "mean").mapInPandas(_route(index), "label string, d int, cell long, home long, node long, visited array<long>")
    # the routes are written without the vectors, which are met again by node
    routed = cut(routed, "routes")
    # members are the rows in their own cells; every row is a query of each cell it visits
    place = ["label", "d", "cell"]
    own = F.col("cell") == F.col("home")
    tally = routed.groupBy(*place).agg(F.count("*").alias("asked"), F.count_if(own).alias("held")).filter("held > 0")
    tally = tally.select(*place, F.ceil(F.col("asked") / BLOCK).alias("s"), F.ceil(F.col("held") / BLOCK).alias("t"))
    salted = spread_join(routed, tally, place, "node").join(nodes.select("node", "copies", "v"), "node")
    qs, ms = F.pmod(F.xxhash64("node"), F.col("s")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("t"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = [*place, "qs", "ms"]
    queries = salted.withColumn("qs", qs).withColumn("ms", every("t")).select(*keys, "node", "copies", "home", "v")
    members = salted.filter(own).withColumn("ms", ms).withColumn("qs", every("s")).select(*keys, "node", "copies", "visited", "v")
    queries, members = queries.toDF(*queries.columns), members.toDF(*members.columns)
    found = cut(queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_compare(cosine), "a long, b long, n long"), "links")
    counts = found.filter("b < 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    roots = components(found.filter("b >= 0").select("a", "b")).withColumnRenamed("label", "root")

    known = nodes.select(*same, "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "root").select(*same, "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # equal vectors may be any share of the rows, and so may those that link with nothing
    linked = spread_join(rows.filter("fit").select("vec_id", *same), known, same, "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))
