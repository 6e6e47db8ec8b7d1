"""Keyed window detectors over a long clock column (microseconds).

Ranges are inclusive: a window of W holds the rows with clock >= now - W.  Rows
of one key are ordered by (clock, tie); rows of equal clock see each other,
which is the RANGE frame's meaning.  Every detector partitions by its key, so
the work spreads over keys and nothing is gathered beyond one key's window;
ranges are sweeps (``sweeps``), which cost linear time and split hot keys.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweeps import Measure, in_range

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def clock(ts: str = "ts") -> Column:
    """A zone-free timestamp as microseconds, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def trailing(keys: list[str], span: int, us: str = "us"):
    return Window.partitionBy(*keys).orderBy(us).rangeBetween(-span, 0)


def ordered(keys: list[str], us: str = "us", tie: str = "event_id"):
    return Window.partitionBy(*keys).orderBy(us, tie)


def first_firing(df: DataFrame, keys: list[str], fires: Column, us: str = "us", tie: str = "event_id") -> DataFrame:
    """The first row of each key on which the condition holds."""
    hits = df.filter(fires)
    return hits.withColumn("_n", F.row_number().over(ordered(keys, us, tie))).filter("_n = 1").drop("_n")


def distinct_burst(df: DataFrame, keys: list[str], item: str, span: int, least: int, us: str = "us", tie: str = "event_id") -> DataFrame:
    """First time a key meets ``least`` distinct items within the span (fan-out,
    fan-in, spraying, roasting), with the count."""
    counted = in_range(df, keys, {"n_distinct": Measure(span, item=item)}, us)
    return first_firing(counted.withColumn("n_distinct", F.col("n_distinct").cast("int")), keys, F.col("n_distinct") >= least, us, tie)


def burst_items(df: DataFrame, fired: DataFrame, keys: list[str], item: str, span: int, us: str = "us") -> DataFrame:
    """keys and ``items``, sorted: what each firing's range held."""
    ends = fired.select(*keys, F.col(us).alias("_end"))
    met = df.select(*keys, us, item).join(ends, keys).filter((F.col(us) <= F.col("_end")) & (F.col(us) >= F.col("_end") - span))
    return met.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))


def count_burst(df: DataFrame, keys: list[str], item: str, span: int, rows: int, least: int, us: str = "us", tie: str = "event_id") -> DataFrame:
    """First time a key has ``rows`` rows of ``least`` distinct items in the span."""
    counted = in_range(df, keys, {"n_rows": Measure(span, F.lit(1).cast("long")), "n_distinct": Measure(span, item=item)}, us)
    return first_firing(counted, keys, (F.col("n_rows") >= rows) & (F.col("n_distinct") >= least), us, tie)


def rolling_score(df: DataFrame, keys: list[str], delta: str, span: int, cap: int, us: str = "us") -> DataFrame:
    summed = in_range(df, keys, {"score": Measure(span, F.col(delta).cast("long"))}, us)
    return summed.withColumn("score", F.least(F.lit(cap), F.col("score")).cast("int"))


def ranked_first_seen(df: DataFrame, key: str, item: str, levels: list[int], order: list[str]) -> DataFrame:
    """The rows on which a key meets its n-th new item, for the n in levels."""
    first = Window.partitionBy(key, item).orderBy(*order)
    new = df.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return new.withColumn("level", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("level").isin(levels)).drop("_n")


def islands(df: DataFrame, keys: list[str], gap: int, us: str = "us", tie: str = "event_id", facts: tuple[str, ...] = ()) -> DataFrame:
    """Runs of rows of a key that are at most ``gap`` after the one before
    (merge with the last hit): first, last and number of hits, and the facts of
    the first row."""
    w = ordered(keys, us, tie)
    new = F.when(F.col(us) - F.lag(us).over(w) <= gap, 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("hit_count"), *[F.min_by(c, F.struct(us, tie)).alias(c) for c in facts])


def silences(df: DataFrame, keys: list[str], factor: float, us: str = "us", tie: str = "event_id", declared: str | None = None) -> DataFrame:
    """Gaps to the next row that exceed ``factor`` times the interval that the
    row declares, or the key's median gap where none is."""
    gap = F.lead(us).over(ordered(keys, us, tie)) - F.col(us)
    gaps = df.withColumn("gap", gap).filter("gap is not null")
    if declared is not None:
        return gaps.filter(F.col("gap") > factor * F.col(declared))
    usual = gaps.groupBy(*keys).agg(F.percentile("gap", 0.5).alias("usual"))
    return gaps.join(usual, keys).filter(F.col("gap") > factor * F.col("usual"))


def regular_gaps(df: DataFrame, keys: list[str], least: int, us: str = "us", tie: str = "event_id") -> DataFrame:
    """Coefficient of variation of a key's gaps (beaconing is a small one)."""
    gap = F.col(us) - F.lag(us).over(ordered(keys, us, tie))
    gaps = df.withColumn("gap", gap).filter("gap is not null")
    out = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))
    return out.filter(F.col("n_gaps") >= least)


def beacons(df: DataFrame, keys: list[str], window: int = 99, every: int = 50, cv: float = 0.10, us: str = "us", tie: str = "event_id") -> DataFrame:
    """First row, among the 100th, 150th, ... of a key, whose last ``window``
    gaps vary by less than cv."""
    w = ordered(keys, us, tie)
    gaps = df.withColumn("gap", F.col(us) - F.lag(us).over(w)).withColumn("n", F.row_number().over(w))
    recent = w.rowsBetween(1 - window, 0)
    gaps = gaps.withColumn("cv", F.stddev_pop("gap").over(recent) / F.avg("gap").over(recent))
    return first_firing(gaps.filter((F.col("n") > window) & ((F.col("n") - window - 1) % every == 0)), keys, F.col("cv") < cv, us, tie)


def fold(df: DataFrame, keys: list[str], value: str, adds: dict[str, pa.DataType], start, us: str, tie: str, nulls_first: bool = False) -> DataFrame:
    """keys and the columns ``adds`` of the rows for which the fold gives values.

    ``start()`` makes the fold of a key, a function of (clock, tie, value) that
    keeps the state.  A key's rows come in order as a stream of batches, so a
    task holds one batch and one state, however many rows a key has.
    """
    n = len(keys)
    sort = [F.col(c).asc_nulls_first() if nulls_first else F.col(c).asc_nulls_last() for c in ("_us", "_tie")]
    rows = df.select(*keys, F.col(us).cast("long").alias("_us"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = step = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if step is None or row[:n] != key:
                    key, step = row[:n], start()
                found = step(*row[n:])
                if found is not None:
                    out.append((*key, *found))
            kinds = [*(batch.schema.field(i).type for i in range(n)), *adds.values()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*keys, *adds])

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{k}` {'double' if t == pa.float64() else 'long'}" for k, t in adds.items()]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(run, ", ".join(kinds))


def throttle(df: DataFrame, keys: list[str], quiet: int, us: str = "us", tie: str = "event_id") -> DataFrame:
    """Rows at least ``quiet`` after the last *emitted* row of the key.

    Unlike islands, a suppressed row does not extend the silence, so no lag
    expresses it; a fold over the key's ordered clock does.
    """

    def start():
        last = None

        def step(now, number, _):
            nonlocal last
            if last is None or now - last >= quiet:
                last = now
                return now, number

        return step

    return fold(df, keys, tie, {us: pa.int64(), tie: pa.int64()}, start, us, tie, nulls_first=True)


def fire_and_reset(df: DataFrame, keys: list[str], item: str, span: int, least: int, us: str = "us", tie: str = "event_id") -> DataFrame:
    """Fires at ``least`` distinct items in the span, then forgets them."""

    def start():
        held: deque[tuple] = deque()
        items: Counter = Counter()

        def step(now, number, what):
            while held and (now is None or held[0][0] is None or held[0][0] < now - span):
                old = held.popleft()[1]
                items[old] -= 1
                if not items[old]:
                    del items[old]
            held.append((now, what))
            items[what] += 1
            if len(items) >= least:
                found = number, len(held)
                held.clear()
                items.clear()
                return found

        return step

    return fold(df, keys, item, {tie: pa.int64(), "n_rows": pa.int64()}, start, us, tie)


def ewma(df: DataFrame, key: str, value: str, alpha: float = 0.1, warm: int = 5, us: str = "us", tie: str = "event_id") -> DataFrame:
    """Exponentially weighted mean and variance, and the deviation of each row.

    The rows of a key before the ``warm``-th only set the mean; the deviation is
    from the mean that already includes the row.
    """

    def start():
        n, mean, var = 0, 0.0, 0.0

        def step(_, number, v):
            nonlocal n, mean, var
            v = math.nan if v is None else float(v)
            n += 1
            if n < warm:
                mean, var, z = v, 0.0, 0.0
            else:
                delta = v - mean
                mean = alpha * v + (1 - alpha) * mean
                var = (1 - alpha) * (var + alpha * delta * delta)
                z = abs(v - mean) / max(var, 1e-9) ** 0.5
            return number, *(None if math.isnan(x) else x for x in (mean, z))

        return step

    return fold(df, [key], value, {tie: pa.int64(), "ema": pa.float64(), "z": pa.float64()}, start, us, tie)
