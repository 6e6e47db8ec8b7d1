"""Mixing sources to target weights by Poisson replication.

Every row gets a Poisson count whose mean is its source's repetition rate
(target share of the output over present share), found by inverting the
distribution function at a hash of (seed, doc_id), is exploded by that count,
and all copies are ordered by a hash.  Nothing depends on partitioning or on
the order of rows, so a lost task is redone with the same counts.

Means above ``STEP`` are drawn as a sum of equal independent parts.

Nulls: a null source is a source of its own; a row with null doc_id is known by
its text, and hashes as ``null:`` and the text's md5.  Repeated rows draw the
same count.  Ties of the shuffle key (copies of repeated rows) lie together.  A
source whose weight is zero or not named gives no rows, and so does an empty
table.  Documents keep all their columns; a fact of the copy whose name they
have already gets underscores after its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, table

#: Largest mean inverted at once: P(X > 80) is below 1e-28 there.
STEP = 16
TERMS = 80
#: Sources up to which the table of rates is broadcast (about 1 kB each).
SMALL = 10_000
TEMPERATURE = 0.5
SEED = 17

_CDF = (
    f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-part), 'c', array(exp(-part))), "
    "(a, k) -> named_struct('p', a.p * part / k, 'c', array_append(a.c, element_at(a.c, -1) + a.p * part / k)), a -> a.c)"
)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, rows, rate, parts, cdf: one row for each source.

    weights: relative target shares; None takes the present row counts to the
    power ``temperature``.  rows: expected output rows, as many as now if None.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(temperature)))
    else:
        named = [F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*named, F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("rows"), F.sum("weight")).first()
    target = float(rows if rows is not None else sums[0] or 0)
    rate = F.lit(target) * F.col("weight") / F.lit(float(sums[1] or 1)) / F.col("rows")
    out = counts.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    return out.withColumn("part", F.col("rate") / F.col("parts")).withColumn("cdf", F.expr(_CDF)).drop("weight", "part")


FACTS = ("rate", "n_copies", "copy_no", "shuffle_key")


def fact_names(columns: list[str]) -> list[str]:
    """The names of the facts of a copy beside these columns."""
    out = []
    for name in FACTS:
        while name in columns:
            name += "_"
        out.append(name)
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs replicated, with the facts of each copy: rate, n_copies, copy_no
    (from 1) and shuffle_key; in the order of shuffle_key over all partitions."""
    known = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    rates = source_rates(docs, weights, rows, temperature).select(known, "rate", "parts", "cdf")
    ident = F.col("doc_id").cast("string")
    if "text" in docs.columns:
        ident = F.coalesce(ident, F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    # the row as one value, so that no name of its columns matters
    whole = docs.select(F.struct("*").alias("row"), known, F.coalesce(ident, F.lit("null")).alias("ident"))
    few = rates.limit(SMALL + 1).count() <= SMALL
    joined = whole.join(F.broadcast(rates), "key") if few else spread_join(whole, rates, ["key"], "ident")
    uniform = f"cast(conv(substring(md5(concat('{seed}:', ident, ':', i)), 1, 13), 16, 10) as double) / {float(1 << 52)!r}D"
    count = f"aggregate(sequence(1, parts), 0, (n, i) -> n + size(filter(cdf, c -> c <= {uniform})))"
    copies = joined.withColumn("n_copies", F.expr(count)).filter("n_copies > 0")
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}/"), "ident", F.lit("/"), F.col("copy_no").cast("string"))))
    copies = copies.select("row", *FACTS)
    # the key is uniform: its first digits name the partition, and no pass is
    # needed to find the bounds of ranges
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * partitions / float(1 << 32)).cast("int")
    ordered = copies.repartitionById(partitions, place).sortWithinPartitions("shuffle_key")
    facts = [F.col(f).alias(name) for f, name in zip(FACTS, fact_names(docs.columns))]
    return ordered.select("row.*", *facts)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole documents are replicated and shuffled; the size and md5 of each
    copy's text are taken after it."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "n_copies", "copy_no", "shuffle_key", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


#: The same counts in DuckDB: the distribution function by summed terms.
OP1_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * pow(n::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(n::DOUBLE, {TEMPERATURE})) FROM counts) / n AS rate
  FROM counts),
parts AS (SELECT *, greatest(1, ceil(rate / {STEP}))::INTEGER AS parts FROM rates),
terms AS (
  SELECT source, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM parts, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
draws AS (
  SELECT row_number() OVER () AS r, d.doc_id, coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, ''))) AS ident, strlen(d.text) AS n_bytes, md5(d.text) AS text_md5, d.source, p.rate, p.parts FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
uniforms AS (
  SELECT r, doc_id, ident, n_bytes, text_md5, source, rate, i,
    ('0x' || substr(md5('{SEED}:' || ident || ':' || i), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM draws, LATERAL (SELECT unnest(range(1, parts + 1)) AS i)),
counted AS (
  SELECT r, doc_id, ident, n_bytes, text_md5, u.source, rate, (count(t.k))::INTEGER AS n_copies
  FROM uniforms u LEFT JOIN terms t ON t.source IS NOT DISTINCT FROM u.source AND t.c <= u.u GROUP BY r, doc_id, ident, n_bytes, text_md5, u.source, rate)
SELECT doc_id, source, round(rate, 6) AS rate, n_copies, copy_no::INTEGER AS copy_no,
  md5('{SEED}/' || ident || '/' || copy_no) AS shuffle_key, n_bytes, text_md5
FROM counted, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy_no)
"""
