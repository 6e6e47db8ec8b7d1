"""Where results go: findings as JSON lines, baselines as tables with a seal,
reports as Markdown.  Everything but the Markdown is written by the executors;
that renders a bounded number of rows."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import taxonomy

#: Rows that a rendered report shows (a limit of the report, not of the data).
SHOWN = 50


def write_findings(findings: DataFrame, path: str, floor: str = "info") -> None:
    """Findings of a severity or worse as JSON lines."""
    findings.filter(taxonomy.severity_rank(F.col("severity")) >= taxonomy.SEVERITIES.index(floor)).write.mode("overwrite").json(path)


def write_indicators(known: DataFrame, path: str) -> None:
    known.write.mode("overwrite").json(path)


def _digest(df: DataFrame) -> str:
    """A sum of row hashes: the same in any order of rows and partitions."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    got = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return "|".join(map(str, got))


def save_baseline(df: DataFrame, path: str, key: bytes) -> str:
    """Write a baseline (files, edges, behaviour) as a table, with an HMAC over
    its rows beside it; the seal is returned too."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    seal = hmac.new(key, _digest(spark.read.parquet(f"{path}/rows")).encode(), hashlib.sha256).hexdigest()
    spark.createDataFrame([(seal,)], "seal string").coalesce(1).write.mode("overwrite").json(f"{path}/seal")
    return seal


def load_baseline(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """The rows of a saved baseline; ValueError if they are not what was sealed."""
    df = spark.read.parquet(f"{path}/rows")
    seal = hmac.new(key, _digest(df).encode(), hashlib.sha256).hexdigest()
    saved = spark.read.json(f"{path}/seal").first()["seal"]
    if not hmac.compare_digest(seal, saved):
        raise ValueError(f"the baseline at {path} was changed after it was saved")
    return df


def merge_baseline(old: DataFrame, new: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """A baseline of counts brought up to date with new ones."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def _cell(value) -> str:
    return str("" if value is None else value).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, tables: dict[str, DataFrame], shown: int = SHOWN) -> str:
    """A report of the first rows of some tables."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(map(_cell, row)) + " |" for row in df.limit(shown).collect()]
        out.append("")
    return "\n".join(out)
