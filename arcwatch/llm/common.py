"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in
    ``spark.checkpoint.dir``.  A session without one runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Ends the lineage there: a lost executor costs a reread, not a recomputation,
    and what is read twice is computed once.  The table goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], by: str, ways: int = 16, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row a key, where a key may hold a large
    share of rows: each key goes to as many tasks as ways, dealt by a column.

    Always by shuffle: the copies are more than the size that Spark would go by
    when it chooses to broadcast a side.
    """
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(by, F.lit(3)), F.lit(ways)).cast("int"))
    copies = small.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(copies.hint("merge"), [*keys, "_way"], how).drop("_way")


def first_bytes(text: Column, limit: Column) -> Column:
    """The text if it has at most so many bytes, else its start; a character cut
    in two is left out."""
    start = F.make_valid_utf8(F.substring(text.cast("binary"), F.lit(1), limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.regexp_replace(start, "\ufffd+$", "")).otherwise(text)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; null ids count as remainder -1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(-1))


def fitted(sample: DataFrame, build) -> object:
    """build(table) in one task, for samples of documented size.

    Only the small result comes to the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([pickle.dumps(build(table))], pa.binary())})

    row = sample.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(run, "model binary").first()
    return build(sample.limit(0).toArrow()) if row is None else pickle.loads(row["model"])
