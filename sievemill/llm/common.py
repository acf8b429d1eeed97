"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch. Texts of a few KB make Spark's usual 10,000 rows tens of MB, held
#: by the JVM and by Python, in and out, for every task of an executor.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sets ``BATCH_ROWS`` where the session has Spark's usual number or more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if Spark runs in one process,
    and a ValueError tells it otherwise: other machines wouldn't see such a folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sievemill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: later reads don't compute it again, and
    survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled_ids(labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """(doc_id, y): at most ``rows`` training ids, the same ones at every run.

    Held-out ids, null ids or labels, and ids with labels that disagree are left out. Ids
    are taken in the order of a hash, at most ``rows / 2`` of one label.
    """
    agreed = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("z"))
        .filter((F.col("y") == F.col("z")) & F.col("y").isin(0, 1))
        .filter(~is_held_out(F.col("doc_id")))
        .select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    )
    zero, one = (agreed.filter(F.col("y") == y).orderBy("h", "doc_id").limit(rows // 2) for y in (0, 1))
    return cut(zero.unionByName(one).select("doc_id", "y"))


def texts_by_hash(docs: DataFrame, rows: int, condition: Column | None = None, over: int = 2) -> DataFrame:
    """(text): at most ``rows`` non-empty texts that meet ``condition``, those of the
    smallest hashes of id and text among the ``over`` * ``rows`` ids of the smallest hashes.

    Rows without an id are left out. Ids are hashed first, by a pass that reads no text; the
    texts of the chosen ids are written, and then picked by their hashes.
    """
    text, own = F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long"))
    some = docs.filter(F.col("doc_id").isNotNull())
    last = some.select(own.alias("h")).orderBy("h").limit(over * rows).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return docs.limit(0).select(text.alias("text"))
    near = some.filter(own <= F.lit(last)).select(text.alias("text"), F.xxhash64("doc_id", text).alias("h")).filter(F.length("text") > 0)
    if condition is not None:
        near = near.filter(condition)
    near = cut(near.groupBy("h").agg(F.min("text").alias("text")))
    last = near.select("h").orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    picked = near.filter(F.col("h") <= F.lit(last)) if last is not None else near.limit(0)
    return picked.select("text")


def buckets_for(df: DataFrame, rows: int = 400, most: int = 65536) -> int:
    """Into how many salted buckets to split a hot key of ``df``: about one for every
    ``rows`` rows, and few enough that a key's buckets can be ordered in one task."""
    return max(1, min(most, df.count() // rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name
