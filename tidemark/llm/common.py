"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python. Texts may be long, so batches are bounded by their size.
BATCH_BYTES = str(4 << 20)

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back. Cuts lineage so that a lost executor costs one stage only.

    zstd is for large tables of numbers: its native buffers lie outside the executor's heap.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, as rows of whole texts have any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores after it as it takes to differ from `names`, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key, n: int):
    """crc32 of the key as text, modulo n: the fold of a row."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(labels: DataFrame, label: str, fold: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, label) of at most `bound` labelled rows outside the held-out fold, chosen by a hash of the key.

    Rows without a key or a label are left out; repeated keys count once, with the larger label.
    The bound keeps what is broadcast and collected for fitting at a fixed size.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), fold) != held_out if fold else F.lit(True)))
    once = picked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, bound: int) -> DataFrame:
    """Written table (text, label) of the sample's documents: one row a key, so its rows are bounded as well. Their keys are broadcast, so the corpus isn't shuffled."""
    keys = labelled_sample(labels, label, fold, held_out, bound)
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")
    return written(own.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"), "sample")
