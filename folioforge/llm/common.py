"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own if there is only this machine, else an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows once as Parquet in the shared folder and reads them back: survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 2000) -> Iterator[None]:
    """Bounds what one Arrow batch holds, so that long texts do not add up; for what runs inside the block."""
    bounds = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {k: spark.conf.get(k, None) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release() -> None:
    """Gives memory that a worker no longer needs back to the machine, where its C library can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through the file system Spark itself uses."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of df to be: file sizes, read from metadata alone."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The size of df: of its files, or counted from its texts where the optimizer does not know one."""
    known = input_bytes(df)
    return known if known < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def packed(df: DataFrame, *without: str, **more: Column) -> DataFrame:
    """The rows of df, less some columns, as one struct _row beside some columns of our own, so that no name of df's can clash with those."""
    return df.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without)).alias("_row"), *(c.alias(n) for n, c in more.items()))


def free(df: DataFrame, name: str) -> str:
    """name, with underscores after it where df has a column so named: what df brings is kept as it is."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unpacked(rows: DataFrame, df: DataFrame, **more: Column) -> DataFrame:
    """The rows of packed(df) as they were, and more columns under names that are free in df."""
    mine = free(df, "_more")
    both = rows.select("_row", F.struct(*(c.alias(n) for n, c in more.items())).alias(mine))
    return both.select("_row.*", *(F.col(f"{mine}.{n}").alias(free(df, n)) for n in more))


def without_rows(docs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """docs without the rows that rows (doc_id, th) name, th being the text's hash; null ids are ids like any other.  rows is broadcast if it has at most so many."""
    i, t = free(docs, "_id"), free(docs, "_th")
    gone = rows.toDF(i, t)
    gone = F.broadcast(gone) if rows.count() <= most else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)), "left_anti").select(*docs.columns)


def parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The slices of a text of about so many bytes; each but the last ends before a space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body: a column expression inlined into a lambda would run again for each element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; all-ASCII texts take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
