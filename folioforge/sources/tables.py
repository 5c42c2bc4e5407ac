"""Readers of the test tables and of files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, modified, source_hash) of a folder's png, jpg, jpeg and webp files, case ignored, not below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[wW][eE][bB][pP]}").option("recursiveFileLookup", "false").load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.col("modificationTime").alias("modified"), F.upper(F.sha2("content", 256)).alias("source_hash"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir; where it is unset, one of our own if there is only this machine, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, where several steps read it: nothing is worked out twice, and lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
