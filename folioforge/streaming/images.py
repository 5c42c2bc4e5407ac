"""Imports of a folder of pictures as a stream: each file is read once, each content counts once, whatever it is called later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exif
from ..functions import text as tx

#: Fixed value: the endings of pictures, case ignored.
PICTURES = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[wW][eE][bB][pP]}"
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def found(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(path, file_name, modified, taken, source_hash) of pictures that appear directly in a folder; a stream.

    The stream's checkpoint knows the files that were read, so that an import that is started again opens new files only.
    """
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", PICTURES).option("recursiveFileLookup", "false").option("maxFilesPerTrigger", files_at_once).load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.col("modificationTime").alias("modified"), exif.taken_at(F.col("content")).alias("taken"), F.upper(F.sha2("content", 256)).alias("source_hash"))


def new(pictures: DataFrame) -> DataFrame:
    """The first picture of each content, over all imports: the hashes that were seen are the stream's state, one small row each."""
    return pictures.dropDuplicates(["source_hash"])


def appended(rows: DataFrame, position: int) -> DataFrame:
    """One import's pictures as pages from position on: by the time in the name, else that of the camera, else of the file; then by name in natural order.

    A micro-batch is bounded by the files it takes, so that it is one sort.
    """
    at = F.coalesce(tx.filename_time(F.col("file_name")), F.col("taken"), F.col("modified"))
    order = Window.orderBy(at, tx.natural_key(F.col("file_name")), "path")
    return rows.withColumn("position", F.row_number().over(order) - 1 + position)


def imported(spark: SparkSession, folder: str, write: Callable[[DataFrame, int], None], checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Starts an import that hands the new pictures of each micro-batch to write(rows, batch); it takes what is there and ends.

    A batch may come again under its number after a failure; write then puts it in place of what it wrote, as an action of a
    store does.
    """
    return new(found(spark, folder, files_at_once)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
