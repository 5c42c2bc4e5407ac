"""A run of recognition as a stream: response lines come in as files, each page is committed with its micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import worker


def lines(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(value, at) of the lines of files that appear in a folder; at is the time of their file."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select("value", F.col("_metadata.file_modification_time").alias("at"))


def answers(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The responses in a stream of (value, at), without noise; an answer that comes again within `late` is dropped, and so is its state after that."""
    found = stream.select("at", worker.parsed(F.col("value")).alias("r")).where("r is not null").select("at", F.col("r.requestId").alias("request_id"), "r")
    return found.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])


def recorded(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands each micro-batch's pages to write(rows, batch): (request_id, kind, words, error, retryable, stage).

    Failures are rows, so that one page never stops the others.  A batch may be handed on again after a failure, under the
    same number: write must put it in place of what it wrote then.  What is there is taken, then the query ends; started
    again it goes on from its checkpoint, so that a cancelled run keeps the pages that are done.
    """
    ok = F.col("r.status") == "ok"
    rows = stream.select("request_id", F.when(ok, "Completed").otherwise("Failed").alias("kind"), F.col("r.words").alias("words"), F.when(~ok, F.coalesce("r.error", F.lit(worker.FAILED))).alias("error"), F.when(~ok, F.coalesce("r.retryable", F.lit(True))).alias("retryable"), F.when(~ok, F.col("r.stage")).alias("stage"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
