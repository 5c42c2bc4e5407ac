"""The line protocol of recognition workers: requests and responses as JSON lines, and what engines give as words.

The engines themselves are not part of the library: a caller hands in what they gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: The protocol's version, its error texts, and the confidence that the second engine's whole text is given.
VERSION = 1
UNSUPPORTED, UNKNOWN_ENGINE = "Unsupported protocol version", "OCR engine is not configured with a local model"
FAILED, UNANSWERED = "OCR worker failed.", "OCR worker returned no matching response."
TEXT_CONFIDENCE = 0.8

WORD = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("confidence", "left", "top", "right", "bottom"))])
RESPONSE = T.StructType(
    [
        T.StructField("protocolVersion", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("requestId", "status", "engine", "modelVersion", "stage", "exceptionType", "error")),
        T.StructField("retryable", T.BooleanType()), T.StructField("words", T.ArrayType(WORD)),
    ]
)


def requests(pages: DataFrame, request_id: Column, engine: Column, image: Column) -> DataFrame:
    """pages with line: the request for each."""
    fields = F.struct(F.lit(VERSION).alias("protocolVersion"), request_id.alias("requestId"), engine.alias("engine"), image.alias("imagePath"))
    return pages.withColumn("line", F.to_json(fields))


def parsed(line: Column) -> Column:
    """A line as a response; null for lines that are no JSON object, of another protocol, or without an id."""
    r = F.from_json(line, RESPONSE)
    return F.when((r["protocolVersion"] == VERSION) & r["requestId"].isNotNull(), r)


def responses(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """(request_id, ok, engine, model_version, words, error, retryable, stage, exception) for each of asked (request_id, engine).

    lines: (place, value).  Noise between the lines is passed over; of several answers to a request the first counts.  What
    an answer leaves out is filled in: the engine asked for, an unknown model, no words; a failure can be tried again unless it
    says otherwise.  A request without an answer failed at its engine.
    """
    some = lines.select("place", parsed(F.col("value")).alias("r")).where("r is not null")
    first = some.groupBy(F.col("r.requestId").alias("_id")).agg(F.min_by("r", "place").alias("r"))
    both = asked.join(first, F.col("request_id") == F.col("_id"), "left")
    ok, came = F.coalesce(F.col("r.status") == "ok", F.lit(False)), F.col("_id").isNotNull()
    bad = lambda c: F.when(~ok, c)
    return both.select(
        "request_id", ok.alias("ok"), F.coalesce("r.engine", "engine").alias("engine"), F.when(ok, F.coalesce("r.modelVersion", F.lit("unknown"))).alias("model_version"), F.when(ok, F.coalesce("r.words", F.array().cast(T.ArrayType(WORD)))).alias("words"),
        bad(F.when(came, F.coalesce("r.error", F.lit(FAILED))).otherwise(UNANSWERED)).alias("error"), bad(F.coalesce("r.retryable", F.lit(True))).alias("retryable"), bad(F.when(came, F.col("r.stage")).otherwise(F.col("engine"))).alias("stage"), bad(F.col("r.exceptionType")).alias("exception"),
    )


def box_words(boxes: Column, texts: Column, scores: Column) -> Column:
    """The first engine's parallel arrays as words; as many as the shortest of them has."""
    n = F.least(F.size(boxes), F.size(texts), F.size(scores))
    word = lambda i: F.struct(F.get(texts, i).alias("text"), F.get(scores, i).cast("double").alias("confidence"), *(F.get(F.get(boxes, i), F.lit(k)).cast("double").alias(c) for k, c in enumerate(("left", "top", "right", "bottom"))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast(T.ArrayType(WORD)))


def text_words(text: Column) -> Column:
    """The second engine's text, a line for each paragraph, as one word over the whole page."""
    one = F.struct(tx.collapse_blank_lines(text).alias("text"), F.lit(TEXT_CONFIDENCE).alias("confidence"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(1.0).alias("right"), F.lit(1.0).alias("bottom"))
    return F.array(one).cast(T.ArrayType(WORD))


def answers(asked: DataFrame, given: DataFrame) -> DataFrame:
    """asked (request_id, version, engine) with answer, the response line of each.

    given: (request_id, boxes, texts, scores, text, failure, exception): what an engine gave or why it failed.  The mock engine
    always gives no words; another version or engine, or one that gave nothing, is an error.
    """
    g = given.select(F.col("request_id").alias("_id"), *(c for c in given.columns if c != "request_id"))
    both = asked.join(g, F.col("request_id") == F.col("_id"), "left")
    head = [F.lit(VERSION).alias("protocolVersion"), F.col("request_id").alias("requestId")]
    good = lambda engine, model, words: F.to_json(F.struct(*head, F.lit("ok").alias("status"), F.lit(engine).alias("engine"), F.lit(model).alias("modelVersion"), words.alias("words")))
    wrong = lambda message: F.to_json(F.struct(*head, F.lit("error").alias("status"), F.lit(message).alias("error")))
    stage = F.when(F.col("engine") == "paddle", "PaddleOCR").otherwise("Tesseract")
    broken = F.to_json(F.struct(*head, F.lit("error").alias("status"), stage.alias("stage"), F.coalesce("exception", F.lit("ValueError")).alias("exceptionType"), F.col("failure").alias("error"), F.lit(True).alias("retryable")))
    answer = (
        F.when(~F.col("version").eqNullSafe(F.lit(VERSION)), wrong(UNSUPPORTED)).when(F.col("engine") == "mock", good("mock", "none", F.array().cast(T.ArrayType(WORD))))
        .when(~F.coalesce(F.col("engine").isin("paddle", "tesseract"), F.lit(False)) | F.col("_id").isNull(), wrong(UNKNOWN_ENGINE)).when(F.col("failure").isNotNull(), broken)
        .when(F.col("engine") == "paddle", good("paddle", "PP-OCRv6-medium", box_words(F.col("boxes"), F.col("texts"), F.col("scores")))).otherwise(good("tesseract", "jpn_vert", text_words(F.col("text"))))
    )
    return both.select(*asked.columns, answer.alias("answer"))
