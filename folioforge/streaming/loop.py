"""The loop of a recognition run as a stream with state: each page of a run asks its engines one after the other and ends once.

A page starts with a request to the first engine.  Its words are kept while the second engine is asked, once; what that gives, or
that it gave nothing, ends the page.  A request that is not answered in time has failed.  A cancelled page gets back the status it
had.  All of this goes by the events' own times, so that a run that is read again, or started again half-way, ends alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import supplement
from ..operators import layout, loads, writers
from ..sources import worker

#: The engines in their order, and the stages that a failure names.
FIRST, SECOND = "paddle", "tesseract"
STAGES = {FIRST: "PaddleOCR", SECOND: "Tesseract"}
COMPLETED, REVIEW, FAILED = "Completed", "ReviewRequired", "Failed"
CANCELLED = "The operation was canceled."
UNANCHORED = "UnanchoredSuggestion"
#: The state store of Spark's that has timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COMMAND = T.StructType([T.StructField(c, T.StringType()) for c in ("command", "run", "page", "before")])
#: ask: a request to be sent; end: how a page ended.  words and text are those of the first and of the second engine.
STEP = "run string, page string, step string, request_id string, engine string, kind string, words string, text string, error string, retryable boolean, stage string, exception string, cancelled boolean, status string, at timestamp"
_COLUMNS = [f.split()[0] for f in STEP.split(", ")]
_HELD = "engine string, due long, before string, words string"


def request_id(run: Column, page: Column, engine: str) -> Column:
    return F.concat_ws("/", run, page, F.lit(engine))


def events(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(run, page, kind, engine, ok, words, text, error, retryable, stage, exception, before, at) of lines (value, at).

    A line is a command {"command": "start" or "cancel", "run", "page", "before"}, before being the page's status, or a
    worker's response to a request of the loop; all else is noise, which may tell the time.  late: how far lines may come out
    of order, for the stream's watermark.
    """
    seen = stream.withWatermark("at", late) if stream.isStreaming else stream
    c, r = F.from_json("value", COMMAND), worker.parsed(F.col("value"))
    each = seen.select("at", F.when(c["command"].isin("start", "cancel"), c).alias("c"), r.alias("r"))
    # A page's name may hold slashes, the run's and the engine's do not.
    part = lambda k: F.regexp_extract(F.col("r.requestId"), r"^([^/]+)/(.+)/([^/]+)$", k)
    ok = F.col("r.status") == "ok"
    bad = lambda x: F.when(~F.coalesce(ok, F.lit(False)), x)
    words = F.coalesce(F.col("r.words"), F.array().cast(T.ArrayType(worker.WORD)))
    out = each.select(
        F.coalesce("c.run", part(1)).alias("run"), F.coalesce("c.page", part(2)).alias("page"), F.coalesce("c.command", F.when(F.col("r").isNotNull(), "answer")).alias("kind"), part(3).alias("engine"), F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(ok, F.to_json(words)).alias("words"), F.when(ok, F.array_join(F.transform(words, lambda w: F.coalesce(w["text"], F.lit(""))), "")).alias("text"),
        bad(F.coalesce("r.error", F.lit(worker.FAILED))).alias("error"), bad(F.coalesce("r.retryable", F.lit(True))).alias("retryable"), bad(F.col("r.stage")).alias("stage"), bad(F.col("r.exceptionType")).alias("exception"), F.col("c.before").alias("before"), "at",
    )
    return out.where("kind is not null and run <> '' and page <> ''")


def _ms(at: datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def _end(key: tuple, kind: str, at: datetime | None, **more: Any) -> Row:
    values = dict.fromkeys(_COLUMNS) | {"run": key[0], "page": key[1], "step": "end", "kind": kind, "cancelled": False, "at": at} | more
    return Row(**values)


def _ask(key: tuple, engine: str, at: datetime | None) -> Row:
    values = dict.fromkeys(_COLUMNS) | {"run": key[0], "page": key[1], "step": "ask", "engine": engine, "request_id": "/".join((*key, engine)), "at": at}
    return Row(**values)


class PageRun(StatefulProcessor):
    """One page of one run: waiting for an engine until its time is up, then done, which is remembered for a while."""

    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait, self.keep = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("page", _HELD)

    def _hold(self, engine: str | None, due: int, before: str | None, words: str | None) -> None:
        """engine: whom the page waits for; none once it is done."""
        if self.held.exists():
            self.handle.deleteTimer(self.held.get()[1])
        self.held.update((engine, due, before, words))
        self.handle.registerTimer(due)

    def _done(self, at: int) -> None:
        self._hold(None, at + self.keep, None, None)

    def _unanswered(self, key: tuple, engine: str, due: int, words: str | None) -> Iterator[Row]:
        self._done(due)
        kind = FAILED if engine == FIRST else REVIEW
        when = datetime.fromtimestamp(due / 1000, timezone.utc).replace(tzinfo=None)
        yield _end(key, kind, when, words=words, error=worker.UNANSWERED, retryable=True, stage=STAGES[engine], status=kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        rank = {"start": 0, "answer": 1, "cancel": 2}
        for row in sorted(rows, key=lambda r: (r["at"], rank[r["kind"]], r["engine"] or "", not r["ok"], r["words"] or r["error"] or "")):
            now = _ms(row["at"])
            engine, due, before, words = self.held.get() if self.held.exists() else (None, None, None, None)
            if engine and now > due:
                yield from self._unanswered(key, engine, due, words)
                engine, due = None, due + self.keep
            if row["kind"] == "start" and due is None:
                self._hold(FIRST, now + self.wait, row["before"], None)
                yield _ask(key, FIRST, row["at"])
            elif row["kind"] == "cancel":
                if engine:
                    yield _end(key, FAILED, row["at"], error=CANCELLED, retryable=True, stage=STAGES[engine], cancelled=True, status=before)
                if engine or due is None:
                    self._done(now)
            elif row["kind"] == "answer" and engine and row["engine"] == engine:
                problem = {"error": row["error"], "retryable": row["retryable"], "stage": row["stage"] if row["stage"] in STAGES.values() else STAGES[engine], "exception": row["exception"]}
                if engine == FIRST and row["ok"]:
                    self._hold(SECOND, now + self.wait, before, row["words"])
                    yield _ask(key, SECOND, row["at"])
                    continue
                self._done(now)
                if engine == FIRST:
                    yield _end(key, FAILED, row["at"], status=FAILED, **problem)
                elif row["ok"]:
                    yield _end(key, COMPLETED, row["at"], words=words, text=row["text"], status=COMPLETED)
                else:
                    yield _end(key, REVIEW, row["at"], words=words, status=REVIEW, **(problem | {"stage": STAGES[SECOND]}))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.held.exists():
            return
        engine, due, _, words = self.held.get()
        if due > expiredTimerInfo.getExpiryTimeInMs():
            return
        if engine:
            yield from self._unanswered(key, engine, due, words)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def steps(events_: DataFrame, wait: int = 300, keep: int = 86400) -> DataFrame:
    """STEP: what the pages of runs ask for and how each ends, from a stream of events.

    wait: seconds an engine has for an answer, by the events' times; an answer after that is late and counts for nothing.
    keep: seconds for which a page that is done is remembered, so that a start that comes again is passed over.  A page that is
    cancelled before it starts stays as it is and does not start.  State is one row a page in progress, dealt by run and page.
    """
    events_.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events_.groupBy("run", "page").transformWithState(PageRun(wait * 1000, keep * 1000), STEP, "append", "EventTime")


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, wait: int = 300, keep: int = 86400) -> StreamingQuery:
    """Starts the loop on lines (value, at); each micro-batch's steps go to write(rows, batch), which puts them in place of what it wrote under that number.

    What is there is taken, then the query ends; started again it goes on from its checkpoint with the pages in progress.
    """
    return steps(events(stream), wait, keep).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(events_: DataFrame, wait: int = 300) -> DataFrame:
    """The ends (run, page, kind, words, text, error, retryable, stage, exception, cancelled, status, at) that all events of runs give, without a stream.

    The same rules as joins of what each page has: its first start, the first answer in time of each engine, its first cancel.
    """
    key = ["run", "page"]
    due = lambda at: F.col(at) + F.make_interval(secs=F.lit(wait))
    first = lambda kind, out: events_.where(F.col("kind") == kind).groupBy(*key).agg(F.min(F.struct("at", "before")).alias(out))
    begun = first("start", "start").select(*key, F.col("start.at").alias("began"), F.col("start.before").alias("before"))
    cancel = first("cancel", "cancel").select(*key, F.col("cancel.at").alias("stopped"))
    what = F.struct("at", (~F.col("ok")).alias("bad"), F.coalesce("words", "error").alias("o"), "words", "text", "error", "retryable", "stage", "exception")
    answer = lambda engine: events_.where((F.col("kind") == "answer") & (F.col("engine") == engine)).select(*key, what.alias("a"))
    base = begun.join(cancel, key, "left").where(F.col("stopped").isNull() | (F.col("stopped") >= F.col("began")))

    def heard(pages: DataFrame, engine: str, since: str, out: str) -> DataFrame:
        """The first answer of an engine that came in time and before the cancel, to a request sent then."""
        inside = (F.col("a.at") >= F.col(since)) & (F.col("a.at") <= due(since)) & (F.col("stopped").isNull() | (F.col("a.at") <= F.col("stopped")))
        got = pages.join(answer(engine), key).where(inside).groupBy(*key).agg(F.min("a").alias(out))
        return pages.join(got, key, "left")

    one = heard(base, FIRST, "began", "p").withColumn("asked", F.when(~F.col("p.bad"), F.col("p.at")))
    both = heard(one, SECOND, "asked", "s")
    waiting = F.coalesce("asked", "began")
    over = F.coalesce(F.col("s.at"), F.when(F.col("p.bad"), F.col("p.at")))
    cancelled = over.isNull() & F.col("stopped").isNotNull() & (F.col("stopped") <= waiting + F.make_interval(secs=F.lit(wait)))
    failed = F.when(F.col("p.bad"), F.col("p")).when(F.col("s.bad"), F.col("s"))
    kind = F.when(cancelled | F.col("asked").isNull(), FAILED).when(F.coalesce(~F.col("s.bad"), F.lit(False)), COMPLETED).otherwise(REVIEW)
    stage = F.when(F.col("asked").isNotNull(), STAGES[SECOND]).when(F.col("p.stage").isin(*STAGES.values()), F.col("p.stage")).otherwise(STAGES[FIRST])
    ended = kind != COMPLETED
    out = both.withColumn("f", failed)
    return out.select(
        *key, kind.alias("kind"), F.when(~cancelled & F.col("asked").isNotNull(), F.col("p.words")).alias("words"), F.when(kind == COMPLETED, F.col("s.text")).alias("text"),
        F.when(cancelled, CANCELLED).when(ended, F.coalesce("f.error", F.lit(worker.UNANSWERED))).alias("error"), F.when(ended, F.coalesce("f.retryable", F.lit(True))).alias("retryable"), F.when(ended, stage).alias("stage"), F.when(ended & ~cancelled, F.col("f.exception")).alias("exception"),
        cancelled.alias("cancelled"), F.when(cancelled, F.col("before")).otherwise(kind).alias("status"), F.coalesce(over, F.when(cancelled, F.col("stopped")), waiting + F.make_interval(secs=F.lit(wait))).alias("at"),
    )


def _boxes(ends: DataFrame) -> DataFrame:
    words = F.from_json("words", T.ArrayType(worker.WORD))
    return ends.select("page", F.posexplode(words)).select("page", F.col("pos").cast("long").alias("id"), "col.*")


def saved(ends: DataFrame, overrides: DataFrame, was: DataFrame, at: Column) -> dict[str, writers.Tables]:
    """What the ends of pages write, by how they ended: analysis, fallback and failures, each the tables of one action.

    A completed page is read in its order and what the second engine gave is merged into it; one whose second engine failed
    keeps the first one's words and text.  overrides and was as for writers.analysis; failures carry the status to put back.
    """
    full, half = ends.where(F.col("kind") == COMPLETED), ends.where(F.col("kind") == REVIEW)
    boxes = _boxes(full)
    second = full.select("page", F.coalesce("text", F.lit("")).alias("text"))
    texts = layout.page_texts(boxes, "page")
    order = loads.raw_ordinals(boxes, "page").join(boxes.select("page", "id", "text"), ["page", "id"])
    lists = order.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("id").cast("int").alias("ordinal"), "text"))).alias("ws"))
    words = F.transform("ws", lambda w: F.struct(w["ordinal"].alias("ordinal"), w["text"].alias("text")))
    both = second.join(texts.select("page", F.col("text").alias("own")), "page", "left").join(lists, "page", "left")
    found = both.select("page", supplement.proposal(F.coalesce("own", F.lit("")), F.col("text"), words).alias("p"))
    operations = found.select("page", F.posexplode("p.operations")).select("page", F.col("pos").alias("ordinal"), "col.*")
    notes = found.select("page", F.inline(supplement.unanchored(F.col("p.operations")))).select("page", F.lit(UNANCHORED).alias("code"), F.lit(None).cast("string").alias("text"))
    failure = lambda rows: rows.select("page", "run", "stage", "exception", F.col("error").alias("message"), "retryable", "cancelled", F.when(F.col("cancelled"), F.col("status")).alias("before"), "at")
    less = _boxes(half)
    return {
        "analysis": writers.analysis(boxes, second, found.select("page", F.col("p.suggested").alias("text")), operations, notes, overrides, was, at),
        "fallback": writers.fallback(less, layout.page_texts(less, "page"), failure(half).drop("cancelled"), overrides, at),
        "failures": {"failures": failure(ends.where(F.col("kind") == FAILED))},
    }
