"""The loop of a run: late, missing, failing and cancelled requests, restarts, and the same rules without a stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from folioforge.sources import worker
from folioforge.streaming import loop, runs

T0 = 1_700_000_000


def command(what, page, run="r", before="NotProcessed"):
    return json.dumps({"command": what, "run": run, "page": page, "before": before})


def answer(page, engine, text=None, run="r", **problem):
    words = None if text is None else [{"text": text, "confidence": 0.9, "left": 0, "top": 0, "right": 1, "bottom": 1}]
    return json.dumps({"protocolVersion": 1, "requestId": f"{run}/{page}/{engine}", "status": "error" if problem else "ok", **({"words": words} if words else {}), **problem})


class Run:
    """A folder of lines, each file with its time, and what the loop has written for each batch."""

    def __init__(self, spark, tmp):
        self.spark, self.tmp, self.n, self.done, self.broken = spark, tmp, 0, {}, set()
        (tmp / "in").mkdir()

    def put(self, at, *lines):
        self.n += 1
        path = self.tmp / "in" / f"{self.n:04}.jsonl"
        path.write_text("\n".join(lines))
        os.utime(path, (T0 + at, T0 + at))

    def go(self):
        def write(rows, batch):
            found = [r.asDict() for r in rows.collect()]
            if batch in self.broken:
                self.broken.discard(batch)
                raise OSError("the sink is away")
            self.done[batch] = found

        q = loop.run(runs.lines(self.spark, f"file://{self.tmp}/in", files_at_once=1), write, f"file://{self.tmp}/checkpoint", wait=60, keep=3600)
        try:
            q.awaitTermination(300)
        except Exception as e:
            return str(e)
        return None

    def steps(self, step):
        return [r for batch in sorted(self.done) for r in self.done[batch] if r["step"] == step]


def test_each_page_ends_once_whatever_happens(spark, tmp_path):
    run = Run(spark, tmp_path)
    pages = ["good", "late", "missing", "failing", "second/fails", "second-missing", "cancelled", "early"]
    run.put(0, *(command("start", p, before="Completed") for p in pages if p != "early"), command("cancel", "early"), "noise", "[1]")
    run.put(10, command("start", "early"), answer("good", "paddle", "甲"), answer("failing", "paddle", error="no model", stage="PaddleOCR", retryable=False, exceptionType="ModelError"), answer("second/fails", "paddle", "乙"), answer("second-missing", "paddle", "丙"))
    assert run.go() is None
    asked = sorted((r["page"], r["engine"]) for r in run.steps("ask"))
    assert asked == sorted([(p, "paddle") for p in pages if p != "early"] + [(p, "tesseract") for p in ("good", "second/fails", "second-missing")])
    assert [(r["page"], r["kind"], r["stage"], r["retryable"], r["exception"]) for r in run.steps("end")] == [("failing", "Failed", "PaddleOCR", False, "ModelError")]

    run.put(20, answer("good", "paddle", "again"), answer("good", "tesseract", "甲。"), answer("second/fails", "tesseract", error="crash"), command("cancel", "cancelled"), command("cancel", "good"))
    run.put(70, answer("late", "paddle", "too late"), command("start", "good"), command("start", "missing"))
    run.put(200, "only the time")
    last = max(run.done)
    run.broken = {last + 1}
    assert "the sink is away" in run.go()
    assert run.go() is None  # started again half-way
    run.put(300, answer("missing", "paddle", "far too late"), answer("second-missing", "tesseract", "far too late"), command("start", "failing"))
    run.put(400, "only the time")
    assert run.go() is None

    ends = {r["page"]: r for r in run.steps("end")}
    assert len(run.steps("end")) == len(ends) == 7
    assert len(run.steps("ask")) == 10
    short = {p: (r["kind"], r["error"], r["stage"], r["cancelled"], r["status"]) for p, r in ends.items()}
    assert short == {
        "good": ("Completed", None, None, False, "Completed"), "late": ("Failed", worker.UNANSWERED, "PaddleOCR", False, "Failed"), "missing": ("Failed", worker.UNANSWERED, "PaddleOCR", False, "Failed"),
        "failing": ("Failed", "no model", "PaddleOCR", False, "Failed"), "second/fails": ("ReviewRequired", "crash", "Tesseract", False, "ReviewRequired"),
        "second-missing": ("ReviewRequired", worker.UNANSWERED, "Tesseract", False, "ReviewRequired"), "cancelled": ("Failed", loop.CANCELLED, "PaddleOCR", True, "Completed"),
    }
    assert json.loads(ends["good"]["words"])[0]["text"] == "甲" and ends["good"]["text"] == "甲。"
    assert json.loads(ends["second-missing"]["words"])[0]["text"] == "丙"


def random_lines(seed):
    """Runs of pages whose commands and answers come in any order, at most one file for each second."""
    rng, out = random.Random(seed), []
    for p in range(60):
        page, t = f"p{p}", rng.randint(0, 100)
        lines = [(t, command("start", page, before=rng.choice(["NotProcessed", "Completed"])))]
        for engine in ("paddle", "tesseract"):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                t += rng.choice([0, 5, 30, 60, 61])
                lines.append((t, answer(page, engine, page) if rng.random() < 0.7 else answer(page, engine, error="bad", stage=rng.choice(["PaddleOCR", "Other"]))))
        if rng.random() < 0.4:
            lines.append((rng.randint(0, 200), command("cancel", page)))
        if rng.random() < 0.2:
            lines.append((rng.randint(0, 200), command("start", page)))
        out += lines
    return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_a_stream_ends_as_a_replay_does(spark, tmp_path, seed):
    run, lines = Run(spark, tmp_path), random_lines(seed)
    for at in range(0, 500, 25):
        for k in sorted({t for t, _ in lines if at <= t < at + 25}):
            run.put(k, *(v for t, v in lines if t == k))
    run.put(2000, "only the time")
    # A few files a batch, in the order of their times.
    done = {}
    q = loop.run(runs.lines(spark, f"file://{tmp_path}/in", files_at_once=9), lambda rows, batch: done.update({batch: rows.collect()}), f"file://{tmp_path}/checkpoint", wait=60)
    assert q.awaitTermination(300)
    got = [r for rows in done.values() for r in rows if r.step == "end"]
    batch = spark.createDataFrame([(v, T0 + t) for t, v in lines], "value string, t long").select("value", F.timestamp_seconds("t").alias("at"))
    want = loop.replayed(loop.events(batch), wait=60).collect()
    names = ["page", "kind", "words", "text", "error", "retryable", "stage", "exception", "cancelled", "status", "at"]
    pick = lambda rows: sorted(tuple(str(r[c]) for c in names) for r in rows)
    assert len(got) == len({r.page for r in got}) > 40
    assert pick(got) == pick(want)


def test_a_replay_of_nothing(spark):
    none = spark.createDataFrame([], "value string, at timestamp")
    assert loop.replayed(loop.events(none)).count() == 0


def test_what_ends_write(spark):
    """A completed page is merged, one whose second engine failed keeps the first one's text, a cancelled one gets its status back."""
    from folioforge.operators import transitions

    box = lambda text, x, y: {"text": text, "confidence": 0.9, "left": x, "top": y, "right": x + 8, "bottom": y + 12}
    words = json.dumps([box("ロ", 80, 10), box("カ", 80, 30), box("ル", 80, 50)], ensure_ascii=False)
    ends = spark.createDataFrame(
        [("r", "a", "Completed", words, "ローカル", None, None, False, "Completed"), ("r", "b", "ReviewRequired", words, None, "crash", "Tesseract", False, "ReviewRequired"), ("r", "c", "Failed", None, None, loop.CANCELLED, "PaddleOCR", True, "Completed"), ("r", "d", "Failed", None, None, "x", "PaddleOCR", False, "Failed")],
        "run string, page string, kind string, words string, text string, error string, stage string, cancelled boolean, status string",
    ).withColumns({"exception": F.lit(None).cast("string"), "retryable": F.lit(True), "at": F.timestamp_seconds(F.lit(T0))})
    none = spark.createDataFrame([], "page string, word_key string, role string, included boolean")
    was = spark.createDataFrame([(p, "Processing") for p in "abcd"], "page string, status string")
    out = loop.saved(ends, none, was, F.lit("now"))
    assert sorted(out) == ["analysis", "failures", "fallback"]
    assert [(r.page, r.text) for r in out["analysis"]["proposals"].collect()] == [("a", "ローカル")]
    assert [(r.page, r.ordinal, r.type, r.proposed, r.anchor) for r in out["analysis"]["operations"].collect()] == [("a", 0, "Insertion", "ー", 1)]
    assert [(r.page, r.ocr_status) for r in out["analysis"]["pages"].collect()] == [("a", "Completed")]
    assert [(r.page, r.text) for r in out["fallback"]["proposals"].collect()] == [("b", "ロカル")]
    assert [(r.page, r.message, r.cancelled) for r in out["fallback"]["failures"].collect()] == [("b", "crash", False)]
    failures = out["failures"]["failures"].withColumn("seq", F.lit(0))
    now = transitions.failed(was, failures, spark.createDataFrame([], "page string"), spark.createDataFrame([], "page string, source string"))
    assert {r.page: r.status for r in now.collect()} == {"a": "Processing", "b": "Processing", "c": "Completed", "d": "Failed"}
