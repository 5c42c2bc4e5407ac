"""Transitions, writers, the worker protocol and the stream of a run, on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import gate, layout, loads, transitions, writers
from folioforge.sources import worker
from folioforge.streaming import runs


def test_later_confirmations_win(spark):
    rows = [(1, 1, 1, 0, 4, "Confirmed"), (2, 1, 1, 2, 4, "Proposed"), (3, 1, 1, 5, 2, "Proposed"), (4, 1, 2, 0, 9, "Confirmed"), (5, 2, 1, 0, 9, "Confirmed"), (6, 1, 1, 6, 1, "Rejected")]
    a = spark.createDataFrame(rows, "id int, batch int, paragraph int, start int, length int, status string")
    snapshots = spark.createDataFrame([(1, 1), (2, 2)], "batch int, snapshot int")
    for places, want in (({2: 1, 3: 2}, {1: "Stale", 2: "Stale", 3: "Confirmed"}), ({2: 2, 3: 1}, {1: "Stale", 2: "Confirmed", 3: "Stale"}), ({1: 1}, {1: "Confirmed", 2: "Proposed", 3: "Proposed"})):
        out, history = transitions.confirmed_in_order(a, spark.createDataFrame(list(places.items()), "id int, place int"), snapshots)
        got = {r.id: r.status for r in out.collect()}
        assert got == {**want, 4: "Confirmed", 5: "Confirmed", 6: "Rejected"}
        assert {r.id: r.status for r in history.collect()} == {i: "Confirmed" for i, s in want.items() if s == "Stale"}


def test_saving_a_review_writes_history_only_for_changes(spark):
    a = spark.createDataFrame([(1, 1, 1, 0, 2, "Proposed", "x"), (2, 1, 1, 9, 2, "Proposed", "y")], "id int, batch int, paragraph int, start int, length int, status string, reading string")
    saved = spark.createDataFrame([(1, 1, "Proposed", "x"), (2, 2, "Confirmed", "z"), (7, 3, "Confirmed", "q")], "id int, place int, status string, reading string")
    out, history, unknown = transitions.reviewed(a, saved, spark.createDataFrame([(1, 1)], "batch int, snapshot int"), ["status", "reading"])
    assert sorted((r.id, r.status, r.reading) for r in out.collect()) == [(1, "Proposed", "x"), (2, "Confirmed", "z")]
    assert [(r.id, r.status, r.reading) for r in history.collect()] == [(2, "Proposed", "y")]
    assert [r.id for r in unknown.collect()] == [7]


def test_a_version_of_another_kind_is_refused(spark):
    versions = spark.createDataFrame([(1, "Manual", "a", 1), (1, "Manual", "b", 2)], "page int, kind string, text string, seq int")
    wanted = spark.createDataFrame([(1, "Manual", "a"), (2, "Suggested", "x"), (3, None, "x")], "page int, kind string, text string")
    out = transitions.restored_versions(wanted, versions, spark.createDataFrame([(1, "b")], "page int, text string"), F.lit(0))
    assert [(r.page, r.text) for r in out.manual.collect()] == [(1, "a")]
    assert [r.source for r in out.versions.collect()] == ["HistoryRestore"]
    assert [r.page for r in out.changed.collect()] == [1]
    assert sorted(r.page for r in out.refused.collect()) == [2, 3]


def test_taking_pages_is_all_or_nothing(spark):
    rows = spark.createDataFrame([(1, "0001", 11, "a", "b", "SpaceJoin"), (1, "0002", 12, "a", "a", "SpaceJoin"), (2, "0001", 21, "a", "b", "SpaceJoin")], "batch int, marker string, page int, text string, baseline string, join string")
    issues = spark.createDataFrame([(1, "0002", "PageExcluded"), (2, None, "ProjectMismatch"), (1, "0001", "CropChanged")], "batch int, marker string, code string")
    judged = gate.judged(rows, issues)
    assert sorted((r.page, r.acceptable, r.flagged) for r in judged.collect()) == [(11, True, True), (12, False, True), (21, True, False)]
    joins = spark.createDataFrame([(11, "SpaceJoin"), (12, "X")], "page int, join string")
    every = rows.select("batch", "marker")
    out = gate.taken(judged, issues, every, joins)
    assert out.versions.count() == 0
    assert sorted((r.batch, r.why) for r in out.refused.collect()) == [(1, "PageError"), (2, "FileError")]
    out = gate.taken(judged, issues, every.where("marker = '0001'"), joins)
    assert [r.page for r in out.versions.collect()] == [11]
    assert out.joins_changed.count() == 0


def test_snapshots_are_written_once_and_published_last(spark):
    documents = spark.createDataFrame([(1, "h", "s"), (1, "h", "t")], "project int, hash string, source string")
    paragraphs = spark.createDataFrame([(1, "h", 0, "x")], "project int, hash string, ordinal int, plain_text string")
    none = spark.createDataFrame([], "project int, hash string, id string, created int")
    out = writers.snapshot(documents, paragraphs, paragraphs.drop("plain_text"), none, F.lit(1))
    new = out["snapshots"].collect()
    assert [(r.project, r.hash, r.source) for r in new] == [(1, "h", "s")]
    known = spark.createDataFrame([(1, "h", new[0].id, 1)], "project int, hash string, id string, created int")
    again = writers.snapshot(documents, paragraphs, paragraphs.drop("plain_text"), known, F.lit(2))
    assert [again[t].count() for t in ("snapshots", "paragraphs", "spans")] == [0, 0, 0]
    assert [r.snapshot for r in again["ids"].collect()] == [new[0].id]
    order = []
    writers.published(out, lambda name, rows: order.append(name))
    assert order.index("snapshots") > max(order.index("paragraphs"), order.index("spans"))


def test_words_set_by_hand_rebuild_the_draft(spark):
    words = spark.createDataFrame([(1, 0, "上", 0.9, 50.0, 0.0, 60.0, 10.0), (1, 1, "下", 0.9, 50.0, 12.0, 60.0, 22.0), (2, 0, "右", 0.1, 50.0, 0.0, 60.0, 10.0)], "page int, id long, text string, confidence double, left double, top double, right double, bottom double")
    from folioforge.functions import text as tx

    by_hand = words.where("id = 1").select("page", tx.word_key(F.col("text"), [F.col(c) for c in ("left", "top", "right", "bottom")]).alias("word_key"), F.lit("RubyCandidate").alias("role"), F.lit(False).alias("included"))
    texts = spark.createDataFrame([(1, "上下。"), (2, "右。")], "page int, text string")
    none = spark.createDataFrame([], "page int, ordinal int, code string, text string")
    out = writers.analysis(words, texts, texts, none, none, by_hand, spark.createDataFrame([(1, "Draft"), (2, "Confirmed")], "page int, status string"), F.lit(0))
    assert {r.page: r.text for r in out["proposals"].collect()} == {1: "上", 2: "右。"}
    assert {(r.page, r.code, r.source) for r in out["reviews"].collect()} == {(1, "RubyCandidate", "Ruby"), (2, "LowConfidence", "OCR")}
    assert {r.page: (r.ocr_status, r.status) for r in out["pages"].collect()} == {1: ("ReviewRequired", "ReviewRequired"), 2: ("ReviewRequired", "Stale")}
    assert out["runs"].count() == 4


def test_equal_words_at_one_place_are_two(spark):
    words = spark.createDataFrame([(1, 7, "字", 5.0, 0.0, 9.0, 9.0), (1, 3, "字", 5.0, 0.0, 9.0, 9.0), (1, 5, "左", 0.0, 0.0, 4.0, 9.0)], "page int, id long, text string, left double, top double, right double, bottom double")
    assert [(r.place, r.id) for r in loads.raw_ordinals(words, "page", 2.0).orderBy("place").collect()] == [(0, 3), (1, 7), (2, 5)]
    assert layout.reading_order(spark.createDataFrame([(1, i, float(-i), 0.0) for i in range(50)], "page int, id long, x double, y double"), "page", 4.0).agg(F.max("column")).first()[0] == 9


def test_a_worker_line_that_is_noise(spark):
    lines = spark.createDataFrame([(0, "starting"), (1, "[1]"), (2, json.dumps({"protocolVersion": 1, "status": "ok"})), (3, json.dumps({"protocolVersion": 1, "requestId": "a", "status": "ok", "words": [{"text": "x", "confidence": 1, "left": 0, "top": 0, "right": 1, "bottom": 1}]}))], "place int, value string")
    got = {r.request_id: r for r in worker.responses(lines, spark.createDataFrame([("a", "mock"), ("b", "paddle")], "request_id string, engine string")).collect()}
    assert (got["a"].ok, got["a"].engine, got["a"].model_version, [w.text for w in got["a"].words]) == (True, "mock", "unknown", ["x"])
    assert (got["b"].ok, got["b"].error, got["b"].stage, got["b"].retryable) == (False, worker.UNANSWERED, "paddle", True)


def test_a_run_as_a_stream_commits_each_page_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda i, status="ok", **more: json.dumps({"protocolVersion": 1, "requestId": i, "status": status, **more})
    (folder / "a.jsonl").write_text("\n".join(["noise", line("p1"), line("p2", "error", error="broken", retryable=False), line("p1")]))
    done = {}

    def write(rows, batch):
        done[batch] = sorted((r.request_id, r.kind, r.error, r.retryable) for r in rows.collect())

    def run():
        q = runs.recorded(runs.answers(runs.lines(spark, f"file://{folder}")), write, f"file://{tmp_path}/checkpoint")
        assert q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r for rows in done.values() for r in rows)

    first = [("p1", "Completed", None, None), ("p2", "Failed", "broken", False)]
    assert run() == first
    (folder / "b.jsonl").write_text("\n".join([line("p3"), line("p2")]))
    assert run() == [*first, ("p3", "Completed", None, None)]
    assert run() == [*first, ("p3", "Completed", None, None)]


@pytest.mark.parametrize(("half", "offset", "want"), [(10, 3, 16), (10, -5, 0), (2**31 - 1, 1, None)])
def test_raise(spark, half, offset, want):
    assert spark.range(1).select(loads.raise_half_points(F.lit(half), F.lit(offset)).alias("r")).first().r == want


def test_document_path():
    assert loads.document_path("/books/", "one") == "/books/one/one.docx"


def test_a_word_document_is_whole_before_it_takes_its_place(spark, tmp_path):
    from folioforge.functions import word
    from folioforge.operators import packages

    rows = [(1, 0, "ChapterTitle", [("第一章", None)]), (1, 1, "BodyParagraph", [("a<b & ", None), ("漢字", "かんじ"), ("\x02。", None)]), (1, 2, "SceneBreak", [("※", None)])]
    d = spark.createDataFrame(rows, "book int, ord int, role string, inlines array<struct<text:string,reading:string>>")
    archive = bytes(packages.zipped(word.parts(d, "book", "ord", word.WordOptions(break_before_chapters=True))).first().content)
    assert word.problems(archive) == []
    assert word.problems(b"x") == ["no archive"]
    bare = bytes(packages.zipped(word.parts(d, "book", "ord").where("path <> 'word/styles.xml'")).first().content)
    assert word.problems(bare) == ["word/styles.xml is missing"]
    target = f"file://{tmp_path}/new/one.docx"
    packages.replace_file(target, archive, word.problems)
    with pytest.raises(ValueError, match=r"styles\.xml"):
        packages.replace_file(target, bare, word.problems)
    packages.replace_file(target, archive + b"", word.problems)
    assert [p.name for p in (tmp_path / "new").iterdir()] == ["one.docx"]
    assert (tmp_path / "new" / "one.docx").read_bytes() == archive
    assert [word.offset_of(x) for x in ("3", " 20 ", "21", "-1", "x", None)] == [3, 20, None, None, None, None]
    with pytest.raises(ValueError, match="offset"):
        word.WordOptions(offset_points=21)


def test_migrating_twice_changes_nothing(spark):
    from folioforge.sources import migrations

    pages = spark.createDataFrame([(1, 2, 0.5), (2, 0, 0.1)], "id int, review_item_count int, crop_left double")
    none = spark.createDataFrame([], "page_id int, code string, source string, text string")
    out = migrations.migrated({"pages": pages, "review_items": none}, 0)
    again = migrations.migrated(out, 0)
    assert out["pages"].collect() == again["pages"].collect()
    assert [r.crop_left for r in out["pages"].orderBy("id").collect()] == [0.5, 0.1]
    assert [(r.page_id, r.code) for r in again["review_items"].collect()] == [(1, "LegacyReviewCount")]
    with pytest.raises(ValueError, match="newer"):
        migrations.migrated({}, migrations.VERSION + 1)
