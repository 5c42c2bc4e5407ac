"""Supplements, photograph times, annotations, rendering, page edits and packages against literal cases."""

import datetime as dt
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import exif, markers, supplement
from folioforge.functions import text as tx
from folioforge.operators import annotations, layout, packages, pages, render
from folioforge.plans import books, registry


@pytest.mark.parametrize(
    ("first", "second", "want"),
    [
        ("", "あ", ""), ("あいう", "", "あいう"), ("猫は窓で眠る", "猫は、窓で眠る。", "猫は、窓で眠る。"), ("猫は窓で眠る", "犬は、庭で走る。", "猫は窓で眠る"), ("猫が待てと言った", "「猫が待てと言った」", "「猫が待てと言った」"),
        ("タワ", "タワー", "タワ"), ("町のタワの上まで", "町のタワーの上まで", "町のタワーの上まで"), ("駅前の店が才プンした", "駅前の店がオープンした", "駅前の店がオープンした"), ("言葉[は", "言葉[は", "言葉「[は"),
        ("川の名は「「長い川」だった", "川の名は「「長い川」だった", "川の名は「長い川」だった"), ("「花を植えよう」」の札", "「花を植えよう」」の札", "「花を植えよう」の札"), ("あ" * 2100, "あ、" + "あ" * 2100, "あ" * 2100),
    ],
)
def test_merge(first, second, want):
    assert supplement.merge(first, second) == want


def test_proposal():
    text, ops = supplement.propose("猫は窓で眠る", "猫は、窓で眠る。", [(4, "猫は"), (2, "窓で眠る")])
    assert text == "猫は、窓で眠る。"
    assert [(o[0], o[1], o[3], o[4], o[6]) for o in ops] == [("Insertion", 2, "、", 2, "AuxiliarySupplement"), ("Insertion", 7, "。", 2, "AuxiliarySupplement")]
    assert supplement.propose("猫", "犬", []) == ("猫", [("Insertion", 0, "", "犬", None, 0.0, "UnanchoredSuggestion")])
    assert supplement.propose("猫", " ", []) == ("猫", [])
    assert supplement.propose("駅前の店が才プンした", "駅前の店がオープンした", [])[1][0][:4] == ("Replacement", 5, "才", "オー")


def _photo(order: str, tags: list[tuple[int, bytes]]) -> bytes:
    entries, values, base = b"", b"", 26 + 2 + 12 * len(tags) + 4
    for tag, value in tags:
        entries += struct.pack(order + "HHII", tag, 2, len(value), base + len(values))
        values += value
    block = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + struct.pack(order + "HHHIII", 1, 0x8769, 4, 1, 26, 0) + struct.pack(order + "H", len(tags)) + entries + bytes(4) + values
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_photograph_time(order):
    early, late = b"2024:02:03 04:05:06\0", b"2025:02:03 04:05:06\0"
    assert exif.taken(_photo(order, [(0x9004, late), (0x9003, early)])) == dt.datetime(2024, 2, 3, 4, 5, 6)
    assert exif.taken(_photo(order, [(0x9004, late)])) == dt.datetime(2025, 2, 3, 4, 5, 6)
    assert exif.taken(_photo(order, [(0x9003, b"2024:99:03 04:05:06\0")])) is None
    whole = _photo(order, [(0x9003, early)])
    assert [exif.taken(x) for x in (b"", b"\x89PNG", whole[:60], whole.replace(b"II", b"XX").replace(b"MM", b"XX"))] == [None] * 4


def test_photograph_zone(spark):
    d = spark.createDataFrame([(_photo("<", [(0x9003, b"2024:02:03 04:05:06\0")]),), (b"x",), (None,)], "c binary")
    got = [r.t for r in d.select(exif.taken_at(F.col("c"), "Asia/Tokyo").cast("string").alias("t")).collect()]
    assert got == ["2024-02-02 19:05:06", None, None]


def _proposed(spark, rows):
    keys = "batch int, pos int, paragraph_id string, start int, length int, base_text string, reading string, reading_key string, source string, confidence double, evidence string, markers array<string>, status string"
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], keys)


def _found(spark, rows, candidates=(), policy="SuggestDifficultReadings", text="a𠮷本文字"):
    p = spark.createDataFrame([("P1", text, None, [("0001", 0, 3), ("0002", 3, 9)])], "paragraph_id string, plain_text string, text_hash string, spans array<struct<page_marker:string,start:int,length:int>>").withColumn("text_hash", tx.text_hash(F.col("plain_text")))
    m = spark.createDataFrame([(1, "0001"), (1, "0002")], "batch int, page_marker string")
    c = spark.createDataFrame([(1, *x) for x in candidates], "batch int, page_marker string, reading_key string, base_text_candidate string, returned_to_body boolean, confidence double, link_confidence double")
    rows = _proposed(spark, rows)
    out = annotations.annotation_issues(rows, p, m, c, F.lit(policy))
    return rows, out, sorted((r.pos, r.code) for r in out.collect())


GOOD = ("p1", 3, 2, "本文", "ほんぶん", "ほんぶん", "TextConfirmed", 0.9, "seen", ["0002"], "Proposed")


def _but(**changes):
    names = ("paragraph_id", "start", "length", "base_text", "reading", "reading_key", "source", "confidence", "evidence", "markers", "status")
    return tuple((dict(zip(names, GOOD, strict=True)) | changes).values())


def test_annotation_rules(spark):
    rows, out, got = _found(spark, [GOOD])
    assert got == []
    assert annotations.confirmable(rows, out, "TextConfirmed").count() == 1
    assert _found(spark, [])[2] == []
    cases = [
        (_but(paragraph_id="none"), {"ParagraphId"}), (_but(paragraph_id=None), {"ParagraphId"}), (_but(start=-1), {"Start"}), (_but(length=0), {"Length"}), (_but(length=9), {"Range"}), (_but(base_text="文"), {"BaseText"}), (_but(start=2, base_text="本"), {"BaseText", "Utf16Range"}),
        (_but(reading="　", reading_key=""), {"Reading"}), (_but(evidence=None), {"Evidence"}), (_but(markers=None), {"EvidencePageMarkers"}), (_but(markers=[]), {"EvidencePageMarkers"}), (_but(markers=["0002", "0002"]), {"EvidencePageMarkersUnique"}),
        (_but(markers=["0007"]), {"EvidencePage"}), (_but(confidence=1.5), {"Confidence"}), (_but(confidence=0.5), {"LowConfidence"}), (_but(source="Other"), {"Source", "RubyPolicy"}), (_but(source="ContextSuggested"), {"SuggestedReading"}), (_but(reading_key="hon"), {"NonKanaReading"}),
    ]
    for row, want in cases:
        assert {c for _, c in _found(spark, [row])[2]} == want
    assert _found(spark, [_but(source="DictionarySuggested")], policy="PreserveOriginalOnly")[2] == [(0, "RubyPolicy"), (0, "SuggestedReading")]
    assert _found(spark, [GOOD, GOOD])[2] == [(1, "Duplicate"), (1, "Overlap")]
    assert _found(spark, [GOOD, _but(start=4, length=2, base_text="文字", paragraph_id="P1")])[2] == [(1, "Overlap")]
    assert _found(spark, [GOOD, _but(start=5, length=1, base_text="本文")])[2] == [(1, "BaseText")]


def _joined(df):
    """Runs df: the most rows that one of its joins made."""
    df.collect()

    def walk(p):
        inner = [p.executedPlan()] if p.nodeName().startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        rows = p.metrics().get("numOutputRows")
        return max([rows.get().value() if "Join" in p.nodeName() and rows.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["annotation_issues", "bulk_confirmable", "revalidated_import", "confirmation_summary"])
def test_proposals_of_one_reading_make_no_pairs(spark, tmp_path, name):
    """6,000 annotations, most by image, of which 90 candidates each share batch and reading."""
    n = 6000
    spark.range(n).selectExpr("id AS event_id", "if(id % 3 = 0, 'view', 'purchase') AS event_type", "30D AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(211).selectExpr("id AS doc_id", "'some words of a text' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert 0 < _joined(registry.queries()[name](spark, str(tmp_path))) <= 12 * n


def _shuffled(df):
    """Runs df: the rows that its exchanges dealt out."""
    df.collect()

    def walk(p):
        inner = [p.executedPlan()] if p.nodeName().startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        rows = p.metrics().get("shuffleRecordsWritten")
        return (rows.get().value() if rows.isDefined() else 0) + sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["revalidated_import", "confirmation_summary"])
def test_proposals_that_are_alike_are_judged_once(spark, tmp_path, name):
    """6,000 annotations of twenty kinds: what all of a kind share is not dealt out for each of them, nor are their issues."""
    n, period = 6000, 8 * 9 * 25 * 17 * 19 * 23 * 211
    spark.range(n).selectExpr(f"id % 20 + {period} * (id div 20) AS event_id", "if(id % 20 % 3 = 0, 'view', 'purchase') AS event_type", "30D AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(211).selectExpr("id AS doc_id", "'some words of a text' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert 0 < _shuffled(registry.queries()[name](spark, str(tmp_path))) <= 2 * n


def test_evidence_lines_are_made_once_for_a_candidate(spark):
    plan = registry.queries()["evidence_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" in plan
    assert "format_string" not in plan[: plan.index("Join")]


def test_image_candidates(spark):
    image = _but(source="ImageConfirmed")
    code = lambda *c, row=image: [x for _, x in _found(spark, [row], c)[2]]
    assert code() == ["ImageCandidateMismatch"]
    assert code(("0002", "ほん", "本文", False, 0.9, 0.9)) == ["ImageCandidateMismatch"]
    assert code(("0002", "ほんぶん", None, False, 0.9, 0.9)) == ["BaseTextCandidateUnknown"]
    assert code(("0002", "ほんぶん", "本", False, 0.9, 0.9)) == ["ImageCandidateMismatch"]
    assert code(("0002", "ほんぶん", "本文", True, 0.9, 0.9)) == ["WrongSideCandidate"]
    assert code(("0002", "ほんぶん", "本文", False, 0.6, 0.9)) == ["LowOcrCandidateConfidence"]
    assert code(("0002", "ほんぶん", "本文", False, 0.9, None)) == ["LowLinkConfidence"]
    assert code(("0002", "ほんぶん", "本文", False, 0.9, 0.5), ("0002", "ほんぶん", "本文", False, 0.9, 0.6)) == []
    assert code(("0001", "ほんぶん", "本文", False, 0.9, 0.9), row=_but(source="ImageConfirmed", markers=["0001"])) == ["EvidencePageDoesNotMatchSourceSpan", "ImageCandidateMismatch"]


def test_headers(spark):
    f = spark.createDataFrame([(1, 1, "p", "b", "h", [1], [1]), (2, 2, "q", "c", None, None, None)], "k int, format_version int, project_id string, batch_id string, document_hash string, annotations array<int>, unresolved array<int>")
    w = spark.createDataFrame([(1, "p", "b", "h", False), (2, "p", "b", "h", True)], "k int, project_id string, batch_id string, document_hash string, stale boolean")
    got = sorted((r.k, r.code) for r in annotations.header_issues(f, w, "k").collect())
    assert got == [(2, c) for c in sorted(("FormatVersion", "ProjectId", "BatchId", "DocumentTextHash", "ConfirmedTextStale", "Annotations", "Unresolved"))]


def test_unresolved(spark):
    u = spark.createDataFrame([(1, 0, "P1", 0, 1, "a", " ", ["0001"]), (1, 1, "P1", 0, 1, "a", "why", None), (1, 2, "P1", 0, 1, "a", "why", ["0005"])], "batch int, pos int, paragraph_id string, start int, length int, base_text string, reason string, markers array<string>")
    p = spark.createDataFrame([("p1", "abc", [("0001", 0, 3)])], "paragraph_id string, plain_text string, spans array<struct<page_marker:string,start:int,length:int>>").withColumn("text_hash", tx.text_hash(F.col("plain_text")))
    m = spark.createDataFrame([(1, "0001")], "batch int, page_marker string")
    assert sorted((r.pos, r.code) for r in annotations.unresolved_issues(u, p, m).collect()) == [(0, "UnresolvedReason"), (1, "EvidencePageMarkers"), (2, "EvidencePage")]


def test_issue_matches(spark):
    rows = [("a", "A", "P", 1, 2, 9), ("a", None, "P", 1, 2, 9), (None, None, "P", 1, 2, 1), (None, None, "P", 1, 3, 1), ("a", "a", "x", 0, 0, 0)]
    d = spark.createDataFrame(rows, "i string, r string, p string, s int, l int, z int")
    issue = F.struct(F.col("i").alias("annotation_id"), F.lit("p").alias("paragraph_id"), F.lit(1).alias("start"), F.lit(2).alias("length")).alias("i")
    row = F.struct(F.col("r").alias("annotation_id"), F.col("p").alias("paragraph_id"), F.col("s").alias("start"), F.col("l").alias("length")).alias("r")
    assert [x.m for x in d.select(issue, row).select(annotations.issue_matches("i", "r").alias("m")).collect()] == [False, False, True, False, True]


def _inlines(spark, marks, text="𠮷本の文字"):
    p = spark.createDataFrame([(1, text, "BodyParagraph")], "id int, plain_text string, role string")
    a = spark.createDataFrame([(1, *m) for m in marks], "id int, start int, length int, base_text string, reading string, status string")
    return render.compose(p, a, ["id"])


def test_compose(spark):
    got = _inlines(spark, [(4, 2, "文字", "もじ", "Confirmed"), (0, 2, "𠮷", "よし", "Confirmed"), (2, 1, "x", "x", "Proposed")])
    assert [(x.text, x.reading) for x in got.first().inlines] == [("𠮷", "よし"), ("本の", None), ("文字", "もじ")]
    assert got.select(render.paragraph_markdown(F.col("role"), F.col("inlines")).alias("m")).first().m == "{𠮷|よし}本の{文字|もじ}\n\n"
    assert [(x.text, x.reading) for x in _inlines(spark, []).first().inlines] == [("𠮷本の文字", None)]
    assert _inlines(spark, [], "").first().inlines == []
    for bad in ([(4, 2, "文", "x", "Confirmed")], [(2, 2, "本の", "x", "Confirmed"), (3, 2, "の文", "y", "Confirmed")], [(4, 9, "文字", "x", "Confirmed")]):
        with pytest.raises(Exception, match="must not overlap"):
            _inlines(spark, bad).collect()


def test_escapes(spark):
    one = lambda value, e: spark.createDataFrame([(value,)], "c string").select(e.alias("r")).first().r
    c = F.col("c")
    cases = {"# a": "\\# a", "*a": "\\\\*a", "1. a": "1&#46; a", "1.a": "1.a", "    a": "&#32;&#32;&#32;&#32;a", "\ta": "&#9;a", "a<b>&{c}|[d]!_`": "a&lt;b&gt;&amp;\\{c\\}\\|\\[d\\]\\!\\_\\`", "-": "\\-", "": ""}
    for text, want in cases.items():
        assert one(text, tx.markdown_escape(c)) == want
    for text in ('a"b\\c', "l\r\n\tx", "\x01\x85é", ""):
        assert one(text, tx.yaml_quote(c)) == render.yaml_scalar(text)
    assert render.yaml_scalar('"\n\x01') == '"\\"\\n\\u0001"'
    assert one("f.png", render.picture_markdown(c, F.lit("a]b"), F.lit(None).cast("string"), False)) == "![a\\]b](f.png)\n\n"
    assert "<figcaption>a&lt;</figcaption>" in one("f.png", render.picture_markdown(c, F.lit("a<"), F.lit(" "), True))


def test_book_options():
    o = render.BookOptions(" T ", "C", vertical=False)
    assert o.yaml(render.yaml_scalar).splitlines()[2] == '  - content: "T"'
    assert "pageDirection: ltr" in o.yaml(render.yaml_scalar)
    assert "horizontal-tb" in o.css()
    for bad in ({"title": " "}, {"creator": ""}, {"contents_depth": 7}, {"upright_digits": 1}):
        with pytest.raises(ValueError):
            render.BookOptions(**({"title": "t", "creator": "c"} | bad))


def test_page_texts(spark):
    w = [("右", 100.0, 10.0), ("下", 100.0, 30.0), ("左", 50.0, 10.0), ("字", 10.0, 25.0), ("末", 12.0, 60.0)]
    d = spark.createDataFrame([(1, i, t, x, y, x + 20, y + 15) for i, (t, x, y) in enumerate(w)], "page int, id long, text string, left double, top double, right double, bottom double")
    assert layout.page_texts(d, "page").first().text == "右下左\n字末"


def test_chapter_page(spark):
    cases = {"": "", " \n": "", "\n一\n二": "[[CHAPTER:一]]\n二", "第一章\r\n 夜 \r\n本文\n": "[[CHAPTER:第一章]]\n[[TITLE:夜]]\n本文\n", "序章\n\n本文": "[[CHAPTER:序章]]\n\n本文", "第一章\n" + "長" * 41: "[[CHAPTER:第一章]]\n" + "長" * 41, "終章": "[[CHAPTER:終章]]"}
    got = spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("i", tx.chapter_page(F.col("c")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == list(cases.values())


def test_only_members(spark):
    cases = {'{"a":1,"b":[{"x":1},{}]}': True, '{"a":1}': True, "{}": True, '{"a":1,"c":2}': False, '{"A":1}': False, '{"b":[{"y":1}]}': False, '{"b":3}': False, "[1]": False, "x": False, "": False}
    rows = [(i, j) for i, j in enumerate([*cases, None])]
    got = spark.createDataFrame(rows, "i int, c string").select("i", tx.only_members(F.col("c"), {"b": ("x",)}, ("a", "b")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [*cases.values(), None]


def test_with_status(spark):
    p = spark.createDataFrame([("P", "a𠮷b")], "paragraph_id string, plain_text string").withColumns({"text_hash": F.lit("h"), "spans": F.array()})
    rows = [(1, 0, "p", 0, 1, "a", "x", "Proposed"), (1, 1, "P", 3, 1, "b", "x", "Confirmed"), (2, 0, "P", 0, 1, "a", " ", "Proposed"), (2, 1, "Q", 0, 1, "a", "x", "Proposed"), (2, 2, "P", 4, 1, "b", "x", "Proposed"), (2, 3, "P", 2, 1, "b", "x", "Proposed"), (2, 4, "P", 0, 1, "b", "x", "Proposed")]
    out, bad = annotations.with_status(spark.createDataFrame(rows, "batch int, pos int, paragraph_id string, start int, length int, base_text string, reading string, status string"), p, "Confirmed")
    assert [r.code for r in bad.orderBy("pos").collect()] == ["EMPTY_READING", "PARAGRAPH_NOT_FOUND", "INVALID_RANGE", "INVALID_UTF16_BOUNDARY", "BASE_TEXT_MISMATCH"]
    assert [(r.status, r.changed) for r in out.orderBy("batch", "pos").collect()] == [("Confirmed", True), ("Confirmed", False)] + [("Proposed", False)] * 5


def test_reading_aids(spark):
    w = spark.createDataFrame([(1, i, t, 0.9, float(x), 0.0, x + 9.0, 9.0) for i, (t, x) in enumerate([("a", 0), ("b", 20), ("b", 20), ("c", 40), ("a", 0)])], "page int, id long, text string, confidence double, left double, top double, right double, bottom double")
    assert [r.text for r in layout.reading_aids(w, w.where("id in (0, 3)"), "page").collect()] == ["b"]
    odd = w.limit(1).select("page", "id", F.lit(None).cast("string").alias("text"), "confidence", "left", "top", "right", "bottom")
    assert layout.reading_aids(odd, odd, "page").count() == 0


def test_words_in_doubt_of_one_place(spark, tmp_path):
    """Two thin boxes of one place and text that differ in width: one row, as in the SQL."""
    lines = [(1, 1, 5, 1, 1.0), (1, 2, 102, 1, 2.0), (1, 3, 8, 1, 7.0), (1, 4, 20, 1, 7.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.kind, r.left) for r in books.QUERIES["words_in_doubt"](spark, str(tmp_path)).collect())
    assert got == [("aid", 5.0), ("low", 5.0), ("low", 5.0), ("low", 8.0), ("low", 20.0)]


def test_page_edits(spark):
    p = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)], "book string, pos int").withColumn("id", F.col("pos"))
    m = spark.createDataFrame([("a", 1, 9), ("b", 5, 0)], "book string, source int, target int")
    assert sorted((r.book, r.id, r.pos) for r in pages.swapped(p, m, "book", "pos").collect()) == [("a", 0, 0), ("a", 1, 3), ("a", 2, 2), ("a", 3, 1), ("b", 0, 0)]
    with pytest.raises(ValueError):
        pages.rotated(F.lit(0), 45)
    crop = p.limit(1).select(pages.crop_of(F.lit(10.0), F.lit(0.0), F.lit(85.0), F.lit(0.0)).alias("c")).select(pages.crop_box(F.col("c"), F.lit(10), F.lit(3)).alias("b")).first().b
    assert tuple(crop) == (1, 0, 1, 3)


def _package(spark):
    p = spark.createDataFrame([(7, 0, "x", "A.JPG", "H", "Body", "一\n", "Manual", "一", "DirectJoin", 2), (7, 1, "y", "b", "I", "Body", "二", "Suggested", "二", "SceneBreak", 0)], "batch int, position int, page_id string, file_name string, source_hash string, role string, text string, layer string, machine_text string, join string, low_confidence int")
    r = spark.createDataFrame([(7, "y", "Low", "m", "t"), (7, "gone", "Low", "m", "t")], "batch int, page_id string, code string, message string, text string")
    return packages.proofreading_files(p, r, "00000000-0000-0000-0000-000000000001", "Correct.")


def test_proofreading_package(spark, tmp_path):
    files = {r.path: r.content for r in _package(spark).collect()}
    assert set(files) == {"manifest.json", "ocr.txt", "instructions.md", "review-items.json"}
    assert '"originalImage":"images-original/PAGE-0001.jpg"' in files["manifest.json"]
    assert '"pageMarker":"0002"' in files["review-items.json"]
    assert "gone" not in files["review-items.json"]
    assert packages.write_files(_package(spark), f"file://{tmp_path}/out") == 4
    assert (tmp_path / "out/ocr.txt").read_text() == files["ocr.txt"]
    with pytest.raises(FileExistsError):
        packages.write_files(_package(spark), f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="leaves its folder"):
        packages.write_files(_package(spark).withColumn("path", F.lit("../x")), f"file://{tmp_path}/other")
    assert [x.name for x in tmp_path.iterdir()] == ["out"]
    raw = bytes(packages.zipped(_package(spark)).first().content)
    assert zipfile.ZipFile(io.BytesIO(raw)).namelist() == sorted(files)


def test_reading_package(spark):
    p = spark.createDataFrame([(1, 0, "i", "Body", "文", [("0001", 0, 1)], "H")], "batch int, ordinal int, paragraph_id string, role string, plain_text string, spans array<struct<page_marker:string,start:int,length:int>>, document_hash string")
    m = spark.createDataFrame([(1, "0001", "x")], "batch int, page_marker string, page_id string")
    c = spark.createDataFrame([], "batch int, page_marker string, ordinal int, reading string")
    files = {r.path: r.content for r in packages.reading_files(p, m, c, "p", "SuggestDifficultReadings", "{}", "Read.").collect()}
    assert files["ruby-candidates.json"] == "[]"
    assert '"sourceSpans":[{"pageMarker":"0001","start":0,"length":1}]' in files["confirmed-document.json"]
    assert files["output-schema.json"] == "{}"


def test_returned_files(spark):
    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in files.items():
                z.writestr(n.replace("_", "."), t)
        return out.getvalue()

    d = spark.createDataFrame([("a.ZIP", archive(proofread_md="m", proofread_txt="t")), ("b.zip", archive(proofread_md="m")), ("c.zip", archive(x_txt="x")), ("d.txt", "字".encode())], "p string, c binary")
    assert [r.t for r in d.select(packages.proofread_text(F.col("p"), F.col("c")).alias("t")).collect()] == ["t", "m", None, "字"]
    assert markers.parse({r.path: r.content for r in _package(spark).collect()}["ocr.txt"].replace("[[BATCH_ID:7]]", "[[BATCH_ID:00000000-0000-0000-0000-000000000002]]"))["error"] is None
