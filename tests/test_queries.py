"""Every query of the library against its SQL, and the functions against literal cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.functions import markers
from folioforge.functions import sequence as seq
from folioforge.functions import text as tx
from folioforge.operators import assemble, layout, rules, state
from folioforge.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    want = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in columns), strict=True)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def _pages(spark, rows):
    return spark.createDataFrame([(1, i, t, j) for i, (t, j) in enumerate(rows)], "book int, ord int, text string, join string")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("文の途中", "DirectJoin"), ("です", "ParagraphBreak"), ("　次の段落", "SpaceJoin"), ("続き", "DirectJoin")], "文の途中です\n　次の段落 続き"),
        ([("a ", "SpaceJoin"), ("", "DirectJoin"), ("b", "SceneBreak"), ("c", "Uncertain")], "a b\n※\nc"),
        ([("[[CHAPTER:一]]", "DirectJoin"), ("x", "DirectJoin"), ("[[TITLE:二]]\ny", "DirectJoin")], "[[CHAPTER:一]]\nx\n[[TITLE:二]]\ny"),
        ([("a\n", "ParagraphBreak"), ("\nb", "SceneBreak")], "a\n\nb"),
    ],
)
def test_join_pages(spark, rows, want):
    assert [r.text for r in assemble.join_pages(_pages(spark, rows), "book", "ord", "text", "join").collect()] == [want]


def test_source_spans(spark):
    p = _pages(spark, [("甲\n乙", "DirectJoin"), ("丙", "DirectJoin")])
    got = sorted((r.ordinal, r.page, r.start, r.length) for r in assemble.source_spans(p, "book", "ord", "text", "join").collect())
    assert got == [(0, 0, 0, 1), (1, 0, 0, 1), (1, 1, 1, 1)]


def test_paragraph_kinds(spark):
    b = spark.createDataFrame([(1, "[[CHAPTER:第一話]]\r\n※\r\n\n[[PAGE:0001]]\n 𠮷本\n")], "book int, text string")
    got = [(r.role, r.plain_text, r.start, r.length) for r in assemble.paragraphs(b, "book").orderBy("ordinal").collect()]
    assert got == [("ChapterTitle", "第一話", 10, 3), ("SceneBreak", "※", 17, 1), ("BodyParagraph", "", 20, 0), ("BodyParagraph", " 𠮷本", 35, 4)]


def test_reading_order_by_first_of_column(spark):
    b = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate((100, 97, 94, 10, 9))], "page int, id long, x double, y double")
    got = {r.id: r.column for r in layout.reading_order(b, "page", 5.0).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}


def _box(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page int, id long, text string, left double, top double, right double, bottom double")


def test_thin_boxes(spark):
    ids = lambda rows: sorted(r.id for r in layout.thin_boxes(_box(spark, rows), "page").collect())
    assert ids([("本文", 100.0, 10.0, 120.0, 50.0), ("ほんぶん", 88.0, 12.0, 96.0, 38.0)]) == [0]
    assert ids([("本文", 100.0, 10.0, 120.0, 50.0), ("、", 100.0, 55.0, 106.0, 61.0)]) == [0, 1]
    assert ids([("大津市", 533.0, 267.0, 570.0, 2195.0), ("おおつ", 566.0, 1180.0, 598.0, 1390.0), ("本文", 800.0, 267.0, 840.0, 2195.0), ("本文", 900.0, 267.0, 942.0, 2195.0)]) == [0, 2, 3]


def test_nearest_links(spark):
    aid = _box(spark, [("ヤスミ", 80.0, 10.0, 90.0, 50.0)])
    bodies = _box(spark, [("八角", 60.0, 12.0, 76.0, 48.0), ("遠い本文", 10.0, 200.0, 30.0, 250.0)])
    (got,) = layout.nearest_links(aid, bodies, "page").collect()
    assert got.body == 0
    assert abs(got.confidence - 0.7606) < 1e-3
    even = _box(spark, [("甲", 35.0, 10.0, 45.0, 50.0), ("乙", 65.0, 10.0, 75.0, 50.0)])
    assert not layout.nearest_links(_box(spark, [("よみ", 50.0, 10.0, 60.0, 50.0)]), even, "page").collect()


def test_diff():
    assert seq.diff("甲乙", "甲X") == [("Equal", "甲", "甲"), ("Changed", "乙", "X")]
    kinds = seq.diff("甲乙丙丁", "甲X乙丁追")
    assert ("Added", "", "X") in kinds
    assert any(k == "Deleted" and "丙" in b for k, b, _ in kinds)
    assert seq.diff("山" * 9_500, "川" * 9_500) == [("Changed", "山" * 9_500, "川" * 9_500)]
    assert seq.diff("", "") == []
    assert seq.diff("a𠮷b", "a𠮷") == [("Equal", "a𠮷", "a𠮷"), ("Deleted", "b", "")]
    assert [(k, len(a), len(b)) for k, a, b in seq._spans(seq._units("a𠮷"), seq._units("a𠮸"))] == [("Equal", 2, 2), ("Changed", 1, 1)]


def test_diff_counts_units(spark):
    d = spark.createDataFrame([("a𠮷b", "ab"), ("", "𠮷"), (None, "x")], "a string, b string").select(seq.diff_counts(F.col("a"), F.col("b")).alias("c"))
    assert [tuple(r.c) for r in d.collect()] == [(0, 2, 0, 2), (2, 0, 0, 2), (1, 0, 0, 1)]


def test_reading():
    assert seq.normalised_reading("ﾃﾞﾝｼｬ") == "でんしゃ"
    assert seq.normalised_reading("ガ ヶ") == "がゖ"


def test_text_functions(spark):
    one = lambda value, kind, e: spark.createDataFrame([(value,)], f"c {kind}").select(e.alias("r")).first().r
    c = F.col("c")
    assert one("a𠮷b", "string", tx.units(c)) == 4
    assert one("a𠮷b", "string", tx.unit_slice(c, F.lit(1), F.lit(2))) == "𠮷"
    assert one("a𠮷b", "string", tx.unit_slice(c, F.lit(2), F.lit(2))) is None
    assert one("a", "string", tx.unit_slice(c, F.lit(0), F.lit(2))) is None
    assert one("　\n", "string", tx.is_blank(c))
    assert one("SCAN-20240229_235959-x.jpg", "string", tx.filename_time(c).cast("string")) == "2024-02-29 23:59:59"
    assert one("SCAN-20230229_235959.jpg", "string", tx.filename_time(c)) is None
    assert one(7, "int", tx.marker(c)) == "0007"
    assert one(12345, "int", tx.marker(c)) == "12345"
    assert one("[[CHAPTER:x]] [[bad]]", "string", tx.bad_markers(c))
    assert not one("[[TITLE:x]] y", "string", tx.bad_markers(c))
    assert one("a\r\n\r\n\r\nb\n", "string", tx.collapse_blank_lines(c)) == "a\nb"
    assert one("\n a \nb\n \t\n\n\u3000c\u2028d\n", "string", tx.collapse_blank_lines(c)) == "ab\ncd"
    assert one("*a\n-b_c", "string", tx.markdown_escape(c)) == "\\\\*a\n-b\\_c"
    assert one('a"b', "string", tx.csv_field(c)) == '"a""b"'
    keys = spark.createDataFrame([("page-10.png",), ("page-2.png",)], "c string").orderBy(tx.natural_key(c)).collect()
    assert [k.c for k in keys] == ["page-2.png", "page-10.png"]


def test_sequence_rules(spark):
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate(("10", "12", "12", "11", "十一"))], "g int, o int, n string")
    assert {r.code for r in rules.sequence_issues(d, "g", "o", "n").collect()} == {"Gap", "Duplicate", "Reversal", "NonNumeric"}


def test_resume_plan(spark):
    states = [(5, "Completed", True), (3, "Failed", True), (1, "Processing", True), (2, "NotProcessed", True), (4, "ReviewRequired", True), (0, "Failed", False)]
    d = spark.createDataFrame(states, "o int, s string, i boolean")
    assert [r.o for r in rules.resume_targets(d, "s", F.col("i"), "ResumeIncomplete").orderBy("o").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        rules.resume_targets(d, "s", F.col("i"), "Other")


def test_effective_selection(spark):
    rows = [(1, "Confirmed", "aa", 1), (1, "Stale", "bb", 2), (2, "Confirmed", "x", 1), (2, "Confirmed", "y", 2), (3, "Rejected", "z", 1)]
    held, conflicts = state.effective(spark.createDataFrame(rows, "k int, s string, r string, at int"), ["k"], "s", "r", ["at"])
    assert [(r.k, r.r) for r in held.collect()] == [(1, "aa")]
    assert [(r.k, r.readings) for r in conflicts.collect()] == [(2, 2)]


def test_numbered(spark):
    d = spark.range(0, 20_000, 1, 7).select((F.col("id") * 7919 % 20_011).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("g"))
    got = state.numbered(d, ["g", "v"], "n").toPandas()
    assert sorted(got["n"]) == list(range(20_000))
    want = got.sort_values(["g", "v"], na_position="first")
    assert list(want["n"]) == list(range(20_000))
    assert state.numbered(d.where("v < 0"), ["g", "v"], "n").count() == 0


HEAD = "[[FORMAT:2]]\n[[PROJECT_ID:00000000-0000-0000-0000-000000000001]]\n[[BATCH_ID:00000000-0000-0000-0000-000000000002]]\n"
PAGE = "[[PAGE:0001]]\n[[TEXT_BEGIN]]\n　段落\n\n末尾\n\n[[TEXT_END]]\n[[JOIN_TO_NEXT:ParagraphBreak]]\n"
REPORT = "[[REPORT_BEGIN]]\nnote\n[[REPORT_END]]\n"


def test_markers_accept():
    got = markers.parse("```text\n" + HEAD + PAGE + REPORT + "```")
    assert got["error"] is None
    assert markers.parse((HEAD + PAGE + REPORT).replace("FORMAT", "OWN_FORMAT")) == got
    assert markers.parse("[[FORMAT:2]]\n" + (HEAD + PAGE + REPORT).replace("FORMAT", "OWN_FORMAT"))["error"]
    assert got["pages"] == [{"page_marker": "0001", "text": "　段落\n\n末尾\n", "join_to_next": "ParagraphBreak"}]
    assert got["report"] == "note"
    old = markers.parse(HEAD.replace("FORMAT:2", "FORMAT:1") + "[[PAGE:0001]]\n[[PAGE_ROLE:Body]]\n a \n[[PAGE:0001]]\nb")
    assert [p["text"] for p in old["pages"]] == ["a", "b"]


@pytest.mark.parametrize(
    "content",
    ["", "x", HEAD, HEAD + PAGE, HEAD + REPORT, HEAD + PAGE.replace("[[TEXT_END]]\n", "") + REPORT, HEAD + "stray\n" + PAGE + REPORT, HEAD + PAGE + PAGE + REPORT, HEAD + PAGE.replace("[[JOIN_TO_NEXT:ParagraphBreak]]\n", "") + REPORT, HEAD + PAGE.replace("ParagraphBreak", "Other") + REPORT, HEAD + PAGE + REPORT + PAGE, HEAD + HEAD + PAGE + REPORT, HEAD.replace("FORMAT:2", "FORMAT:3") + PAGE + REPORT, HEAD + PAGE.replace("末尾", "[[JOIN_TO_NEXT:DirectJoin]]") + REPORT],
)
def test_markers_reject(content):
    assert markers.parse(content)["error"]
