"""Queries of pages, annotations, rendering and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..functions import supplement
from ..functions import text as tx
from ..operators import annotations, layout, packages, pages, render
from ..sources.tables import table
from .books import JOINS
from .ledger import _boxes

#: The sources of event types, and the readings given by event number.
EVENT_SOURCE = {"purchase": "ImageConfirmed", "view": "TextConfirmed", "click": "DictionarySuggested", "signup": "UserConfirmed", "error": "Unknown"}
READINGS = ("よみ", "ヨミ", "reading", "", "おん")


def page_order(spark, d):
    """Customers as pages: every third has its time in the name, every fourth an EXIF time, every seventh neither that nor a file time."""
    k = F.col("c_custkey")
    stamp = F.concat(F.lit("IMG_202401"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("_"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("0000.png"))
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, stamp).otherwise(F.concat(F.lit("page-"), k, F.lit(".png"))).alias("name"), F.when(k % 4 == 1, day(k % 20)).alias("exif"), F.when(k % 7 != 0, day(k % 30)).alias("modified"))
    return pages.ordered(c, "name", ["exif", "modified"], "c_custkey").select("c_custkey", "name", "position")


def page_swap(spark, d):
    """In every conversation the page at its number mod 4 moves three on, held within its end; pages turn by their role."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    moves = c.groupBy("conv_id").agg(F.lit(None).alias("_")).select("conv_id", (F.col("conv_id") % 4).alias("source"), (F.col("conv_id") % 4 + 3).alias("target"))
    out = pages.swapped(c.withColumn("position", F.col("turn")), moves, "conv_id", "position")
    return out.select("conv_id", "turn", "position", F.when(F.col("role") == "user", pages.rotated(F.col("turn") * 90, -180)).otherwise(pages.rotated(F.col("turn") * 90, 90)).alias("rotation"))


def crop_boxes(spark, d):
    k = F.col("p_partkey")
    crop = pages.crop_of(k % 60, k % 7 - F.when(k % 50 == 0, 9).otherwise(0), k % 45, k % 30)
    c = table(spark, d, "part").select("p_partkey", crop.alias("crop"), (k % 900 + 1).alias("w"), (k % 700 + 1).alias("h"))
    return c.select("p_partkey", F.inline_outer(F.array(pages.crop_box(F.col("crop"), F.col("w"), F.col("h")))))


def page_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, "new").alias("o_orderpriority"))
    return pages.upserted(o, new, "o_orderkey", ["o_orderstatus"])


def word_overrides(spark, d):
    """Lines as words, suppliers' overrides for every fifth part; the key is made of the part and the quantity."""
    key = tx.word_key(F.col("l_partkey").cast("string"), [F.col("l_suppkey") / 8])
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("page"), key.alias("word_key"), F.when(F.col("l_returnflag") == "R", "RubyCandidate").otherwise("Body").alias("role"), (F.col("l_returnflag") != "R").alias("included"))
    o = table(spark, d, "lineitem").where("l_partkey % 5 = 0").select(F.col("l_suppkey").alias("page"), key.alias("word_key"), F.lit("Body").alias("role"), F.lit(True).alias("included")).distinct()
    out = pages.with_overrides(w, o, "page")
    return out.groupBy("page", "role", "automatic_role", "included", "manual_override").agg(F.count("*").alias("n"), F.min("word_key").alias("first_key"))


def after_recognition(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.get(F.array(*map(F.lit, (*pages.TOUCHED, "Draft", "NotOcrProcessed", "ReviewRequired"))), (F.col("o_orderkey") % 7).cast("int")))
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("reviews"))
    both = o.join(n, F.col("o_orderkey") == F.col("k"), "left")
    return both.select("o_orderkey", pages.status_after_recognition(F.col("status"), F.coalesce("reviews", F.lit(0))).alias("status"))


def page_range(spark, d):
    return pages.range_of(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", 2, 2).select("conv_id", "turn")


def word_page_texts(spark, d):
    return layout.page_texts(_boxes(spark, d), "page")


def _proposals(spark, d):
    """Events as annotations of documents, of which the last are missing; every third repeats the text at its place, every eleventh a neighbour's range."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("plain_text"))
    spans = F.array(*(F.struct(F.lit(p).alias("page_marker"), F.lit(s).alias("start"), F.lit(n).alias("length")) for p, s, n in (("0001", 0, 6), ("0002", 6, 1_000_000))))
    paragraphs = docs.select(F.concat(F.lit("P"), "doc_id").alias("paragraph_id"), "plain_text", F.when(F.col("doc_id") % 13 == 0, "old").otherwise(tx.text_hash(F.col("plain_text"))).alias("text_hash"), spans.alias("spans"))
    pick = F.create_map(*(F.lit(x) for kv in EVENT_SOURCE.items() for x in kv))
    # The texts are joined before anything is made of an event, so that little is shuffled.
    said = e.select(k, "event_type", "value", (k % 211).alias("_d")).join(docs.select(F.col("doc_id").alias("_doc"), F.substring("plain_text", 1, 40).alias("_t")), F.col("_d") == F.col("_doc"), "left")
    start, length = (k % 17 - 1).cast("int"), (k % 6).cast("int")
    there = F.substr(F.coalesce("_t", F.lit("")), F.greatest(start + 1, F.lit(1)), F.greatest(length, F.lit(0)))
    rows = said.select(
        (k % 10).alias("batch"), k.alias("pos"), F.concat(F.lit("p"), "_d").alias("paragraph_id"), start.alias("start"), length.alias("length"), F.when(k % 3 != 0, there).otherwise("x").alias("base_text"), F.get(F.array(*map(F.lit, READINGS)), (k % 5).cast("int")).alias("reading"),
        F.get(F.array(*map(F.lit, ("よみ", "よみ", "reading", "", "おん"))), (k % 5).cast("int")).alias("reading_key"), F.coalesce(F.try_element_at(pick, F.col("event_type")), F.lit("Unknown")).alias("source"), (F.col("value") / 40).alias("confidence"),
        F.when(k % 19 != 0, "seen").otherwise(" ").alias("evidence"), F.when(k % 23 != 0, F.when(k % 8 == 0, F.array(F.lit("0001"), F.lit("0001"))).when(k % 9 == 0, F.array(F.lit("0009"))).otherwise(F.array(F.lit("0001")))).alias("markers"),
        F.get(F.array(*map(F.lit, ("Proposed", "Stale", "Rejected"))), F.when(k % 10 < 8, 0).otherwise((k % 10 - 7).cast("int"))).alias("status"),
    )
    batch_pages = e.select((k % 10).alias("batch")).distinct().select("batch", F.explode(F.array(F.lit("0001"), F.lit("0002"))).alias("page_marker"))
    candidates = rows.where("pos % 50 < 30").select("batch", F.lit("0001").alias("page_marker"), "reading_key", F.when(F.col("pos") % 2 == 0, F.col("base_text")).alias("base_text_candidate"), (F.col("pos") % 50 < 3).alias("returned_to_body"), (F.col("pos") % 50 / 20).alias("confidence"), (F.col("pos") % 50 / 25).alias("link_confidence"))
    return rows, paragraphs, batch_pages, candidates


_PROPOSALS = """
WITH a AS (SELECT event_id % 10 AS batch, event_id AS pos, event_id % 211 AS d, event_id % 17 - 1 AS s, event_id % 6 AS n, ['よみ', 'ヨミ', 'reading', '', 'おん'][event_id % 5 + 1] AS reading, ['よみ', 'よみ', 'reading', '', 'おん'][event_id % 5 + 1] AS rk,
    CASE event_type WHEN 'purchase' THEN 'ImageConfirmed' WHEN 'view' THEN 'TextConfirmed' WHEN 'click' THEN 'DictionarySuggested' WHEN 'signup' THEN 'UserConfirmed' ELSE 'Unknown' END AS source, value / 40 AS c,
    event_id % 19 <> 0 AS evidence, CASE WHEN event_id % 23 <> 0 THEN CASE WHEN event_id % 8 = 0 THEN ['0001', '0001'] WHEN event_id % 9 = 0 THEN ['0009'] ELSE ['0001'] END END AS m,
    CASE event_id % 10 WHEN 8 THEN 'Stale' WHEN 9 THEN 'Rejected' ELSE 'Proposed' END AS status FROM events),
r AS (SELECT a.*, doc_id IS NOT NULL AS found, coalesce(text, '') AS t, CASE WHEN pos % 3 <> 0 THEN substr(substr(coalesce(text, ''), 1, 40), (greatest(s, 0) + 1)::INTEGER, n::INTEGER) ELSE 'x' END AS base FROM a LEFT JOIN documents ON doc_id = d),
k AS (SELECT batch, rk, CASE WHEN pos % 2 = 0 THEN base END AS base, pos % 50 < 3 AS returned, pos % 50 / 20.0 AS c, pos % 50 / 25.0 AS link FROM r WHERE pos % 50 < 30),
i AS (SELECT *, s < 6 AND s + n > 0 AS one, s + n > 6 AND s < 1000006 AS two FROM r WHERE source = 'ImageConfirmed' AND found),
f AS (SELECT i.pos, coalesce(bool_or(k.rk IS NOT NULL), false) AS read, coalesce(bool_or(k.base IS NOT NULL), false) AS known, coalesce(bool_or(k.base = i.base), false) AS same, coalesce(bool_or(k.base = i.base AND NOT returned), false) AS rightly,
    coalesce(bool_or(k.base = i.base AND NOT returned AND k.c >= 0.7), false) AS sure, coalesce(bool_or(k.base = i.base AND NOT returned AND k.c >= 0.7 AND link >= 0.6), false) AS linked
  FROM i LEFT JOIN k ON k.batch = i.batch AND k.rk = i.rk AND i.one AND list_contains(coalesce(i.m, []), '0001') GROUP BY i.pos),
x AS (
  SELECT batch, pos, 'ParagraphId' AS code FROM r WHERE NOT found UNION ALL SELECT batch, pos, 'Start' FROM r WHERE s < 0 UNION ALL SELECT batch, pos, 'Length' FROM r WHERE n < 1
  UNION ALL SELECT batch, pos, 'Range' FROM r WHERE found AND s >= 0 AND n >= 1 AND s + n > length(t)
  UNION ALL SELECT batch, pos, 'BaseText' FROM r WHERE found AND s >= 0 AND n >= 1 AND s + n <= length(t) AND substr(t, (s + 1)::INTEGER, n::INTEGER) <> base
  UNION ALL SELECT batch, pos, 'ParagraphTextHash' FROM r WHERE found AND s >= 0 AND n >= 1 AND d % 13 = 0
  UNION ALL SELECT batch, pos, 'EvidencePageMarkersUnique' FROM r WHERE len(m) = 2 UNION ALL SELECT batch, pos, 'EvidencePage' FROM r WHERE m = ['0009']
  UNION ALL SELECT batch, pos, 'Reading' FROM r WHERE reading = '' UNION ALL SELECT batch, pos, 'Evidence' FROM r WHERE NOT evidence UNION ALL SELECT batch, pos, 'EvidencePageMarkers' FROM r WHERE m IS NULL
  UNION ALL SELECT batch, pos, 'Confidence' FROM r WHERE c < 0 OR c > 1 UNION ALL SELECT batch, pos, 'Source' FROM r WHERE source = 'Unknown'
  UNION ALL SELECT batch, pos, 'RubyPolicy' FROM r WHERE source NOT IN ('ImageConfirmed', 'TextConfirmed', 'UserConfirmed')
  UNION ALL SELECT batch, pos, 'Duplicate' FROM (SELECT *, row_number() OVER (PARTITION BY batch, d, s, n, reading ORDER BY pos) AS q FROM r) WHERE q > 1
  UNION ALL SELECT DISTINCT r.batch, r.pos, 'Overlap' FROM r JOIN r o ON o.batch = r.batch AND o.d = r.d AND o.pos < r.pos AND r.s < o.s + o.n AND r.s + r.n > o.s
  UNION ALL SELECT batch, pos, 'SuggestedReading' FROM r WHERE source = 'DictionarySuggested' UNION ALL SELECT batch, pos, 'LowConfidence' FROM r WHERE c < 0.7 UNION ALL SELECT batch, pos, 'NonKanaReading' FROM r WHERE reading = 'reading'
  UNION ALL SELECT batch, pos, 'MultipleReadings' FROM r WHERE (batch, base) IN (SELECT (batch, base) FROM r GROUP BY batch, base HAVING count(DISTINCT reading) > 1)
  UNION ALL SELECT batch, pos, 'EvidencePageDoesNotMatchSourceSpan' FROM i WHERE (NOT one AND NOT two) OR (list_contains(m, '0001') AND NOT one) OR list_contains(m, '0009')
  UNION ALL SELECT batch, pos, code FROM (SELECT batch, i.pos, CASE WHEN NOT read THEN 'ImageCandidateMismatch' WHEN NOT same AND NOT known THEN 'BaseTextCandidateUnknown' WHEN NOT same THEN 'ImageCandidateMismatch' WHEN NOT rightly THEN 'WrongSideCandidate'
    WHEN NOT sure THEN 'LowOcrCandidateConfidence' WHEN NOT linked THEN 'LowLinkConfidence' END AS code FROM i JOIN f ON f.pos = i.pos) WHERE code IS NOT NULL)
"""


def annotation_issues(spark, d):
    rows, paragraphs, batch_pages, candidates = _proposals(spark, d)
    return annotations.annotation_issues(rows, paragraphs, batch_pages, candidates, F.lit("OriginalAndTextConfirmed"))


def bulk_confirmable(spark, d):
    rows, paragraphs, batch_pages, candidates = _proposals(spark, d)
    found = annotations.annotation_issues(rows, paragraphs, batch_pages, candidates, F.lit("OriginalAndTextConfirmed"), annotations.OF_OTHERS)
    return annotations.confirmable(rows, found, "TextConfirmed").select("batch", "pos")


def _rendered(spark, d):
    """Documents as paragraphs; every second one of twelve characters or more has confirmed readings of its second to fourth and eighth to ninth."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("plain_text"), F.get(F.array(*map(F.lit, ("ChapterTitle", "SectionTitle", "BodyParagraph", "SceneBreak", "Other"))), (F.col("doc_id") % 5).cast("int")).alias("role"))
    given = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(n).alias("length"), F.lit(r).alias("reading"), F.lit(st).alias("status")) for s, n, r, st in ((7, 2, "a|b", "Confirmed"), (1, 3, "よみ", "Confirmed"), (2, 4, "x", "Proposed"))))
    notes = docs.where("doc_id % 2 = 0 and length(plain_text) >= 12").select("doc_id", "plain_text", F.inline(given)).withColumn("base_text", tx.unit_slice(F.col("plain_text"), F.col("start"), F.col("length")))
    return render.compose(docs, notes, ["doc_id"])


def book_markdown(spark, d):
    return _rendered(spark, d).select("doc_id", F.md5(render.paragraph_markdown(F.col("role"), F.col("inlines"))).alias("markdown_md5"))


def book_chapters(spark, d):
    """A book of twelve paragraphs in a row, in chapters of three: the length of each file."""
    m = _rendered(spark, d).select(F.floor(F.col("doc_id") / 12).alias("book"), F.floor(F.col("doc_id") % 12 / 3).alias("chapter"), "doc_id", render.paragraph_markdown(F.col("role"), F.col("inlines")).alias("m"))
    return render.books(m, ["book", "chapter"], "doc_id", "m").select("book", render.chapter_name(F.col("chapter")).alias("file"), F.length("content").cast("long").alias("chars"))


def yaml_scalars(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.yaml_quote(F.col("text"))).alias("yaml_md5"))


def reading_dictionary(spark, d):
    parts = table(spark, d, "part").select(F.col("p_size").alias("book"), F.col("p_brand").alias("base"), F.col("p_type").alias("reading"))
    approved = parts.groupBy("book", "base").agg(F.min("reading").alias("reading"))
    bad = render.reading_conflicts(parts, approved, "book")
    return render.dictionary(approved.join(bad.select("book", "base"), ["book", "base"], "left_anti"), "book")


def supplement_proposals(spark, d):
    """Turns as texts recognised twice: once without their full stops, once with every tenth character lost."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[。、！？」「]", "").alias("first"), F.regexp_replace("text", r"(?s)(.{9}).", "$1").alias("second"))
    p = c.select("conv_id", "turn", supplement.proposal(F.col("first"), F.col("second"), F.lit(None).cast("array<struct<ordinal:int,text:string>>")).alias("p"))
    return p.select("conv_id", "turn", F.md5("p.suggested").alias("suggested_md5"), F.size("p.operations").alias("operations"), F.size(supplement.unanchored(F.col("p.operations"))).alias("unanchored"))


def proofreading_package(spark, d):
    """Every conversation as a package: the size of each of its files, read back from the archive's rows."""
    names = F.array(*map(F.lit, JOINS))
    c = table(spark, d, "conversations")
    p = c.select(
        F.col("conv_id").alias("batch"), F.col("turn").alias("position"), F.col("turn").alias("page_id"), F.concat(F.lit("p"), "turn", F.lit(".PNG")).alias("file_name"), tx.text_hash(F.col("text")).alias("source_hash"), F.lit("Body").alias("role"), "text",
        F.lit("Manual").alias("layer"), F.col("text").alias("machine_text"), F.get(names, (F.col("turn") % 5).cast("int")).alias("join"), F.lit(0).alias("low_confidence"),
    )
    r = c.where("role = 'user'").select(F.col("conv_id").alias("batch"), F.col("turn").alias("page_id"), F.lit("LowConfidence").alias("code"), F.lit("m").alias("message"), F.lit("t").alias("text"))
    files = packages.proofreading_files(p, r, "00000000-0000-0000-0000-000000000001", "Correct the text.")
    pages_ = F.size(F.from_json(F.get_json_object("content", "$.pages"), "array<struct<pageMarker:string>>"))
    items = F.size(F.from_json("content", "array<struct<pageMarker:string>>"))
    n = F.when(F.col("path") == "manifest.json", pages_).when(F.col("path") == "review-items.json", items).when(F.col("path") == "ocr.txt", F.size(F.regexp_extract_all("content", F.lit(r"(?m)^(\[\[PAGE:)"), F.lit(1)))).otherwise(0)
    return files.select(F.col("batch").alias("conv_id"), "path", n.cast("long").alias("n"))


def chapter_pages(spark, d):
    """Documents as the first pages of chapters: every third under a chapter's number, every seventh below blank lines."""
    k = F.col("doc_id")
    page = F.concat(F.when(k % 7 == 0, "\n \n").otherwise(""), F.when(k % 3 == 0, "第三章\n").otherwise(""), F.when(k % 9 == 0, "Above\n").otherwise(""), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(tx.chapter_page(page)).alias("page_md5"))


def strict_members(spark, d):
    """Events' properties, every fourth with a member too many and every fifth cut short."""
    k = F.col("event_id")
    j = F.when(k % 20 == 0, F.lit(None)).when(k % 5 == 0, F.substring("props", 1, 4)).when(k % 4 == 0, F.replace("props", F.lit("}"), F.lit(', "K": 1}'))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", tx.only_members(j, {}, ("k",)).alias("good"))


def status_selections(spark, d):
    """All proposals in small selections to be rejected: one that is badly placed keeps its selection as it was."""
    rows, paragraphs, _, _ = _proposals(spark, d)
    out, bad = annotations.with_status(rows.withColumn("batch", F.col("pos") % 5003), paragraphs, "Rejected")
    return out.select("batch", "pos", "status", "changed")


def reading_diff(spark, d):
    """Turns against themselves without their vowels, as normalised readings: the changed characters."""
    c = table(spark, d, "conversations").select("conv_id", "turn", seq.diff_counts(F.col("text"), F.regexp_replace("text", "[aeiou]", "")).alias("c"))
    return c.select("conv_id", "turn", "c.added", "c.deleted", "c.replaced", "c.changed")


QUERIES = {f.__name__: f for f in (page_order, page_swap, crop_boxes, page_upsert, word_overrides, after_recognition, page_range, word_page_texts, annotation_issues, bulk_confirmable, book_markdown, book_chapters, yaml_scalars, reading_dictionary, supplement_proposals, proofreading_package, chapter_pages, strict_members, status_selections, reading_diff)}

_ESC = r"regexp_replace({}, '([\\{{}}|])', '\\\1', 'g')"


def _md(x: str) -> str:
    """SQL of the markdown escape of a run."""
    c = _ESC.format(f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
    lead = rf"(SELECT CASE WHEN regexp_matches(q, '^[0-9]+\.\s') THEN regexp_replace(q, '^([0-9]+)\.', '\1&#46;') WHEN q LIKE '    %' THEN '&#32;&#32;&#32;&#32;' || substr(q, 5) WHEN q LIKE chr(9) || '%' THEN '&#9;' || substr(q, 2) WHEN regexp_matches(q, '^[#*+-]') THEN '\' || q ELSE q END FROM (SELECT {c} AS q))"
    return rf"regexp_replace({lead}, '([\[\]*!_`])', '\\\1', 'g')"


MARKDOWN_ESCAPE = f"SELECT doc_id, md5({_md('text')}) AS escaped_md5 FROM documents"
_MARKDOWN = f"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS text, ['# ', '## ', '', '***', ''][doc_id % 5 + 1] AS prefix FROM documents),
m AS (SELECT doc_id, CASE WHEN prefix = '***' THEN prefix WHEN doc_id % 2 = 0 AND length(text) >= 12 THEN prefix || {_md("substr(text, 1, 1)")} || '{{' || {_ESC.format("substr(text, 2, 3)")} || '|よみ}}' || {_md("substr(text, 5, 3)")}
  || '{{' || {_ESC.format("substr(text, 8, 2)")} || '|a\\|b}}' || {_md("substr(text, 10)")} ELSE prefix || {_md("text")} END || chr(10) || chr(10) AS m FROM p)
"""

SQL = {
    "page_order": r"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'IMG_202401' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '_' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || '0000.png' ELSE 'page-' || c_custkey || '.png' END AS name FROM customer),
t AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 28) * 24 + c_custkey % 24 WHEN c_custkey % 4 = 1 THEN c_custkey % 20 * 24 WHEN c_custkey % 7 <> 0 THEN c_custkey % 30 * 24 END AS hours,
  array_to_string(list_transform(regexp_extract_all(name, '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p::BIGINT::VARCHAR, 19, '0') ELSE upper(p) END), '') AS k FROM c)
SELECT c_custkey, name, row_number() OVER (ORDER BY hours NULLS FIRST, k, c_custkey) - 1 AS position FROM t
""",
    "page_swap": """
WITH n AS (SELECT conv_id, conv_id % 4 AS a, greatest(0, least(conv_id % 4 + 3, count(*) - 1)) AS b, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT c.conv_id, turn, CASE WHEN a >= n THEN turn WHEN turn = a THEN b WHEN turn = b THEN a ELSE turn END AS position,
  CASE WHEN role = 'user' THEN (turn * 90 + 180) % 360 ELSE (turn * 90 + 90) % 360 END AS rotation FROM conversations c JOIN n ON n.conv_id = c.conv_id
""",
    "crop_boxes": """
WITH c AS (SELECT p_partkey, p_partkey % 60 AS l, p_partkey % 7 - CASE WHEN p_partkey % 50 = 0 THEN 9 ELSE 0 END AS t, p_partkey % 45 AS r, p_partkey % 30 AS b, p_partkey % 900 + 1 AS w, p_partkey % 700 + 1 AS h FROM part),
g AS (SELECT *, least(l, t, r, b) >= 0 AND l + r < 100 AND t + b < 100 AS ok FROM c),
s AS (SELECT p_partkey, ok, w, h, greatest(0, least(floor(l / 100.0::DOUBLE * w), w - 1))::BIGINT AS x, greatest(0, least(floor(t / 100.0::DOUBLE * h), h - 1))::BIGINT AS y, ceil((1 - r / 100.0::DOUBLE) * w) AS x2, ceil((1 - b / 100.0::DOUBLE) * h) AS y2 FROM g)
SELECT p_partkey, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN greatest(1, least(x2, w) - x)::BIGINT END AS w, CASE WHEN ok THEN greatest(1, least(y2, h) - y)::BIGINT END AS h FROM s
""",
    "page_upsert": """
WITH n AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS k, CASE WHEN o_orderkey % 4 <> 0 THEN 'new' END AS p FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(k, o_orderkey) AS o_orderkey, coalesce(o_orderstatus, 'N') AS o_orderstatus, CASE WHEN k IS NULL THEN o_orderpriority ELSE p END AS o_orderpriority FROM orders FULL JOIN n ON k = o_orderkey
""",
    "word_overrides": """
WITH w AS (SELECT l_suppkey AS page, upper(sha256(l_partkey::VARCHAR || chr(31) || printf('%.3f', l_suppkey / 8))) AS k, l_returnflag = 'R' AS r, l_partkey % 5 = 0 AS o FROM lineitem)
SELECT page, CASE WHEN r AND NOT o THEN 'RubyCandidate' ELSE 'Body' END AS role, CASE WHEN r THEN 'RubyCandidate' ELSE 'Body' END AS automatic_role, NOT r OR o AS included, o AS manual_override, count(*) AS n, min(k) AS first_key FROM w GROUP BY 1, 2, 3, 4, 5
""",
    "after_recognition": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 THEN 'Stale' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'ReviewRequired' ELSE 'Draft' END AS status FROM orders
""",
    "page_range": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r BETWEEN 2 AND 3",
    "annotation_issues": _PROPOSALS + "SELECT batch, pos, code FROM x",
    "bulk_confirmable": _PROPOSALS + """
SELECT batch, pos FROM r WHERE source = 'TextConfirmed' AND c >= 0.7 AND status = 'Proposed' AND len(m) > 0 AND evidence AND pos NOT IN (SELECT pos FROM x WHERE code NOT IN ('Overlap', 'MultipleReadings', 'Duplicate'))
""",
    "book_markdown": _MARKDOWN + "SELECT doc_id, md5(m) AS markdown_md5 FROM m",
    "book_chapters": _MARKDOWN + "SELECT doc_id // 12 AS book, 'chapter-' || lpad((doc_id % 12 // 3 + 1)::VARCHAR, 3, '0') || '.md' AS file, sum(length(m))::BIGINT AS chars FROM m GROUP BY 1, 2",
    "yaml_scalars": r"""SELECT doc_id, md5('"' || replace(replace(replace(regexp_replace(text, '([\\"])', '\\\1', 'g'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t') || '"') AS yaml_md5 FROM documents""",
    "chapter_pages": r"""
WITH p AS (SELECT doc_id, regexp_split_to_array(CASE WHEN doc_id % 7 = 0 THEN chr(10) || ' ' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '第三章' || chr(10) ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN 'Above' || chr(10) ELSE '' END || text, '\r\n|\r|\n') AS l FROM documents),
f AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '\S')), true) AS i FROM p),
h AS (SELECT doc_id, l, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS c, regexp_replace(l[i + 1], '^\s+|\s+$', '', 'g') AS t FROM f),
o AS (SELECT *, coalesce(c = '第三章' AND t <> '' AND length(t) <= 40, false) AS titled FROM h)
SELECT doc_id, md5(CASE WHEN coalesce(i, 0) = 0 THEN '' ELSE '[[CHAPTER:' || c || ']]' || CASE WHEN titled THEN chr(10) || '[[TITLE:' || t || ']]' ELSE '' END
  || CASE WHEN i + titled::INTEGER < len(l) THEN chr(10) || array_to_string(l[i + titled::INTEGER + 1:], chr(10)) ELSE '' END END) AS page_md5 FROM o
""",
    "strict_members": "SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN event_id % 5 <> 0 AND event_id % 4 <> 0 END AS good FROM events",
    "status_selections": _PROPOSALS + """,
q AS (SELECT pos % 5003 AS g, pos, status, reading <> '' AND found AND s >= 0 AND n >= 1 AND s + n <= length(t) AND substr(t, (s + 1)::INTEGER, n::INTEGER) = base AS ok FROM r),
w AS (SELECT g, pos, status AS was, CASE WHEN bool_and(ok) OVER (PARTITION BY g) THEN 'Rejected' ELSE status END AS status FROM q)
SELECT g AS batch, pos, status, was <> status AS changed FROM w
""",
    "reading_dictionary": """
WITH g AS (SELECT p_size, p_brand, min(p_type) AS t FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) = 1)
SELECT p_size AS book, string_agg('"' || p_brand || '","' || t || '"' || chr(10), '' ORDER BY p_brand) AS content FROM g GROUP BY 1
""",
    "proofreading_package": """
WITH g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1)
SELECT conv_id, path, CASE path WHEN 'review-items.json' THEN u WHEN 'instructions.md' THEN 0 ELSE n END AS n FROM g, (VALUES ('manifest.json'), ('ocr.txt'), ('instructions.md'), ('review-items.json')) AS t(path)
""",
}
