"""Queries that assemble pages, over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers
from ..functions import sequence as seq
from ..functions import text as tx
from ..operators import assemble, gate, layout, pages, rules, state
from ..sources.tables import table
from .ledger import _BOXES, _boxes

JOINS = ("DirectJoin", "SpaceJoin", "ParagraphBreak", "SceneBreak", "Uncertain")


def _pages(spark, d):
    """Turns as pages; the boundary rule comes from the turn's number."""
    names = F.array(*map(F.lit, JOINS))
    return table(spark, d, "conversations").withColumn("join", F.get(names, (F.col("turn") % 5).cast("int")))


_PIECES = """
WITH p AS (SELECT conv_id, turn, text, ['DirectJoin', 'SpaceJoin', 'ParagraphBreak', 'SceneBreak', 'Uncertain'][(turn % 5 + 1)::INTEGER] AS j,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE length(text) > 0),
pieces AS (SELECT conv_id, turn, text || CASE WHEN nxt IS NULL OR text LIKE '%' || chr(10) OR nxt LIKE chr(10) || '%' THEN ''
    WHEN j = 'SpaceJoin' THEN CASE WHEN regexp_matches(text, '\\s$') THEN '' ELSE ' ' END
    WHEN j = 'ParagraphBreak' THEN chr(10) WHEN j = 'SceneBreak' THEN chr(10) || '※' || chr(10) ELSE '' END AS piece FROM p),
books AS (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text FROM pieces GROUP BY conv_id)
""".replace("\\\\s", "\\s")

_LINES = _PIECES + """,
l AS (SELECT conv_id, string_split(text, chr(10)) AS ls FROM books),
e AS (SELECT conv_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM l),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM e),
paras AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS ordinal,
    CASE WHEN trim(line) IN ('※', '***', '---') THEN 'SceneBreak' ELSE 'BodyParagraph' END AS role, line AS plain_text, start, length(line)::INTEGER AS length
    FROM o WHERE NOT (i = n AND line = ''))
"""


def page_join_text(spark, d):
    return assemble.join_pages(_pages(spark, d), "conv_id", "turn", "text", "join")


def _paras(spark, d):
    return assemble.paragraphs_of_pages(_pages(spark, d), "conv_id", "turn", "text", "join")


def paragraph_rows(spark, d):
    return _paras(spark, d).select("conv_id", "ordinal", "role", F.md5("plain_text").alias("text_md5"), "start", "length")


def paragraph_spans(spark, d):
    return assemble.source_spans(_pages(spark, d), "conv_id", "turn", "text", "join")


def chapter_groups(spark, d):
    rows = assemble.chapters(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return rows.select("conv_id", "turn", "chapter")


def logical_keys(spark, d):
    rows = table(spark, d, "conversations")
    return assemble.logical_keys(rows, "conv_id", "turn", F.when(F.col("turn") % 7 != 0, F.floor(F.col("turn") / 3)), F.col("role")).select("conv_id", "turn", "logical_key")


def document_hash(spark, d):
    return assemble.document_hash(table(spark, d, "conversations"), "conv_id", "turn", [F.col("role"), F.col("text")])


def interleave(spark, d):
    """Turns are blocks from page 2*turn to 2*turn + 2; every conversation has pictures at pages 1, 6 and 1000."""
    c = table(spark, d, "conversations")
    blocks = c.select("conv_id", F.col("turn").alias("block"), (F.col("turn") * 2).alias("first"), (F.col("turn") * 2 + 2).alias("last"))
    pictures = c.select("conv_id").distinct().select("conv_id", F.posexplode(F.array(*(F.lit(x).cast("long") for x in (1, 6, 1000))))).toDF("conv_id", "picture", "at")
    return assemble.interleave(blocks, pictures, "conv_id")


def text_layer_select(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic"), F.col("doc_id") == F.col("l_id"), "left")
    picked = state.layers(
        rows.withColumnRenamed("text", "machine"),
        {"Confirmed": F.when(F.col("quality") == 1, F.concat(F.lit("c:"), "machine")), "Manual": F.when(F.col("toxic") == 1, F.concat(F.lit("m:"), "machine")), "Suggested": F.when(F.col("lang") == "en", F.lit("")), "Reconstruction": F.col("machine")},
    )
    return picked.select("doc_id", "layer", F.md5("text").alias("text_md5"))


def import_merge_new(spark, d):
    docs = state.page_hash(table(spark, d, "documents")).select("doc_id", "hash")
    return state.import_new(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "hash", "doc_id")


def duplicate_pairs(spark, d):
    return state.duplicate_neighbours(state.page_hash(table(spark, d, "documents")), "hash", "doc_id")


def first_per_key(spark, d):
    return state.first_per_key(table(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["doc_id"])


def _versions(spark, d):
    """Documents and an edited copy of each: every third has its first blank line doubled, every fifth loses its first word, every seventh half its text."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    edited = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "^[^ ]* ", "")).when(F.col("doc_id") % 7 == 0, F.substring("text", F.lit(1), (F.length("text") / 3).cast("int"))).otherwise(F.col("text"))
    return docs.select("doc_id", "text", edited.alias("edited"), "lang", F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("new_lang"))


_VERSIONS = """
WITH v AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) WHEN doc_id % 5 = 0 THEN regexp_replace(text, '^[^ ]* ', '')
    WHEN doc_id % 7 = 0 THEN substr(text, 1, (length(text) // 3)::INTEGER) ELSE text END AS edited, lang, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS new_lang FROM documents)
"""


def changed_paragraphs(spark, d):
    return _versions(spark, d).select("doc_id", tx.changed_paragraphs(F.col("text"), F.col("edited")).cast("long").alias("changed"))


def drift_issues(spark, d):
    v = _versions(spark, d)
    return rules.issues(
        v, ["doc_id"],
        {
            "BaselineTextChanged": ~tx.text_hash(F.col("text")).eqNullSafe(tx.text_hash(F.col("edited"))), "PageRoleChanged": ~F.col("lang").eqNullSafe(F.col("new_lang")),
            "EmptyConfirmedText": tx.is_blank(F.col("edited")), "ExtremeTextLengthChange": tx.extreme_change(tx.units(F.col("text")), tx.units(F.col("edited"))),
        },
    )


def markdown_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.markdown_escape(F.col("text"))).alias("escaped_md5"))


def utf16_slice(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.units(t).alias("units"), tx.unit_slice(t, F.lit(3), F.lit(9)).alias("part"))


def diff_counts(spark, d):
    """Documents of up to 2,000 characters and their edited copies, aligned in full; longer ones by their common ends."""
    v = _versions(spark, d).select("doc_id", seq.diff_counts(F.col("text"), F.col("edited")).alias("c"))
    return v.select("doc_id", "c.added", "c.deleted", "c.replaced", "c.changed")


def reading_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(seq.reading_key(F.col("text"))).alias("reading_md5"))


def emit_parse_roundtrip(spark, d):
    one = F.lit("00000000-0000-0000-0000-000000000001")
    files = markers.rendered(_pages(spark, d), "conv_id", "turn", "text", "join", one, one)
    read = files.select("conv_id", markers.parsed(F.col("content")).alias("f")).where("f.error is null").select("conv_id", F.inline("f.pages"))
    return read.select("conv_id", "page_marker", F.md5("text").alias("text_md5"), "join_to_next")


QUERIES = {f.__name__: f for f in (page_join_text, paragraph_rows, paragraph_spans, chapter_groups, logical_keys, document_hash, interleave, text_layer_select, import_merge_new, duplicate_pairs, first_per_key, changed_paragraphs, drift_issues, markdown_escape, utf16_slice, diff_counts, reading_normalise, emit_parse_roundtrip)}

SQL = {
    "page_join_text": _PIECES + "SELECT conv_id, text FROM books",
    "emit_parse_roundtrip": """
SELECT conv_id, lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 4, '0') AS page_marker, md5(text) AS text_md5,
  ['DirectJoin', 'SpaceJoin', 'ParagraphBreak', 'SceneBreak', 'Uncertain'][(turn % 5 + 1)::INTEGER] AS join_to_next FROM conversations
""",
    "paragraph_rows": _LINES + "SELECT conv_id, ordinal, role, md5(plain_text) AS text_md5, start, length FROM paras",
    "paragraph_spans": _LINES + """,
seg AS (SELECT conv_id, turn AS page, sum(length(piece)) OVER w AS hi, sum(length(piece)) OVER w - length(piece) AS lo FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT p.conv_id, ordinal, page, CASE WHEN length > 0 THEN greatest(lo, start) - start ELSE 0 END::INTEGER AS start,
  CASE WHEN length > 0 THEN least(hi, start + length) - greatest(lo, start) ELSE 0 END::INTEGER AS length
FROM paras p JOIN seg s ON p.conv_id = s.conv_id AND CASE WHEN length > 0 THEN lo < start + length AND hi > start ELSE lo <= greatest(start - 1, 0) AND greatest(start - 1, 0) < hi END
""",
    "chapter_groups": """
SELECT conv_id, turn, (sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS chapter
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
""",
    "logical_keys": """
WITH p AS (SELECT *, CASE WHEN turn % 7 <> 0 THEN (turn // 3)::VARCHAR ELSE 'document' END AS page FROM conversations)
SELECT conv_id, turn, page || ':' || (row_number() OVER (PARTITION BY conv_id, page ORDER BY turn) - 1)::VARCHAR || ':' || role AS logical_key FROM p
""",
    "document_hash": "SELECT conv_id, upper(sha256(string_agg(role || chr(31) || text, chr(10) ORDER BY turn))) AS hash FROM conversations GROUP BY conv_id",
    "interleave": """
WITH b AS (SELECT conv_id, turn AS block, turn * 2 AS first, turn * 2 + 2 AS last FROM conversations),
p AS (SELECT DISTINCT conv_id, picture::INTEGER AS picture, pos FROM conversations, (VALUES (0, 1), (1, 6), (2, 1000)) AS t(picture, pos)),
m AS (SELECT p.conv_id, picture, pos, min(block) AS block FROM p LEFT JOIN b ON b.conv_id = p.conv_id AND last > pos GROUP BY 1, 2, 3)
SELECT m.conv_id, picture, m.block, CASE WHEN m.block IS NULL THEN 'end' WHEN pos < first THEN 'before' ELSE 'after' END AS place, coalesce(pos > first, false) AS adjusted
FROM m LEFT JOIN b ON b.conv_id = m.conv_id AND b.block = m.block
""",
    "text_layer_select": """
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'Confirmed' WHEN toxic = 1 THEN 'Manual' WHEN lang = 'en' THEN 'Suggested' ELSE 'Reconstruction' END AS layer,
  md5(CASE WHEN quality = 1 THEN 'c:' || text WHEN toxic = 1 THEN 'm:' || text WHEN lang = 'en' THEN '' ELSE text END) AS text_md5
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
    "import_merge_new": """
WITH h AS (SELECT doc_id, upper(sha256(text)) AS hash FROM documents),
n AS (SELECT min(doc_id) AS doc_id, hash FROM h WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM h WHERE doc_id % 2 = 0) GROUP BY hash),
u AS (SELECT doc_id, hash, 0 AS k FROM h WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, hash, 1 FROM n)
SELECT doc_id, hash, row_number() OVER (ORDER BY k, doc_id) - 1 AS position FROM u
""",
    "duplicate_pairs": "SELECT * FROM (SELECT upper(sha256(text)) AS hash, doc_id AS first, lead(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS second FROM documents) WHERE second IS NOT NULL",
    "first_per_key": "SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source",
    "changed_paragraphs": _VERSIONS + """,
s AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(edited, chr(10)) AS b FROM v)
SELECT doc_id, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS changed FROM s
""",
    "drift_issues": _VERSIONS + """
SELECT doc_id, code FROM (
  SELECT doc_id, 'BaselineTextChanged' AS code FROM v WHERE text <> edited UNION ALL SELECT doc_id, 'PageRoleChanged' FROM v WHERE lang <> new_lang
  UNION ALL SELECT doc_id, 'EmptyConfirmedText' FROM v WHERE trim(edited) = ''
  UNION ALL SELECT doc_id, 'ExtremeTextLengthChange' FROM v WHERE length(text) > 0 AND abs(length(edited) - length(text)) > greatest(20, length(text) // 2))
""",
    "utf16_slice": "SELECT doc_id, length(text)::INTEGER AS units, CASE WHEN length(text) >= 12 THEN substr(text, 4, 9) END AS part FROM documents",
}


def text_rules(spark, d):
    """Documents with line ends, blank lines, fences and marks put in by their number: what the text functions make of them."""
    k = F.col("doc_id")
    t = F.when(k % 3 == 0, F.replace("text", F.lit(". "), F.lit(".\r\n"))).when(k % 3 == 1, F.replace("text", F.lit(". "), F.lit("\n \n\r"))).otherwise(F.concat(F.lit("　\n"), "text", F.lit(" \t")))
    t = F.concat(F.when(k % 4 == 0, "[[CHAPTER:1]] ").when(k % 4 == 1, "[[PAGE:1]] ").otherwise(""), F.coalesce(t, F.lit("")))
    v = table(spark, d, "documents").select("doc_id", F.when(k % 50 == 7, " 　").otherwise(t).alias("t"))
    c = F.col("t")
    return v.select("doc_id", F.md5(tx.newlines(c)).alias("newlines_md5"), F.md5(tx.collapse_blank_lines(c)).alias("paragraphs_md5"), tx.bad_markers(c).alias("bad"), tx.is_blank(c).alias("blank"), F.md5(tx.strip(c)).alias("stripped_md5"), gate.unreadable(F.concat(c, F.when(k % 9 == 0, gate.UNREADABLE).otherwise(""))).alias("unreadable"))


def body_pages(spark, d):
    """Orders as pages by priority: those that have a place in the text, and those that give the document text."""
    roles = F.when(F.col("o_orderpriority") == "3-MEDIUM", "Illustration").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Blank").otherwise("Body")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), roles.alias("role"), (F.col("o_orderstatus") != "P").alias("included"), F.when(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 5 == 0, "　").otherwise("x")).alias("text"))
    return pages.body(o).select("page", pages.in_document(F.col("role"), F.col("text")).alias("in_document"))


def words_in_doubt(spark, d):
    """Lines as words: those of low confidence, and, by value, those that thin boxes are; thin boxes of one place are one."""
    w = _boxes(spark, d).withColumn("confidence", F.col("left") / 97)
    low = layout.low_confidence(w).select("page", F.lit("low").alias("kind"), "text", "left", "top")
    aids = layout.reading_aids(w, layout.thin_boxes(w, "page"), "page")
    return low.union(aids.select("page", F.lit("aid"), "text", "left", "top").distinct())


def replaced_pages(spark, d):
    """The lines of every seventh order are replaced by one each."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    some = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return pages.replaced(l, some.select("l_orderkey", F.lit(0).alias("l_linenumber"), F.lit(-1).cast("long").alias("l_partkey")), "l_orderkey", some)


QUERIES |= {f.__name__: f for f in (text_rules, body_pages, words_in_doubt, replaced_pages)}

SQL |= {
    "text_rules": r"""
WITH v AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN ' 　' ELSE CASE doc_id % 4 WHEN 0 THEN '[[CHAPTER:1]] ' WHEN 1 THEN '[[PAGE:1]] ' ELSE '' END || coalesce(CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', '.' || chr(13) || chr(10)) WHEN 1 THEN replace(text, '. ', chr(10) || ' ' || chr(10) || chr(13)) ELSE '　' || chr(10) || text || ' ' || chr(9) END, '') END AS t FROM documents),
l AS (SELECT *, list_transform(regexp_split_to_array(t, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^[\s　]+|[\s　]+$', '', 'g')) AS ls FROM v),
p AS (SELECT *, regexp_replace(regexp_replace(array_to_string(list_transform(ls, lambda x: CASE WHEN x = '' THEN chr(10) ELSE x END), ''), '\n+', chr(10), 'g'), '^\n|\n$', '', 'g') AS para FROM l)
SELECT doc_id, md5(regexp_replace(t, '\r\n?', chr(10), 'g')) AS newlines_md5, md5(para) AS paragraphs_md5, doc_id % 4 = 1 AND doc_id % 50 <> 7 AS bad, regexp_matches(t, '^[\s　]*$') AS blank, md5(regexp_replace(t, '^[\s　]+|[\s　]+$', '', 'g')) AS stripped_md5, doc_id % 9 = 0 AS unreadable FROM p
""",
    "body_pages": "SELECT o_orderkey AS page, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS in_document FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('3-MEDIUM', '4-NOT SPECIFIED')",
    "words_in_doubt": _BOXES + """,
m AS (SELECT page, list_sort(list("right" - "left")) AS w FROM x GROUP BY page),
a AS (SELECT x.*, w[len(w) // 2 + 1] AS median FROM x JOIN m USING (page)),
t AS (SELECT a.*, text <> '、' AND "right" - "left" < median * 0.85 AND EXISTS (
  SELECT 1 FROM x b WHERE b.page = a.page AND b."right" - b."left" > a."right" - a."left" AND a.bottom > b.top AND a.top < b.bottom AND greatest(0, b."left" - a."right", a."left" - b."right") <= a.median) AS thin FROM a)
SELECT page, 'low' AS kind, text, "left", top FROM x WHERE "left" / 97 < 0.75
UNION ALL (SELECT DISTINCT page, 'aid', text, "left", top FROM (SELECT page, text, "left", top, "right", bottom FROM t WHERE thin EXCEPT SELECT page, text, "left", top, "right", bottom FROM t WHERE NOT thin))
""",
    "replaced_pages": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) UNION ALL SELECT o_orderkey, 0, -1 FROM orders WHERE o_orderkey % 7 = 0",
}
