"""Views that put several tables together for one purpose: documents, batches, page states, preflight, runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..functions import text as tx
from . import annotations, assemble, layout, pages, render, state
from .transitions import AID, BODY

#: The engine whose rows hold an older program's merged text, and what a failed step may be called by its worker.
MERGED_ENGINE = "legacy-merged"
WORKER_STAGES = ("PaddleOCR", "Tesseract")
PICTURE_ALT = "挿絵"


def _lists(df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str) -> DataFrame:
    """(keys, out): an array of the fields in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["_v"]).alias(out))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def effective_readings(rows: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, conflicts) of annotations (batch, paragraph, start, length, reading, status, updated, id) by snapshot; batches (batch, snapshot, exported).

    Of the best status of a range the latest holds, by its update, its batch's export and its id.
    """
    both = rows.join(batches.select("batch", "snapshot", "exported"), "batch")
    return state.effective(both, ["snapshot", "paragraph", "start", "length"], "status", "reading", ["updated", "exported", "id"])


def structured(paragraphs: DataFrame, spans: DataFrame, rows: DataFrame, batches: DataFrame) -> DataFrame:
    """paragraphs (snapshot, paragraph, ordinal, role, plain_text, ...) with spans and inlines, the readings that hold as runs.

    spans: (snapshot, paragraph, ordinal, page, start, length); rows and batches as for effective_readings().  Only confirmed
    readings are composed; their base text is the paragraph's own.
    """
    keys = ["snapshot", "paragraph"]
    held, _ = effective_readings(rows, batches)
    text = paragraphs.select(*keys, "plain_text")
    marks = held.where("status = 'Confirmed'").select(*keys, "start", "length", "reading", "status").join(text, keys)
    marks = marks.withColumn("base_text", tx.unit_slice(F.col("plain_text"), F.col("start"), F.col("length"))).drop("plain_text")
    return render.compose(_with(paragraphs, _lists(spans, keys, ["ordinal"], ["page", "start", "length"], "spans"), keys), marks, keys)


def batch(batches: DataFrame, batch_pages: DataFrame, found: DataFrame) -> DataFrame:
    """batches (batch, ...) with pages, a map of marker to page, and candidates in the order of marker and place; a candidate without a reading gives its text."""
    of = found.withColumn("reading", F.coalesce("reading_candidate", "ocr_text"))
    markers = batch_pages.groupBy("batch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("marker", "page")))).alias("pages"))
    both = _with(_with(batches, markers, ["batch"]), _lists(of, ["batch"], ["marker", "place"], ["marker", "reading", "base"], "candidates"), ["batch"])
    return both.withColumns({"pages": F.coalesce("pages", F.create_map().cast("map<string,bigint>")), "candidates": F.coalesce("candidates", F.array().cast(both.schema["candidates"].dataType))})


def page_states(all_pages: DataFrame, words: DataFrame, manual: DataFrame, auxiliary: DataFrame, proposals: DataFrame, versions: DataFrame) -> DataFrame:
    """(page, manual, auxiliary, suggested, confirmed, confirmed_at, merged, n_words, known) for each page.

    words: (page, id, text, engine, known).  Rows of an older program's merged text are no words: the first is the page's merged
    text, and the places of the page's words are then not known.  confirmed is the newest version that no manual text is
    newer than.
    """
    old = F.col("engine") == MERGED_ENGINE
    w = words.groupBy("page").agg(F.min_by(F.when(old, F.col("text")), F.when(old, F.col("id"))).alias("merged"), F.count_if(~old).alias("n_words"), F.bool_and(~old & F.col("known")).alias("known"))
    confirmed = state.active_text(versions.where("kind = 'Confirmed'").select("page", "text", "at", "seq"), manual, "page", "at", ["seq"])
    parts = [w, manual.select("page", F.col("text").alias("manual")), auxiliary.select("page", F.col("text").alias("auxiliary")), proposals.select("page", F.col("text").alias("suggested")), confirmed.select("page", F.col("text").alias("confirmed"), F.col("at").alias("confirmed_at"))]
    out = all_pages.select("page")
    for p in parts:
        out = _with(out, p, ["page"])
    return out.withColumns({"n_words": F.coalesce("n_words", F.lit(0)).cast("long"), "known": F.coalesce("known", F.lit(True))})


def preflight(rows: DataFrame, book: str, readings: DataFrame, unresolved: DataFrame, pictures: DataFrame, issues: DataFrame) -> DataFrame:
    """(book, counts, others, requires_confirmation, fatal): what an export would put out, and whether it must be asked about first.

    rows: (book, page, role, included, text, confirmed) of all pages; readings: (book, status) of those that hold; unresolved,
    pictures: a row each of a book; issues: (book, fatal).  others are the pages of role Other that have text.
    """
    body = rows.where(F.col("included") & ~F.col("role").isin(*pages.PICTURES))
    goes = pages.in_document(F.col("role"), F.col("text"))
    a = body.groupBy(book).agg(
        F.count_if(goes).alias("included_pages"), F.count_if(tx.is_blank(F.col("text"))).alias("empty_pages"), F.count_if(F.col("confirmed").isNull()).alias("unproofread"),
        F.array_sort(F.collect_list(F.when(goes & (F.col("role") == "Other"), F.col("page")))).alias("others"),
    )
    r = readings.groupBy(book).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Confirmed", "Proposed", "Stale")))
    n = lambda df, name: df.groupBy(book).agg(F.count("*").alias(name))
    i = issues.groupBy(book).agg(F.count("*").alias("issues"), F.coalesce(F.bool_or("fatal"), F.lit(False)).alias("fatal"))
    out = rows.select(book).distinct()
    for part in (a, r, n(unresolved, "unresolved"), n(pictures, "illustrations"), i):
        out = _with(out, part, [book])
    counts = ["included_pages", "empty_pages", "unproofread", "confirmed", "proposed", "stale", "unresolved", "illustrations", "issues"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"fatal": F.coalesce("fatal", F.lit(False)), "others": F.coalesce("others", F.array().cast(rows.schema["page"].dataType.simpleString().join(("array<", ">"))))})
    ask = [F.col(c) > 0 for c in counts if c not in ("included_pages", "confirmed")]
    any_of = F.size("others") > 0
    for cond in ask:
        any_of = any_of | cond
    return out.withColumn("requires_confirmation", any_of)


def evidence_lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, marker, line, place): the recognised candidates that bear on each annotation (id, markers, reading, base), the surest link first.

    found: (marker, ocr_reading, candidate_base, left, top, right, bottom, confidence, link).  Readings are compared as they
    are pronounced; a candidate without a base goes with any.
    """
    number = lambda name: F.format_string("%.2f", name)
    line = F.concat_ws(" ", "marker", *(number(x) for x in ("left", "top", "right", "bottom", "confidence")), F.when(F.col("link").isNull(), "-").otherwise(number("link")))
    a = rows.select("id", "base", seq.reading_key(F.col("reading")).alias("_key"), F.explode(F.array_distinct("markers")).alias("marker"))
    # A line is made once for a candidate, not for each of its pairs.
    c = found.select("marker", seq.reading_key(F.col("ocr_reading")).alias("_own"), "candidate_base", "left", "top", F.coalesce("link", F.lit(0.0)).alias("_link"), line.alias("line"))
    both = a.join(c, "marker").where((F.col("_key") == F.col("_own")) & (F.col("candidate_base").isNull() | (F.col("candidate_base") == F.col("base"))))
    w = Window.partitionBy("id").orderBy(F.desc("_link"), "marker", "left", "top")
    return both.select("id", "marker", "line", (F.row_number().over(w) - 1).alias("place"))


def reading_candidates(words: DataFrame, page: str) -> DataFrame:
    """(page, id, text, returned, included, body, link): words that are reading aids, or were until put back by hand, with the body word that fits best.

    words: page, id, text, left, top, right, bottom, role, automatic_role, manual_override, included.  Only words that are body
    by nature and by hand can be linked to.
    """
    back = (F.col("role") == BODY) & F.col("manual_override") & (F.col("automatic_role") == AID)
    chosen = words.where((F.col("role") == AID) | back)
    linked = layout.nearest_links(chosen, words.where((F.col("role") == BODY) & (F.col("automatic_role") == BODY)), page).select(F.col(page).alias("_p"), F.col("id").alias("_i"), "body", F.col("confidence").alias("link"))
    both = chosen.join(linked, (F.col(page) == F.col("_p")) & (F.col("id") == F.col("_i")), "left")
    return both.select(page, "id", "text", (F.col("role") == BODY).alias("returned"), "included", "body", "link")


def raw_ordinals(words: DataFrame, page: str, tolerance: float = 20.0) -> DataFrame:
    """(page, place, id): a page's words in reading order, thin boxes left out; id is the place in which they were found.

    The id travels with each word, so that equal words at one place are two words and nothing is looked up by value.
    """
    kept = layout.thin_boxes(words, page)
    placed = layout.reading_order(kept.select(page, "id", ((F.col("left") + F.col("right")) / 2).alias("x"), F.col("top").alias("y")), page, tolerance)
    w = Window.partitionBy(page).orderBy("column", "place")
    return placed.select(page, (F.row_number().over(w) - 1).alias("place"), "id")


def outcomes(results: DataFrame) -> DataFrame:
    """(page, kind, stage, exception, retryable, cancelled) of a run's results, one a page: failures are rows.

    results: (page, stage, error, worker_stage, worker_type, worker_retry, io, cancelled); error is null where all went well,
    stage is the step that was being done.  A failure of the second engine alone leaves the page to be reviewed.  A worker that
    names one of the engines is believed; a cancelled page can always be tried again, else the worker says so, or it was an
    I/O error.
    """
    second = F.col("stage") == WORKER_STAGES[1]
    named = F.when(F.col("worker_stage").isin(*WORKER_STAGES) & ~second, F.col("worker_stage")).otherwise(F.col("stage"))
    bad, cancelled = F.col("error").isNotNull(), F.coalesce("cancelled", F.lit(False))
    own, io = F.col("worker_retry"), F.coalesce("io", F.lit(False))
    retry = F.when(cancelled, True).when(second, io | F.coalesce(own, F.lit(False))).otherwise(F.coalesce(own, io))
    kind = F.when(~bad, "Completed").when(second & ~cancelled, "ReviewRequired").otherwise("Failed")
    when = lambda c: F.when(bad, c)
    return results.select("page", kind.alias("kind"), when(F.when(cancelled, F.col("stage")).otherwise(named)).alias("stage"), when(F.coalesce("worker_type", "error")).alias("exception"), when(retry).alias("retryable"), when(cancelled).alias("cancelled"))


def illustrations(all_pages: DataFrame, book: str, order: str) -> DataFrame:
    """The included pages of pictures, numbered in each book, with the words that stand for them."""
    w = Window.partitionBy(book).orderBy(order)
    rows = all_pages.where(F.col("included") & (F.col("role") == "Illustration")).withColumn("number", F.row_number().over(w))
    return rows.withColumn("alt", F.concat_ws(" ", F.lit(PICTURE_ALT), "number"))


class Prepared(NamedTuple):
    """paragraphs with logical_key and id, spans, documents (book, hash, snapshot), and the paragraphs that two ways of assembly disagree on."""

    paragraphs: DataFrame
    spans: DataFrame
    documents: DataFrame
    diverged: DataFrame


def prepared(sources: DataFrame, book: str, order: str, text: str, join: str, known_paragraphs: DataFrame, known_documents: DataFrame, new_id: Column) -> Prepared:
    """A book's pages (book, order, text, join) as a document with stable ids.

    Paragraphs come from the joined text, spans from the pages; where a paragraph's spans do not add up to its length the two
    have diverged, and nothing may be written.  An id is that of the newest known paragraph of the same logical key (book,
    logical_key, id, created, seq), a snapshot that of the newest known document of the same hash (book, hash, snapshot, created).
    """
    from .transitions import stable_ids

    paras = assemble.paragraphs_of_pages(sources, book, order, text, join)
    spans = assemble.source_spans(sources, book, order, text, join)
    total = spans.groupBy(book, "ordinal").agg(F.sum("length").alias("_n"), F.min("page").alias("_page"))
    both = paras.join(total, [book, "ordinal"], "left")
    diverged = both.where(F.coalesce("_n", F.lit(0)) != F.col("length")).select(book, "ordinal")
    keyed = assemble.logical_keys(both, book, "ordinal", F.col("_page"), F.col("role")).drop("_n", "_page")
    named = stable_ids(keyed, known_paragraphs, book, "logical_key", new_id)
    hashes = assemble.document_hash(paras, book, "ordinal", [F.col("role"), F.col("plain_text")])
    last = state.latest(known_documents.select(book, "hash", "snapshot", "created"), [book, "hash"], ["created", "snapshot"]).select(book, "hash", "snapshot")
    return Prepared(named, spans, hashes.join(last, [book, "hash"], "left"), diverged)


def latest_review(batches: DataFrame, rows: DataFrame, project: str) -> DataFrame:
    """The annotations of each project's newest batch that has any: what a review is built anew from.  batches: project, batch, exported."""
    some = batches.join(rows.select("batch").distinct(), "batch", "left_semi")
    return rows.join(state.latest(some.select(project, "batch", "exported"), [project], ["exported", "batch"]).select("batch"), "batch", "left_semi")


def revalidated(rows: DataFrame, paragraphs: DataFrame, batch_pages: DataFrame, found: DataFrame, policy: Column, new_id: Column) -> DataFrame:
    """(batch, pos, id, code): the validator's issues once the rows have ids, those of an import new ones, so that issues and rows meet by id."""
    found = annotations.judged(rows, paragraphs, batch_pages, found, policy)
    named = found.withColumn("id", F.coalesce("id", new_id) if "id" in rows.columns else new_id)
    return named.select("batch", "pos", F.explode("codes").alias("code"), "id")


def batch_id(json: Column) -> Column:
    """The batch that a returned file names, null if it is no JSON or names none in the usual form."""
    found = F.get_json_object(json, "$.batchId")
    return F.when(found.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.lower(found))


def reason_lines(counts: Column) -> Column:
    """A map of reason to number as lines, in the order of the reasons."""
    return F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"), F.lit(" 件")))


def percent(share: Column) -> Column:
    """A share in whole per cent, halves up."""
    return F.concat(F.round(share * 100).cast("long").cast("string"), F.lit("%"))


def raise_half_points(font_half_points: Column, offset_points: Column) -> Column:
    """How far a reading is raised, in half points: the font's size and twice the offset; null beyond 32 bits."""
    total = font_half_points.cast("long") + offset_points.cast("long") * 2
    return F.when(total.between(-(1 << 31), (1 << 31) - 1), total.cast("int"))


def document_path(folder: str, book: str) -> str:
    """Where a book's document is: in its folder, under the book's name."""
    return f"{folder.rstrip('/')}/{book}/{book}.docx"


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
