"""What one action writes: the rows to append to, or to put in place of those of, several tables.

An action gives a dict of table name to rows.  Nothing here touches storage.  A store commits all tables of an action as one version
(changes); where there is none, a caller writes the tables and, last of all, the row that makes them count (published).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.store import Append, Change, Put, View, Whole
from ..sources.tables import written
from . import layout, pages, state
from .transitions import AID

LEAST_CONFIDENCE = 0.75
Tables = dict[str, DataFrame]


def content_id(*parts: Column) -> Column:
    """An id made of what it names, so that a repeated run makes the same one."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def project_ids(books: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """books with project: the known id (key, project), else one made of the key."""
    k = known.select(F.col(key).alias("_k"), F.col("project").alias("_project"))
    return books.join(k, F.col(key) == F.col("_k"), "left").withColumn("project", F.coalesce("_project", content_id(F.lit("project"), F.col(key)))).drop("_k", "_project")


def fresh(rows: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows whose keys are not known, the first of each: an insert that ignores conflicts."""
    return state.first_per_key(rows, keys, order).join(known.select(*keys).distinct(), keys, "left_anti")


def snapshot(documents: DataFrame, paragraphs: DataFrame, spans: DataFrame, known: DataFrame, at: Column) -> Tables:
    """A document's snapshot, its paragraphs and their spans; one that has a snapshot (project, hash, id, created) is not written again.

    documents (project, hash, source), at most one row of each; paragraphs (project, hash, ordinal, ...); spans (project, hash,
    paragraph, ...).  ids: the id that each document has now, old or new.
    """
    old = state.latest(known.select("project", "hash", "id", "created"), ["project", "hash"], ["created", "id"]).select("project", "hash", F.col("id").alias("snapshot"))
    new = fresh(documents, known, ["project", "hash"], ["source"]).withColumn("snapshot", content_id(F.col("project"), F.col("hash")))
    ids = old.unionByName(new.select("project", "hash", "snapshot")).join(documents.select("project", "hash").distinct(), ["project", "hash"], "left_semi")
    named = new.select("project", "hash", "snapshot")
    return {
        "snapshots": new.select(F.col("snapshot").alias("id"), "project", "hash", "source", at.alias("created")), "paragraphs": paragraphs.join(named, ["project", "hash"]).drop("project", "hash"),
        "spans": spans.join(named, ["project", "hash"]).drop("project", "hash"), "ids": ids,
    }


def batch_record(batches: DataFrame, batch_pages: DataFrame, found: DataFrame, at: Column) -> Tables:
    """A batch as it goes out: itself, its pages by marker, its candidates."""
    return {
        "batches": batches.select("id", "project", "snapshot", "policy", F.lit(False).alias("text_stale"), at.alias("exported")),
        "batch_pages": batch_pages.select("batch", "page", "marker"), "batch_candidates": found.withColumn("version", F.lit(2)),
    }


def export_record(wanted: DataFrame, current: DataFrame, at: Column) -> Tables:
    """Pages that go out for proofreading: wanted (batch, place, page) with what each is now, under the marker of its place from 0.

    current: page, text, text_source, source_hash, crop, rotation, role, profile, sort_order, run.  A page that is not there is
    refused; then its batch writes nothing.
    """
    missing = wanted.join(current.select("page"), "page", "left_anti").select("batch", "page")
    good = wanted.join(missing.select("batch").distinct(), "batch", "left_anti").join(current, "page")
    out = good.select("batch", "page", tx.marker(F.col("place") + 1).alias("marker"), "source_hash", tx.text_hash(F.col("text")).alias("text_hash"), "text_source", "crop", "rotation", "role", "profile", "sort_order", "run")
    return {"exports": good.select("batch").distinct().withColumn("exported", at), "export_pages": out, "pages": good.select("page", F.lit("ExportedForProofreading").alias("status")), "refused": missing}


def run_rows(words: DataFrame, overrides: DataFrame, engine: str, at: Column, thin: bool) -> tuple[DataFrame, DataFrame]:
    """(runs, run words) of recognised words (page, id, text, confidence, left, top, right, bottom).

    With thin, boxes that look like reading aids get that role and stay out of the draft; what was set by hand for a word, by
    its key, comes before.  A page's run is one row with the number of its words.
    """
    runs = words.groupBy("page").agg(F.count("*").alias("word_count")).select(content_id(F.lit(engine), F.col("page"), at).alias("run"), "page", F.lit(engine).alias("engine"), at.alias("executed"), "word_count")
    aid = F.lit(False)
    rows = words
    if thin:
        kept = layout.thin_boxes(words, "page").select(F.col("page").alias("_p"), F.col("id").alias("_i"))
        rows, aid = words.join(kept, (F.col("page") == F.col("_p")) & (F.col("id") == F.col("_i")), "left"), F.col("_i").isNull()
    key = tx.word_key(F.col("text"), [F.col(c) for c in ("left", "top", "right", "bottom")])
    rows = rows.withColumns({"word_key": key, "role": F.when(aid, AID).otherwise("Body"), "included": ~aid})
    rows = rows.drop("_p", "_i") if thin else rows
    return runs, pages.with_overrides(rows, overrides, "page").join(runs.select("page", "run"), "page")


def analysis(words: DataFrame, auxiliary: DataFrame, proposals: DataFrame, operations: DataFrame, notes: DataFrame, overrides: DataFrame, was: DataFrame, at: Column) -> Tables:
    """All that the recognition of pages writes: words, runs, the other engine's text, proposals, operations, review items, page statuses.

    words as for run_rows; auxiliary (page, text); proposals (page, text); operations (page, ordinal, ...); notes (page, code,
    text) of the merge; was: (page, status).  The draft of a page that has words set by hand is rebuilt from those included.
    Words, operations and recognised review items take the place of the pages' old ones.  The words with their roles, which
    most of the tables are made of, are worked out once.
    """
    runs, found = run_rows(words, overrides, "paddle", at, True)
    found = written(found, "analysis-words")
    second = auxiliary.select("page", F.lit(0).cast("long").alias("id"), "text", F.lit(0.8).alias("confidence"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(1.0).alias("right"), F.lit(1.0).alias("bottom"))
    more_runs, more = run_rows(second, overrides, "tesseract", at, False)
    by_hand = found.where("manual_override").select("page").distinct()
    rebuilt = layout.page_texts(found.where("included").join(by_hand, "page", "left_semi").select("page", "id", "text", "left", "top", "right", "bottom"), "page", filtered=False)
    drafts = rebuilt.unionByName(by_hand.join(rebuilt.select("page"), "page", "left_anti").withColumn("text", F.lit("")))
    text = proposals.select("page", "text").join(by_hand, "page", "left_anti").unionByName(drafts.select("page", "text"))
    item = lambda df, code, source: df.select("page", (F.col("code") if code is None else F.lit(code)).alias("code"), F.lit(source).alias("source"), "text")
    reviews = item(notes, None, "Merge").unionByName(item(layout.low_confidence(words, LEAST_CONFIDENCE), "LowConfidence", "OCR")).unionByName(item(found.where(F.col("role") == AID), "RubyCandidate", "Ruby"))
    n = reviews.groupBy(F.col("page").alias("_p")).agg(F.count("*").alias("_n"))
    seen = was.join(runs.select(F.col("page").alias("_r"), "run"), F.col("page") == F.col("_r")).join(n, F.col("page") == F.col("_p"), "left")
    count = F.coalesce("_n", F.lit(0)).cast("long")
    status = seen.select("page", F.col("run").alias("last_run"), count.alias("reviews"), F.when(count == 0, "Completed").otherwise("ReviewRequired").alias("ocr_status"), pages.status_after_recognition(F.col("status"), count).alias("status"))
    return {"words": words, "runs": runs.unionByName(more_runs), "run_words": found.unionByName(more), "auxiliary": auxiliary, "proposals": text, "operations": operations, "reviews": reviews, "pages": status}


def fallback(words: DataFrame, texts: DataFrame, failures: DataFrame, overrides: DataFrame, at: Column) -> Tables:
    """What is written where only the first engine succeeded: its words and run, its text as the proposal, the failure, and the page to be reviewed."""
    runs, found = run_rows(words, overrides, "paddle", at, False)
    status = runs.select("page", F.col("run").alias("last_run"), F.lit("ReviewRequired").alias("ocr_status"))
    return {"words": words, "runs": runs, "run_words": found, "proposals": texts.select("page", "text"), "failures": failures.withColumn("cancelled", F.lit(False)), "pages": status}


#: What names an annotation, and what may change in it.
NATURAL = ["batch", "paragraph", "start", "length", "reading"]
TRACKED = ["base", "source", "confidence", "evidence", "status"]


def cited_pages(rows: DataFrame, batch_pages: DataFrame) -> DataFrame:
    """(id, page, marker) of the markers that rows (id, batch, markers) cite; markers that the batch has not are left out, repeats count once."""
    each = rows.select("id", "batch", F.explode(F.array_distinct("markers")).alias("marker"))
    return each.join(batch_pages.select("batch", "marker", "page"), ["batch", "marker"]).select("id", "page", "marker").distinct()


def annotation_import(old: DataFrame, given: DataFrame, batch_pages: DataFrame, cited: DataFrame, snapshots: DataFrame) -> Tables:
    """Annotations that came back (NATURAL, TRACKED, markers, place), into those there are (id, NATURAL, TRACKED).

    What names a known one changes it, with a row of history if a field differs; others are new, under an id made of their
    name.  The last of equal names counts.  Confirmed ones make stale what they overlap, in their order; their cited pages
    take the place of the old ones.
    """
    from .transitions import confirmed_in_order

    last = state.latest(given.select(*NATURAL, *TRACKED, "markers", "place"), NATURAL, ["place"])
    names = old.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in NATURAL), F.struct(*TRACKED).alias("_was"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "reading" else F.col(c) == F.col(f"_{c}") for c in NATURAL]
    both = last.join(names, same, "left").withColumn("id", F.coalesce("_id", content_id(*(F.col(c) for c in NATURAL))))
    changed = both.where(F.col("_id").isNotNull() & ~F.struct(*TRACKED).eqNullSafe(F.col("_was"))).select("id")
    history = old.join(changed, "id", "left_semi")
    now = old.join(both.select("id"), "id", "left_anti").unionByName(both.select("id", *NATURAL, *TRACKED))
    out, more = confirmed_in_order(now, both.where("status = 'Confirmed'").select("id", "place"), snapshots)
    evidence = cited.join(both.select("id"), "id", "left_anti").unionByName(cited_pages(both.select("id", "batch", "markers"), batch_pages))
    return {"annotations": out, "history": history.unionByName(more.select(*history.columns)), "evidence": evidence}


#: What of an action's tables is an answer to the caller, is the whole table, or takes the place of all that its pages had.
ANSWERS, WHOLE, OF_PAGES = ("ids", "refused"), ("annotations", "evidence"), ("words", "auxiliary", "proposals", "operations")
#: Review items of these sources are those of a page's last recognition.
REVIEWED = ("OCR", "Merge", "Ruby")


def changes(tables: Tables, view: View | None = None) -> dict[str, Change]:
    """The tables of an action as the changes of one version of a store; view: the version they were made on.

    What an action says of pages changes those columns of the pages that are there.  Words, texts and review items of a
    recognition take the place of what its pages had, also where there are none now.  All else is added.
    """
    touched = tables["pages"].select("page").distinct() if "pages" in tables else None
    out: dict[str, Change] = {}
    for name, rows in tables.items():
        if name == "pages" and view is not None:
            old = view.read(name)
            said = rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns))
            out[name] = Put(old.join(said, F.col("page") == F.col("_page")).select(*(F.col(f"_{c}").alias(c) if c in rows.columns else F.col(c) for c in old.columns)), ["page"])
        elif name == "reviews" and touched is not None:
            out[name] = Put(rows, ["page", "source"], touched.withColumn("source", F.explode(F.array(*map(F.lit, REVIEWED)))))
        elif name in OF_PAGES:
            out[name] = Put(rows, ["page"], touched)
        elif name in WHOLE:
            out[name] = Whole(rows)
        elif name not in ANSWERS:
            out[name] = Append(rows)
    return out


def published(tables: Tables, write) -> None:
    """Writes all tables by write(name, rows) and the one named ids, snapshots or exports, which makes them count, last."""
    last = [n for n in ("snapshots", "exports", "ids") if n in tables]
    for name in [*(n for n in tables if n not in last), *last]:
        write(name, tables[name])
