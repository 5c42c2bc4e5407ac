"""Transitions that reach over several tables.

Each takes the tables as they are and returns them as they are afterwards, with the history rows to append: nothing is changed
in place, so a repeated run gives the same tables.  Annotations have id, batch, paragraph, start, length, status, source.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges, state

#: The statuses that a change makes stale, the source that rests on an image, the kinds of text that can be restored.
OPEN = ("Proposed", "Confirmed")
IMAGE_SOURCE = "ImageConfirmed"
RESTORABLE = ("Manual", "Confirmed")
#: Where a version that was taken up again says it comes from.
RESTORED_FROM = "HistoryRestore"
#: The roles of a recognised word, and the sources of review items that recognition itself writes.
BODY, AID = "Body", "RubyCandidate"
RECOGNISED = ("OCR", "Merge", "Ruby")


class Staled(NamedTuple):
    """annotations after a change, the rows as they were before it, and the batches whose text is no longer the confirmed one."""

    annotations: DataFrame
    history: DataFrame
    batches: DataFrame


def _marked(df: DataFrame, key: str, hits: DataFrame, name: str = "_hit") -> DataFrame:
    """df with a boolean: whether its key is among the hits' first column."""
    h = hits.select(F.col(hits.columns[0]).alias("_h")).where("_h is not null").distinct()
    return df.join(h, F.col(key) == F.col("_h"), "left").withColumn(name, F.col("_h").isNotNull()).drop("_h")


def staled(annotations: DataFrame, hits: DataFrame, among: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations, history): those with an id among hits that are open, and meet among, become Stale and leave a row of history."""
    rule = F.col("_hit") & F.col("status").isin(*OPEN)
    marked = _marked(annotations, "id", hits).withColumn("_hit", rule if among is None else rule & among)
    after = marked.withColumn("status", F.when(F.col("_hit"), "Stale").otherwise(F.col("status"))).drop("_hit")
    return after, marked.where("_hit").drop("_hit")


def _flagged(batches: DataFrame, batch_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """batches (id, text_stale, ...), flagged where one of their pages is among pages."""
    hit = batch_pages.join(pages.select(F.col(pages.columns[0]).alias("page")).distinct(), "page", "left_semi").select("batch")
    return _marked(batches, "id", hit).withColumn("text_stale", F.col("text_stale") | F.col("_hit")).drop("_hit")


def structure_changed(annotations: DataFrame, batches: DataFrame, batch_pages: DataFrame, pages: DataFrame) -> Staled:
    """Pages came, went, moved or changed their role or boundary: all open annotations of the batches that hold one become stale."""
    after = _flagged(batches, batch_pages, pages)
    hit = batch_pages.join(pages.select(F.col(pages.columns[0]).alias("page")).distinct(), "page", "left_semi").select(F.col("batch").alias("_b")).distinct()
    ids = annotations.join(hit, F.col("batch") == F.col("_b"), "left_semi").select("id")
    return Staled(*staled(annotations, ids), after)


def all_changed(annotations: DataFrame, batches: DataFrame) -> Staled:
    """A page was removed: every open annotation becomes stale, every batch is flagged."""
    return Staled(*staled(annotations, annotations.select("id")), batches.withColumn("text_stale", F.lit(True)))


def image_changed(annotations: DataFrame, batches: DataFrame, evidence: DataFrame, pages: DataFrame) -> Staled:
    """Only the picture of a page changed: open annotations that rest on an image and cite the page (annotation, page) become stale."""
    ids = evidence.join(pages.select(F.col(pages.columns[0]).alias("page")).distinct(), "page", "left_semi").select("annotation")
    return Staled(*staled(annotations, ids, F.col("source") == IMAGE_SOURCE), batches)


def body_changed(annotations: DataFrame, batches: DataFrame, spans: DataFrame, batch_pages: DataFrame, texts: DataFrame) -> Staled:
    """texts (page, before, after): where they differ, open annotations of paragraphs with a span (paragraph, page) on the page become stale."""
    pages = texts.where(~F.col("before").eqNullSafe(F.col("after"))).select("page").distinct()
    paragraphs = spans.join(pages, "page", "left_semi").select(F.col("paragraph").alias("_p")).distinct()
    ids = annotations.join(paragraphs, F.col("paragraph") == F.col("_p"), "left_semi").select("id")
    return Staled(*staled(annotations, ids), _flagged(batches, batch_pages, pages))


def impact_of(old: DataFrame, new: DataFrame, key: str, structure: list[str], image: list[str], counts: Column) -> DataFrame:
    """(key, impact) of the pages saved: structure before image, a new page is structure if counts says that it has a place in the text."""
    o, n = old.select(F.col(key).alias("_k"), F.struct(*structure).alias("_s"), F.struct(*image).alias("_i")), new.select(key, F.struct(*structure).alias("s"), F.struct(*image).alias("i"), counts.alias("c"))
    both = n.join(o, F.col(key) == F.col("_k"), "left")
    impact = F.when(F.col("_k").isNull(), F.when(F.col("c"), "structure")).when(~F.col("s").eqNullSafe(F.col("_s")), "structure").when(~F.col("i").eqNullSafe(F.col("_i")), "image")
    return both.select(key, F.coalesce(impact, F.lit("none")).alias("impact"))


def pages_saved(annotations: DataFrame, batches: DataFrame, batch_pages: DataFrame, evidence: DataFrame, impacts: DataFrame) -> Staled:
    """What saving pages does to annotations, by the impact of each page: structure comes first where both changed."""
    pages = lambda kind: impacts.where(F.col("impact") == kind).select(impacts.columns[0])
    first = structure_changed(annotations, batches, batch_pages, pages("structure"))
    then = image_changed(first.annotations, first.batches, evidence, pages("image"))
    return Staled(then.annotations, first.history.unionByName(then.history), then.batches)


def confirmed_in_order(annotations: DataFrame, saved: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, history) after saved (id, place) were confirmed one after the other.

    Each makes stale what is confirmed and overlaps it in the same paragraph and snapshot (batch, snapshot).  So a row ends
    stale if the last place of those that overlap it is after its own, and rows not in saved count as confirmed before: no
    loop, and no pairs.  Half-open ranges.
    """
    s = annotations.join(saved.select(F.col("id").alias("_i"), "place"), F.col("id") == F.col("_i"), "left").drop("_i").join(snapshots, "batch", "left")
    now = s.withColumn("status", F.when(F.col("place").isNotNull(), "Confirmed").otherwise(F.col("status")))
    held = now.where("status = 'Confirmed'").select("id", "paragraph", "snapshot", "start", "length", "place")
    last = ranges.best_overlapping(held, held.where("place is not null"), ["paragraph", "snapshot"], ["id", "place"], "start", "length", "place", F.max)
    out, history = staled(now.drop("snapshot", "place"), last.where("place is null or place < best").select("id"))
    return out, history


def reviewed(annotations: DataFrame, saved: DataFrame, snapshots: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, history, unknown) of a review: saved (id, place, fields) replaces the fields of each annotation.

    Rows that differ in none are left as they are, without history; those saved as Confirmed make stale what they overlap, in
    the order of place.  unknown are the ids that no annotation has: with any of these nothing may be written.
    """
    new = saved.select(F.col("id").alias("_i"), F.struct(*fields).alias("_new"))
    both = annotations.join(new, F.col("id") == F.col("_i"), "left").withColumn("_changed", F.col("_i").isNotNull() & ~F.struct(*fields).eqNullSafe(F.col("_new")))
    history = both.where("_changed").select(*annotations.columns)
    now = both.select(*(F.when(F.col("_changed"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in annotations.columns))
    out, more = confirmed_in_order(now, saved.where("status = 'Confirmed'").select("id", "place"), snapshots)
    unknown = saved.join(annotations.select(F.col("id").alias("_a")), F.col("id") == F.col("_a"), "left_anti").select("id")
    return out, history.unionByName(more.select(*annotations.columns)), unknown


class Restored(NamedTuple):
    """Manual texts (page, text, at), versions to append, statuses (page, status), pages whose annotations become stale, rows of no known kind."""

    manual: DataFrame
    versions: DataFrame
    statuses: DataFrame
    changed: DataFrame
    refused: DataFrame


def restored_versions(wanted: DataFrame, versions: DataFrame, selected: DataFrame, at: Column) -> Restored:
    """Old versions (page, kind, text) taken up again, at most one a page, as new ones at the end of the log (page, kind, text, seq).

    A version equal to the page's newest of its kind is not appended again.  A manual one is the page's manual text from now
    on; the page's status follows the kind.  Where the selected text (page, text) differs, the page has changed.
    """
    good, refused = wanted.where(F.col("kind").isin(*RESTORABLE)), wanted.where(~F.col("kind").isin(*RESTORABLE) | F.col("kind").isNull())
    last = state.latest(versions.select("page", "kind", "text", "seq"), ["page", "kind"], ["seq"]).select(F.col("page").alias("_p"), F.col("kind").alias("_k"), F.col("text").alias("_t"))
    both = good.join(last, (F.col("page") == F.col("_p")) & (F.col("kind") == F.col("_k")), "left")
    fresh = both.where(F.col("_p").isNull() | ~F.col("_t").eqNullSafe(F.col("text"))).select("page", "kind", "text", F.lit(RESTORED_FROM).alias("source"), at.alias("at"))
    now = selected.select(F.col("page").alias("_p"), F.col("text").alias("_t"))
    changed = good.join(now, F.col("page") == F.col("_p"), "left").where(~F.coalesce("_t", F.lit("")).eqNullSafe(F.col("text"))).select("page")
    statuses = good.select("page", F.when(F.col("kind") == "Manual", "ManuallyEdited").otherwise("Confirmed").alias("status"))
    return Restored(good.where("kind = 'Manual'").select("page", "text", at.alias("at")), fresh, statuses, changed, refused)


def stable_ids(paragraphs: DataFrame, known: DataFrame, project: str, key: str, new_id: Column) -> DataFrame:
    """paragraphs with id: that of the newest known paragraph (project, key, id, created, seq) of the same logical key, else new_id."""
    last = state.latest(known.select(project, key, "id", "created", "seq"), [project, key], ["created", "seq"])
    k = last.select(F.col(project).alias("_p"), F.col(key).alias("_k"), F.col("id").alias("_id"))
    both = paragraphs.join(k, F.col(project).eqNullSafe(F.col("_p")) & (F.col(key) == F.col("_k")), "left")
    return both.withColumn("id", F.coalesce("_id", new_id)).drop("_p", "_k", "_id")


class Overridden(NamedTuple):
    words: DataFrame
    overrides: DataFrame
    reviews: DataFrame
    pages: DataFrame
    refused: DataFrame


def overridden(words: DataFrame, overrides: DataFrame, reviews: DataFrame, pages: DataFrame, edits: DataFrame) -> Overridden:
    """Roles set by hand: edits (page, ordinal, role, included), at most one a word of words (page, ordinal, word_key, role, included, manual, text).

    The edit is kept by the word's key, for later runs too.  The page's review items of aids are made anew, its items counted
    (pages: page, status, reviews) and its status set by them.  Edits of unknown words or roles are refused.
    """
    e = edits.select(F.col("page").alias("_p"), F.col("ordinal").alias("_o"), F.col("role").alias("_role"), F.col("included").alias("_in"))
    fit = e.join(words.select("page", "ordinal", "word_key"), (F.col("page") == F.col("_p")) & (F.col("ordinal") == F.col("_o"))).where(F.col("_role").isin(BODY, AID))
    refused = e.join(fit.select(F.col("_p").alias("p2"), F.col("_o").alias("o2")), (F.col("_p") == F.col("p2")) & (F.col("_o") == F.col("o2")), "left_anti").select(F.col("_p").alias("page"), F.col("_o").alias("ordinal"))
    ok = fit.select("_p", "_o", "_role", "_in", F.col("word_key").alias("_key"))
    both = words.join(ok.drop("_key"), (F.col("page") == F.col("_p")) & (F.col("ordinal") == F.col("_o")), "left")
    now = both.withColumns({"role": F.coalesce("_role", "role"), "included": F.coalesce("_in", "included"), "manual": F.col("manual") | F.col("_p").isNotNull()}).select(*words.columns)
    last = ok.groupBy(F.col("_p").alias("page"), F.col("_key").alias("word_key")).agg(F.max_by(F.struct("_role", "_in"), "_o").alias("_r")).select("page", "word_key", F.col("_r._role").alias("role"), F.col("_r._in").alias("included"))
    kept = overrides.join(last.select(F.col("page").alias("p2"), F.col("word_key").alias("k2")), (F.col("page") == F.col("p2")) & (F.col("word_key") == F.col("k2")), "left_anti").unionByName(last)
    touched = ok.select(F.col("_p").alias("page")).distinct()
    rest = _marked(reviews, "page", touched).where(~(F.col("_hit") & (F.col("source") == "Ruby"))).drop("_hit")
    made = now.join(touched, "page", "left_semi").where(F.col("role") == AID).select("page", F.lit("RubyCandidate").alias("code"), F.lit("Ruby").alias("source"), "text")
    items = rest.unionByName(made.select(*reviews.columns))
    counts = items.join(touched, "page", "left_semi").groupBy(F.col("page").alias("_p")).agg(F.count("*").alias("_n"), F.count_if(F.col("source").isin(*RECOGNISED)).alias("_open"))
    p = _marked(pages, "page", touched).join(counts, F.col("page") == F.col("_p"), "left")
    status = F.when(F.coalesce("_open", F.lit(0)) > 0, "ReviewRequired").otherwise("Completed")
    p = p.withColumns({"reviews": F.when(F.col("_hit"), F.coalesce("_n", F.lit(0)).cast("long")).otherwise(F.col("reviews")), "status": F.when(F.col("_hit"), status).otherwise(F.col("status"))}).select(*pages.columns)
    return Overridden(now, kept, items, p, refused)


def failed(pages: DataFrame, failures: DataFrame, words: DataFrame, reviews: DataFrame) -> DataFrame:
    """pages (page, status) after failures (page, cancelled, before, at, seq): the newest of each page counts.

    A failure marks the page Failed.  A cancelled run puts back the status from before, or, where that is not known, the one
    that the page's words and open review items give.
    """
    last = state.latest(failures.select("page", "cancelled", "before", "at", "seq"), ["page"], ["at", "seq"])
    hit = state.restored_status(pages.select("page"), "page", words.select("page"), reviews.where(F.col("source").isin(*RECOGNISED)).select("page")).select(F.col("page").alias("_p"), F.col("status").alias("_made"))
    both = pages.join(last.select(F.col("page").alias("_f"), "cancelled", "before"), F.col("page") == F.col("_f"), "left").join(hit, F.col("page") == F.col("_p"))
    status = F.when(F.col("_f").isNull(), F.col("status")).when(F.col("cancelled"), F.coalesce("before", "_made")).otherwise("Failed")
    return both.withColumn("status", status).select(*pages.columns)


def newest_failures(failures: DataFrame) -> DataFrame:
    """failures in each page's order, the newest first, as position from 0."""
    from pyspark.sql import Window

    return failures.withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("at"), F.desc("seq"))) - 1)
