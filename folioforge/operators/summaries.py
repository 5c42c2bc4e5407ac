"""Counts and unions that screens and checks are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import assemble, rules, state
from .annotations import SURE

#: Statuses that cannot be confirmed, the reasons for it, the source of the validation's own review items.
DEAD = ("Stale", "Rejected")
ABORTED, NO_REASON = "VALIDATION_ABORTED", "POLICY_EXCLUDED"
VALIDATION = "PageValidation"
TARGETS = ("Failed", "Processing", "NotProcessed")


def batch_history(batches: DataFrame, annotations: DataFrame, unresolved: DataFrame, snapshots: DataFrame) -> DataFrame:
    """batches (id, project, snapshot, exported, text_stale) with their annotations in all and by status, their unresolved items, and whether their document is still the newest.

    annotations: (batch, status); unresolved: (batch); snapshots: (id, project, created, seq).  Every count is made before its join.
    """
    kinds = {s.lower(): F.count_if(F.col("status") == s) for s in ("Confirmed", "Proposed", "Stale")}
    a = annotations.groupBy(F.col("batch").alias("_a")).agg(F.count("*").alias("annotations"), *(c.alias(n) for n, c in kinds.items()))
    u = unresolved.groupBy(F.col("batch").alias("_u")).agg(F.count("*").alias("unresolved"))
    newest = state.latest(snapshots.select("project", "id", "created", "seq"), ["project"], ["created", "seq"]).select(F.col("project").alias("_p"), F.col("id").alias("_s"))
    both = batches.join(a, F.col("id") == F.col("_a"), "left").join(u, F.col("id") == F.col("_u"), "left").join(newest, F.col("project") == F.col("_p"), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("annotations", *kinds, "unresolved")}
    return both.withColumns(zero | {"current": F.coalesce((F.col("snapshot") == F.col("_s")) & ~F.col("text_stale"), F.lit(False))}).drop("_a", "_u", "_p", "_s")


def confirmation_summary(rows: DataFrame, issues: DataFrame, source: str, aborted: bool = False) -> DataFrame:
    """One row: examined, newly, already, wrong_source, excluded and reasons, a map of reason to number, of confirming at once all rows of a source.

    rows: (batch, pos, source, status, confidence, markers, evidence); issues: (batch, pos, code).  The first case that holds
    counts.  A row can be excluded for several reasons, each code once; aborted says that the validation failed, which then is
    the reason for all that are left.
    """
    i = issues.groupBy(F.col("batch").alias("_b"), F.col("pos").alias("_p")).agg(F.collect_list(F.coalesce("code", F.lit(""))).alias("codes"))
    return confirmation_counts(rows.join(i, (F.col("batch") == F.col("_b")) & (F.col("pos") == F.col("_p")), "left"), source, aborted)


def passed_over(source: str) -> Column:
    """What becomes of a row (source, status) that its issues do not matter to; null where they do."""
    return F.when(F.col("source") != source, "wrong_source").when(F.col("status") == "Confirmed", "already")


def confirmation_counts(rows: DataFrame, source: str, aborted: bool = False) -> DataFrame:
    """The same of rows (source, status, confidence, markers, evidence, codes) that hold their issues, codes null or empty where there are none or they do not matter."""
    none = F.array().cast("array<string>")
    own = {"LOW_ANNOTATION_CONFIDENCE": F.col("confidence") < SURE, "STATUS_NOT_ELIGIBLE": F.col("status").isin(*DEAD), "MISSING_EVIDENCE_PAGE": F.coalesce(F.size("markers"), F.lit(0)) <= 0, "MISSING_EVIDENCE": tx.is_blank(F.col("evidence"))}
    passed = passed_over(source)
    # Reasons are worked out once for a row, and only where it comes to them.
    both = rows.withColumn("_given", F.when(passed.isNull(), F.coalesce("codes", none)))
    every = F.array_distinct(F.concat(F.filter("_given", lambda c: ~tx.is_blank(c)), F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in own.items())))))
    both = both.withColumn("_codes", F.when(F.col("_given").isNotNull(), every))
    bad = (F.size("_given") > 0) | (F.size("_codes") > 0)
    outcome = F.coalesce(passed, F.when(F.lit(aborted) | bad, "excluded").otherwise("newly"))
    why = F.when(F.lit(aborted), F.array(F.lit(ABORTED))).when(F.size("_codes") > 0, F.col("_codes")).otherwise(F.array(F.lit(NO_REASON)))
    why = F.when(F.col("o") == "excluded", why)
    # A row stands once for each of its reasons, the first time for itself; a reason is one of a fixed set of codes, so that what is left is small.
    each = both.withColumn("o", outcome).select("o", F.posexplode_outer(why).alias("at", "reason")).groupBy("o", "reason").agg(F.count("*").alias("n"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("rows"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0)).cast("long")
    counts = [total(F.col("o") == k).alias(k) for k in ("newly", "already", "wrong_source", "excluded")]
    return each.agg(total(F.lit(True)).alias("examined"), *counts, F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons"))


def status_change(rows: DataFrame, keys: list[str], status: str, wanted: str) -> DataFrame:
    """(keys, selected, changed, already): what setting a status would do to the rows of each selection."""
    same = F.col(status).eqNullSafe(F.lit(wanted))
    return rows.groupBy(*keys).agg(F.count("*").alias("selected"), F.count_if(~same).alias("changed"), F.count_if(same).alias("already"))


def run_plan(pages: DataFrame, key: str, status: str, included: Column, mode: str) -> DataFrame:
    """(key, targets, completed, review_required, excluded, and the targets by status): how much a run would take and pass over."""
    taken = rules.resume_targets(pages, status, included, mode)
    resume = F.lit(mode == "ResumeIncomplete")
    a = taken.groupBy(key).agg(F.count("*").alias("targets"), *(F.count_if(F.col(status) == s).alias(s.lower()) for s in TARGETS))
    b = pages.groupBy(F.col(key).alias("_k")).agg(F.count_if(resume & included & (F.col(status) == "Completed")).alias("completed"), F.count_if(resume & included & (F.col(status) == "ReviewRequired")).alias("review_required"), F.count_if(resume & ~included).alias("excluded"))
    both = b.join(a, F.col(key) == F.col("_k"), "left").withColumn(key, F.col("_k")).drop("_k")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("targets", *(s.lower() for s in TARGETS))})


def outcome_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, succeeded, failures) of runs' outcomes (kind, stage): a page that is to be reviewed has both succeeded and failed in part."""
    return outcomes.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(F.col("kind") != "Failed").alias("succeeded"), F.count_if(F.col("stage").isNotNull()).alias("failures"))


def counted(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """wanted's keys with the number of their rows and whether there are any."""
    return state.recount(wanted.select(key).distinct(), rows, key, key, "n").withColumn("there", F.col("n") > 0)


def revalidated_reviews(pages: DataFrame, items: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, pages) once the validation has found new issues (page, code): they take the place of its old ones, and every page's items are counted."""
    new = found.select("page", "code", F.lit(VALIDATION).alias("source"), F.lit(None).cast("string").alias("text"))
    out = items.where(~F.col("source").eqNullSafe(F.lit(VALIDATION))).unionByName(new.select(*items.columns))
    return out, state.recount(pages.drop("reviews"), out, "page", "page", "reviews")


def current_status(events: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (page, status) with the status that the newest event (page, status, at, seq) set; a setter appends an event."""
    last = state.latest(events.select("page", "status", "at", "seq"), ["page"], ["at", "seq"]).select(F.col("page").alias("_p"), F.col("status").alias("_s"))
    return pages.join(last, F.col("page") == F.col("_p"), "left").withColumn("status", F.coalesce("_s", "status")).drop("_p", "_s")


def package_reviews(doubtful: DataFrame, stored: DataFrame, words: DataFrame) -> DataFrame:
    """(page, code, text): what goes out to be looked at, once for each code and text of a page.

    doubtful: words (page, text) of low confidence; stored: review items (page, code, text); words: (page, role, text), of which
    reading aids count.
    """
    a = doubtful.select("page", F.lit("LowConfidence").alias("code"), "text")
    b = stored.select("page", "code", F.coalesce("text", F.lit("")).alias("text"))
    c = words.where("role = 'RubyCandidate'").select("page", F.lit("RubyCandidate").alias("code"), "text")
    return a.unionByName(b).unionByName(c).distinct()


def all_issues(**parts: DataFrame) -> DataFrame:
    """Issues (book, code, message) of several sources one after the other, each with its origin."""
    out = None
    for origin, df in parts.items():
        one = df.select("book", "code", "message", F.lit(origin).alias("origin"))
        out = one if out is None else out.unionByName(one)
    return out


def document_hash(paragraphs: DataFrame, spans: DataFrame, book: str) -> DataFrame:
    """(book, hash): upper-case SHA-256 of a document's paragraphs (ordinal, role, plain_text, logical_key) with their spans (ordinal, place, page, marker, start, length).

    Fields are parted by U+001F, spans by U+001E and their parts by colons, paragraphs by line feeds; ids do not count.
    """
    span = F.concat_ws(":", *(F.col(c).cast("string") for c in ("page", "marker", "start", "length")))
    s = spans.groupBy(F.col(book).alias("_b"), F.col("ordinal").alias("_o")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", span.alias("s")))), lambda r: r["s"]), "\u001e").alias("_spans"))
    both = paragraphs.join(s, (F.col(book) == F.col("_b")) & (F.col("ordinal") == F.col("_o")), "left")
    row = F.concat_ws("\u001f", "role", "plain_text", "logical_key", F.coalesce("_spans", F.lit("")))
    return assemble.hashed(both, book, "ordinal", row)
