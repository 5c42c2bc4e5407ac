"""What stands between a returned file and the tables: issues of an import, pages that may be taken, what taking them changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rules

#: The issues that keep a page, or a whole file, from being taken; others are warnings.
ERRORS = ("ProjectMismatch", "UnknownBatch", "DuplicatePageMarker", "MissingPageMarker", "UnknownPageMarker", "InvalidStructureMarker", "PageDeleted", "PageExcluded", "SourceImageChanged")
#: How a text that could not be read begins, and the words of the detail lines.
UNREADABLE = "［判読不能"
ERROR_WORD, WARNING_WORD = "エラー", "警告"
#: The kind, source and page status of a text that was taken.
TAKEN_KIND, TAKEN_FROM = "Confirmed", "ChatGPTImport"
#: What an exported page keeps of the page as it was, beside the text: column and issue.
KEPT = {"sort_order": "PageSortOrderChanged", "rotation": "RotationChanged", "role": "PageRoleChanged", "profile": "DisplayProfileChanged", "crop": "CropChanged", "run": "OcrRunChanged"}


def is_error(code: Column) -> Column:
    return code.isin(*ERRORS)


def unreadable(text: Column) -> Column:
    return F.contains(text, F.lit(UNREADABLE))


def file_issues(files: DataFrame, pages: DataFrame, exported: DataFrame) -> DataFrame:
    """(batch, marker, code) of whole files (batch, project, own_project); marker is null.

    The batch must be known, the project the own one, and those of its pages that are known must come in the exported order.
    """
    known = exported.groupBy(F.col("batch").alias("_b")).agg(F.array_sort(F.collect_set("marker")).alias("_known"))
    came = pages.join(exported.select("batch", "marker").distinct(), ["batch", "marker"], "left_semi")
    came = came.groupBy(F.col("batch").alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "marker"))), lambda r: r["marker"]).alias("_came"))
    both = files.join(known, F.col("batch") == F.col("_b"), "left").join(came, F.col("batch") == F.col("_c"), "left")
    none = F.array().cast("array<string>")
    found = {"ProjectMismatch": ~F.col("project").eqNullSafe(F.col("own_project")), "UnknownBatch": F.col("_b").isNull(), "PageOrderChanged": F.coalesce("_came", none) != F.coalesce("_known", none)}
    return rules.issues(both, ["batch"], found).select("batch", F.lit(None).cast("string").alias("marker"), "code")


def marker_issues(files: DataFrame, pages: DataFrame, exported: DataFrame) -> DataFrame:
    """(batch, marker, code): markers that come more than once, and exported ones that do not come; pages are only of known files."""
    n = pages.groupBy("batch", "marker").agg(F.count("*").alias("n"))
    twice = n.where("n > 1").select("batch", "marker", F.lit("DuplicatePageMarker").alias("code"))
    wanted = exported.join(files.select("batch"), "batch", "left_semi").select("batch", "marker").distinct()
    return twice.unionByName(wanted.join(n, ["batch", "marker"], "left_anti").withColumn("code", F.lit("MissingPageMarker")))


def page_issues(pages: DataFrame, exported: DataFrame, current: DataFrame) -> DataFrame:
    """(batch, seq, marker, code) of each page that came (batch, seq, marker, text), held against the page exported and the page as it is now.

    exported: batch, marker, page, source_hash, text_hash, text_source and KEPT; current: page, included, source_hash, text,
    text_source and KEPT.  Of a page that is gone nothing else is compared.  One join each on the marker and on the page.
    """
    e = exported.select(F.col("batch").alias("_b"), F.col("marker").alias("_m"), F.struct(*exported.columns).alias("e"))
    c = current.select(F.col("page").alias("_p"), F.struct(*current.columns).alias("c"))
    both = pages.join(e, (F.col("batch") == F.col("_b")) & (F.col("marker") == F.col("_m")), "left").join(c, F.col("e.page") == F.col("_p"), "left")
    there, baseline = F.col("_p").isNotNull(), F.coalesce("c.text", F.lit(""))
    differs = lambda k: there & ~F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}"))
    found = {
        "UnknownPageMarker": F.col("_m").isNull(), "EmptyConfirmedText": tx.is_blank(F.col("text")), "UnreadableText": unreadable(F.col("text")), "InvalidStructureMarker": tx.bad_markers(F.col("text")),
        "PageDeleted": F.col("_m").isNotNull() & ~there, "PageExcluded": there & ~F.col("c.included"), "SourceImageChanged": differs("source_hash"),
        "BaselineTextChanged": there & ((tx.text_hash(baseline) != F.col("e.text_hash")) | ~F.col("c.text_source").eqNullSafe(F.col("e.text_source"))),
        **{code: differs(k) for k, code in KEPT.items()},
        "ExtremeTextLengthChange": there & tx.extreme_change(tx.units(baseline), tx.units(F.col("text"))),
    }
    return rules.issues(both, ["batch", "seq", "marker"], found)


def candidates(pages: DataFrame, exported: DataFrame, current: DataFrame) -> DataFrame:
    """(batch, marker, page, text, baseline, join) of the pages that came once and are known; the baseline of a page that is gone is empty."""
    once = pages.groupBy("batch", "marker").agg(F.count("*").alias("_n"), F.first("text").alias("text"), F.first("join").alias("join")).where("_n = 1").drop("_n")
    known = once.join(exported.select("batch", "marker", "page"), ["batch", "marker"])
    now = current.select(F.col("page").alias("_p"), F.col("text").alias("_t"))
    return known.join(now, F.col("page") == F.col("_p"), "left").select("batch", "marker", "page", "text", F.coalesce("_t", F.lit("")).alias("baseline"), "join")


def judged(found: DataFrame, issues: DataFrame) -> DataFrame:
    """candidates with acceptable (no error of their own), taken at first if so, and flagged if they have any issue."""
    own = issues.where("marker is not null").groupBy(F.col("batch").alias("_b"), F.col("marker").alias("_m")).agg(F.count("*").alias("_n"), F.count_if(is_error(F.col("code"))).alias("_bad"))
    both = found.join(own, (F.col("batch") == F.col("_b")) & (F.col("marker") == F.col("_m")), "left")
    return both.withColumns({"acceptable": F.coalesce("_bad", F.lit(0)) == 0, "flagged": F.coalesce("_n", F.lit(0)) > 0}).drop("_b", "_m", "_n", "_bad")


def flagged_only(rows: DataFrame) -> DataFrame:
    """The view of candidates that have issues."""
    return rows.where("flagged")


class Taken(NamedTuple):
    """Versions to append (page, kind, text, source), pages with their new boundary and status, pages whose boundary changed, texts before and after, batches refused and why."""

    versions: DataFrame
    pages: DataFrame
    joins_changed: DataFrame
    texts: DataFrame
    refused: DataFrame


def taken(rows: DataFrame, issues: DataFrame, accepted: DataFrame, joins: DataFrame) -> Taken:
    """The accepted markers (batch, marker) of judged candidates go into the tables, all of a batch or none of it.

    A batch with an error of the whole file is refused; so is one with an accepted page that has an error.  joins: (page, join)
    as they are now.
    """
    whole = issues.where(F.col("marker").isNull() & is_error(F.col("code"))).select("batch", F.lit("FileError").alias("why")).distinct()
    wanted = accepted.select("batch", "marker").distinct()
    page = issues.where(F.col("marker").isNotNull() & is_error(F.col("code"))).join(wanted, ["batch", "marker"], "left_semi").select("batch", F.lit("PageError").alias("why")).distinct()
    refused = whole.unionByName(page.join(whole.select("batch"), "batch", "left_anti"))
    good = rows.join(wanted, ["batch", "marker"], "left_semi").join(refused.select("batch"), "batch", "left_anti")
    now = joins.select(F.col("page").alias("_p"), F.col("join").alias("_j"))
    changed = good.join(now, F.col("page") == F.col("_p"), "left").where(~F.col("_j").eqNullSafe(F.col("join"))).select("page").distinct()
    versions = good.select("page", F.lit(TAKEN_KIND).alias("kind"), "text", F.lit(TAKEN_FROM).alias("source"))
    return Taken(versions, good.select("page", "join", F.lit(TAKEN_KIND).alias("status")), changed, good.select("page", F.col("baseline").alias("before"), F.col("text").alias("after")), refused)


def issue_lines(issues: DataFrame) -> DataFrame:
    """issues with line: whether it is an error or a warning, its code and its marker."""
    return issues.withColumn("line", F.concat(F.when(is_error(F.col("code")), ERROR_WORD).otherwise(WARNING_WORD), F.lit(": "), "code", F.lit(" "), F.coalesce("marker", F.lit(""))))


def page_line(marker: Column, before: Column, after: Column, changed: Column, paragraphs: Column) -> Column:
    """The line that sums up one page's change."""
    return F.format_string("PAGE %s: %d → %d文字、変更 %d字 / %d段落", marker, tx.units(before), tx.units(after), changed, paragraphs)


def save_gate(rows: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, warnings) that stand against saving reviewed rows (id, status); before and after: (id, code, message, error).

    Any error blocks.  Of confirmed rows that have a warning with a code and message they did not have before, all warnings
    want to be acknowledged; each message once.
    """
    errors = after.where("error").select("message")
    new = after.where("not error").select("id", "code", "message").join(before.where("not error").select("id", "code", "message"), ["id", "code", "message"], "left_anti")
    ids = new.select("id").distinct().join(rows.where("status = 'Confirmed'").select("id"), "id", "left_semi")
    return errors, after.where("not error").join(ids, "id", "left_semi").select("message").distinct()
