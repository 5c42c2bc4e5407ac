"""Transitions of a store's tables that read and write only what a change touches.

Each takes a version of the tables and a change set, cuts the tables down to the rows that the change can reach, lets the
transition work on these, and gives back the rows that differ as the changes of one action.  So what is written follows the
change, not the tables; a store rewrites only the files whose range of keys holds one of these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Append, Change, Put, View
from . import transitions

#: Annotations are kept in the order of their batch, so that those of a batch are in few files.
ANNOTATION_KEY = ["batch", "id"]


def differing(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """The rows of after that are not in before as they are."""
    was = before.select(F.col(key).alias("_k"), F.struct(*before.columns).alias("_was"))
    both = after.join(was, F.col(key) == F.col("_k"), "left")
    return both.where(F.col("_k").isNull() | ~F.struct(*(F.col(c) for c in before.columns)).eqNullSafe(F.col("_was"))).select(*after.columns)


def _only(rows: DataFrame, column: str, among: DataFrame) -> DataFrame:
    a = among.select(F.col(among.columns[0]).alias("_only")).where("_only is not null").distinct()
    return rows.join(a, F.col(column) == F.col("_only"), "left_semi")


def _changes(staled: transitions.Staled, annotations: DataFrame, batches: DataFrame) -> dict[str, Change]:
    """Annotations that became stale, their rows of history, and batches whose text is out of date now."""
    return {
        "annotations": Put(differing(staled.annotations, annotations, "id"), ANNOTATION_KEY), "history": Append(staled.history),
        "batches": Put(differing(staled.batches, batches, "id"), ["id"]),
    }


def pages_saved(view: View, saved: DataFrame, key: str, structure: list[str], image: list[str], counts: Column) -> dict[str, Change]:
    """Saving pages (key, structure, image, ...): the pages, and what becomes stale in the batches that hold or cite them."""
    old = _only(view.read("pages"), key, saved.select(key))
    impacts = transitions.impact_of(old, saved, key, structure, image, counts)
    batch_pages = _only(view.read("batch_pages"), "page", impacts.where("impact = 'structure'").select(key))
    cited = _only(view.read("evidence"), "page", impacts.where("impact = 'image'").select(key))
    every = view.read("annotations")
    annotations = every.join(batch_pages.select(F.col("batch").alias("_b")).distinct(), F.col("batch") == F.col("_b"), "left_semi").unionByName(_only(every, "id", cited.select("annotation"))).distinct()
    batches = _only(view.read("batches"), "id", batch_pages.select("batch"))
    out = transitions.pages_saved(annotations, batches, batch_pages, cited, impacts)
    return {"pages": Put(differing(saved.select(*old.columns), old, key), [key])} | _changes(out, annotations, batches)


def texts_saved(view: View, texts: DataFrame) -> dict[str, Change]:
    """Texts of pages (page, before, after) that differ: what becomes stale in paragraphs with a span on the page, and the page's batches."""
    changed = texts.where(~F.col("before").eqNullSafe(F.col("after")))
    spans = _only(view.read("spans"), "page", changed.select("page"))
    annotations = _only(view.read("annotations"), "paragraph", spans.select("paragraph"))
    batch_pages = _only(view.read("batch_pages"), "page", changed.select("page"))
    batches = _only(view.read("batches"), "id", batch_pages.select("batch"))
    return _changes(transitions.body_changed(annotations, batches, spans, batch_pages, texts), annotations, batches)


def review_saved(view: View, saved: DataFrame, fields: list[str]) -> dict[str, Change]:
    """A review (id, place, fields) of annotations, and those of the same paragraphs that it makes stale.  An unknown id is an error, and nothing is written."""
    every = view.read("annotations")
    if unknown := saved.select(F.col("id").alias("_i")).join(every.select("id"), F.col("_i") == F.col("id"), "left_anti").limit(1).collect():
        raise KeyError(unknown[0][0])
    # Null paragraphs are those of no text; nothing overlaps there, but the rows themselves are reviewed.
    paragraphs = _only(every, "id", saved.select("id")).select("paragraph")
    annotations = _only(every, "paragraph", paragraphs).unionByName(_only(every, "id", saved.select("id")).where("paragraph is null"))
    snapshots = view.read("batches").select(F.col("id").alias("batch"), "snapshot")
    after, history, _ = transitions.reviewed(annotations, saved, snapshots, fields)
    return {"annotations": Put(differing(after, annotations, "id"), ANNOTATION_KEY), "history": Append(history)}
