"""Transitions on a store, by change sets: the same tables as the whole-table transitions give, written in proportion to the change."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import increments, transitions
from folioforge.sources import store as st

BATCHES, EACH = 40, 100


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty batches of a hundred annotations; batch b holds pages b and b + 1000, paragraph n of a batch is on its first page."""
    a = spark.range(BATCHES * EACH).select(
        F.col("id"), F.floor(F.col("id") / EACH).alias("batch"), F.floor(F.col("id") / 4).alias("paragraph"), ((F.col("id") % 4) * 3).cast("int").alias("start"), F.lit(4).alias("length"),
        F.when(F.col("id") % 3 == 0, "Confirmed").when(F.col("id") % 3 == 1, "Proposed").otherwise("Rejected").alias("status"), F.when(F.col("id") % 2 == 0, "ImageConfirmed").otherwise("TextConfirmed").alias("source"), F.lit("r").alias("reading"),
    )
    b = spark.range(BATCHES).select("id", F.lit("s").alias("snapshot"), F.lit(False).alias("text_stale"))
    pages = spark.range(2000).select(F.col("id").alias("page"), F.lit(0).alias("sort"), F.lit("Body").alias("role"), F.lit("full").alias("crop"))
    batch_pages = spark.range(BATCHES).select(F.col("id").alias("batch"), F.explode(F.array("id", F.col("id") + 1000)).alias("page"))
    spans = a.select("paragraph", F.col("batch").alias("page")).distinct()
    evidence = a.select(F.col("id").alias("annotation"), (F.col("batch") + 1000).alias("page"))
    s = st.Store(spark, f"file://{tmp_path_factory.mktemp('store')}/project", file=4000)
    whole = {"pages": pages, "batch_pages": batch_pages, "spans": spans, "evidence": evidence, "batches": b, "history": a.limit(0)}
    s.commit({n: st.Whole(r) for n, r in whole.items()} | {"annotations": st.Whole(a)})
    s.commit({"annotations": st.Put(a, increments.ANNOTATION_KEY)})
    return s


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def written(s, before):
    """Rows of files that versions after `before` added."""
    old = {f["path"] for t in s.manifest(before)["tables"].values() for f in t["files"]}
    return {n: sum(f["rows"] for f in t["files"] if f["path"] not in old) for n, t in s.manifest()["tables"].items()}


def test_saved_pages(spark, tables):
    base, now = tables.version(), lambda n: tables.read(n, base)
    saved = spark.createDataFrame([(3, 0, "Body", "full"), (4, 9, "Body", "full"), (1007, 0, "Body", "half"), (5000, 0, "Body", "full")], "page long, sort int, role string, crop string")
    pick = (["sort", "role"], ["crop"], F.col("role") == "Body")
    impacts = transitions.impact_of(now("pages"), saved, "page", *pick)
    want = transitions.pages_saved(now("annotations"), now("batches"), now("batch_pages"), now("evidence"), impacts)
    want_rows = rows(want.annotations), rows(want.history), rows(want.batches)
    tables.act(lambda view: increments.pages_saved(view, saved, "page", *pick))
    assert (rows(tables.read("annotations")), rows(tables.read("history")), rows(tables.read("batches"))) == want_rows
    assert tables.read("pages").count() == 2001
    assert 0 < len(want_rows[1]) < 2 * EACH
    new = written(tables, base)
    assert new["annotations"] < BATCHES * EACH / 3
    assert new["spans"] == new["evidence"] == new["batch_pages"] == 0


def test_saved_texts(spark, tables):
    base, now = tables.version(), lambda n: tables.read(n, base)
    texts = spark.createDataFrame([(11, "a", "b"), (12, "same", "same"), (13, None, "new"), (77, "x", "y")], "page long, before string, after string")
    want = transitions.body_changed(now("annotations"), now("batches"), now("spans"), now("batch_pages"), texts)
    want_rows, more = (rows(want.annotations), rows(want.batches)), want.history.count()
    old = tables.read("history").count()
    tables.act(lambda view: increments.texts_saved(view, texts))
    assert (rows(tables.read("annotations")), rows(tables.read("batches"))) == want_rows
    assert tables.read("history").count() == old + more and more > 0
    assert written(tables, base)["annotations"] < BATCHES * EACH / 3


def test_a_log_of_a_thousand_reviews(spark, tables):
    """A thousand reviews in change sets of five batches each: the same as all of them on whole tables, a share of the table written each time."""
    first = tables.version()
    whole, most = tables.read("annotations", first), 0
    for k in range(2):
        saved = spark.range(5 * k * EACH, (5 * k + 5) * EACH).select("id", F.col("id").alias("place"), F.lit("Confirmed").alias("status"), F.format_string("reading %d", "id").alias("reading"))
        base = tables.version()
        tables.act(lambda view, saved=saved: increments.review_saved(view, saved, ["status", "reading"]))
        most = max(most, written(tables, base)["annotations"])
    every = spark.range(10 * EACH).select("id", F.col("id").alias("place"), F.lit("Confirmed").alias("status"), F.format_string("reading %d", "id").alias("reading"))
    snapshots = tables.read("batches").select(F.col("id").alias("batch"), "snapshot")
    want, _, _ = transitions.reviewed(whole, every, snapshots, ["status", "reading"])
    assert rows(tables.read("annotations")) == rows(want)
    assert most <= 12 * EACH
    with pytest.raises(KeyError):
        tables.act(lambda view: increments.review_saved(view, spark.createDataFrame([(10**9, 0, "Confirmed", "x")], "id long, place long, status string, reading string"), ["status", "reading"]))
    assert tables.version() == first + 2


def test_a_change_that_touches_nothing(spark, tables):
    base = tables.version()
    tables.act(lambda view: increments.texts_saved(view, spark.createDataFrame([(1, "a", "a")], "page long, before string, after string")))
    assert written(tables, base)["annotations"] == 0
