"""Actions over several tables: whole or not at all, one of two writers wins, only what changes is written."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import writers
from folioforge.sources import store as st


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, v string")


def seen(store):
    return {t: sorted((r.k, r.v) for r in store.read(t).collect()) for t in store.tables()}


def changes(spark):
    return {"a": st.Append(rows(spark, (3, "new"))), "b": st.Put(rows(spark, (1, "other"), (9, "nine")), ["k"]), "c": st.Whole(rows(spark, (7, "c")))}


AFTER = {"a": [(1, "x"), (2, "y"), (3, "new")], "b": [(1, "other"), (2, "y"), (9, "nine")], "c": [(7, "c")]}


@pytest.fixture
def store(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/project")
    assert s.version() == 0 and s.tables() == []
    old = rows(spark, (1, "x"), (2, "y"))
    assert s.commit({"a": st.Whole(old), "b": st.Put(old, ["k"]), "c": st.Whole(old)}) == 1
    return s


def test_an_action_is_one_version(spark, store):
    before = store.read("a")
    assert store.commit(changes(spark)) == 2
    assert seen(store) == AFTER
    assert before.count() == 2
    assert sorted(r.v for r in store.read("b", 1).collect()) == ["x", "y"]


@pytest.mark.parametrize("writes", [0, 1, 2, 3])
def test_killed_between_two_writes(spark, store, monkeypatch, writes):
    """After any number of writes, the manifest being the fourth, readers see the old state of all tables, and a new run goes on."""
    old, n = seen(store), 0

    def dying(real):
        def call(*args):
            nonlocal n
            if n == writes:
                raise KeyboardInterrupt
            n += 1
            return real(*args)

        return call

    with monkeypatch.context() as m:
        m.setattr(store, "_stage", dying(store._stage))
        m.setattr(store, "_named", dying(store._named))
        with pytest.raises(KeyboardInterrupt):
            store.commit(changes(spark))
    again = st.Store(spark, store.root)
    assert again.version() == 1 and seen(again) == old
    assert again.commit(changes(spark)) == 2 and seen(again) == AFTER
    assert again.sweep(keep=2, younger=0) == writes
    assert seen(again) == AFTER and again.read("a", 1).count() == 2


def test_one_of_two_writers_wins(spark, store):
    one, two = st.View(store, store.version()), st.View(store, store.version())
    add = lambda view, v: {"a": st.Append(view.read("a").agg((F.max("k") + 1).alias("k")).withColumn("v", F.lit(v)))}
    assert store.commit(add(one, "first"), one.version, one.seen) == 2
    with pytest.raises(st.Conflict):
        store.commit(add(two, "second"), two.version, two.seen)
    assert [r[1] for r in seen(store)["a"]] == ["x", "y", "first"]
    # Another table's action does not stand in the way; a table that was only read does.
    assert store.commit({"c": st.Append(rows(spark, (8, "beside")))}, 1) == 3
    with pytest.raises(st.Conflict):
        store.commit({"d": st.Whole(rows(spark, (1, "from c")))}, 2, {"c"})


def test_an_action_is_worked_out_again(spark, store):
    calls = []

    def more(view):
        top = view.read("a").agg(F.max("k")).first()[0]
        if not calls:
            store.commit({"a": st.Append(rows(spark, (top + 1, "between")))})
        calls.append(top)
        return {"a": st.Append(rows(spark, (top + 1, "mine")))}

    assert store.act(more) == 3
    assert calls == [2, 3]
    assert seen(store)["a"][2:] == [(3, "between"), (4, "mine")]


def test_a_batch_that_comes_again_is_written_once(spark, store):
    batch = {"a": st.Append(rows(spark, (5, "batch")))}
    assert store.commit(batch, action=("run", 0)) == 2
    assert store.commit(batch, action=("run", 0)) == 2
    assert store.commit(batch, action=("other", 0)) == 3
    assert store.commit(batch, base=1, action=("run", 0)) == 2
    assert [r[0] for r in seen(store)["a"]] == [1, 2, 5, 5]


def test_keys_without_rows_null_keys_and_nothing(spark, store):
    gone = spark.createDataFrame([(1,), (77,)], "k long")
    store.commit({"b": st.Put(rows(spark).limit(0), ["k"], gone)})
    assert seen(store)["b"] == [(2, "y")]
    store.commit({"b": st.Append(rows(spark, (None, "none")))})
    store.commit({"b": st.Put(rows(spark, (None, "null")), ["k"])})
    assert {(r.k, r.v) for r in store.read("b").collect()} == {(2, "y"), (None, "null")}
    store.commit({"b": st.Whole(rows(spark).limit(0))})
    assert store.read("b").count() == 0
    store.commit({"b": st.Put(rows(spark, (4, "back")), ["k"])})
    assert seen(store)["b"] == [(4, "back")]
    with pytest.raises(KeyError):
        store.read("none")


def test_rows_written_grow_with_the_change(spark, tmp_path):
    """A thousand changes in change sets of one place each: what is written follows the change sets, not the table."""
    s, n = st.Store(spark, f"file://{tmp_path}/project", file=20_000), 100_000
    every = spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    s.commit({"t": st.Whole(every)})
    s.commit({"t": st.Put(every, ["k"])})
    table = lambda v: {f["path"]: f["rows"] for f in s.manifest(v)["tables"]["t"]["files"]}
    parts = len(table(2))
    assert parts > 10
    written = []
    for change in range(5):
        low = change * 17_000 + 300
        new = spark.range(low, low + 200).select(F.col("id").alias("k"), F.lit(f"new {change}").alias("v"))
        v = s.commit({"t": st.Put(new, ["k"])})
        written.append(sum(r for p, r in table(v).items() if p not in table(v - 1)))
    assert max(written) <= 2 * n // parts + 200
    assert sum(table(s.version()).values()) == n
    assert s.read("t").where("v like 'new%'").count() == 1000
    assert s.read("t").groupBy("k").count().where("count > 1").count() == 0


def test_a_snapshot_of_a_document_is_an_action(spark, tmp_path):
    """What writers gives is committed as it is: a snapshot, its paragraphs and spans appear together, and only once."""
    s = st.Store(spark, f"file://{tmp_path}/project")
    doc = spark.createDataFrame([("p", "h", "v1")], "project string, hash string, source string")
    para = spark.createDataFrame([("p", "h", 0, "text")], "project string, hash string, ordinal int, text string")
    span = spark.createDataFrame([("p", "h", 0, 0, 4)], "project string, hash string, paragraph int, start int, length int")

    def save(view):
        known = view.read("snapshots") if "snapshots" in s.tables(view.version) else spark.createDataFrame([], "id string, project string, hash string, source string, created string")
        return writers.changes(writers.snapshot(doc, para, span, known, F.lit("now")))

    assert s.act(save) == 1
    assert [s.read(t).count() for t in ("snapshots", "paragraphs", "spans")] == [1, 1, 1]
    assert s.act(save) == 2
    assert [s.read(t).count() for t in ("snapshots", "paragraphs", "spans")] == [1, 1, 1]


def test_a_recognition_takes_the_place_of_what_its_pages_had(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/project")
    frame = lambda schema, *values: spark.createDataFrame(list(values), schema)
    words, reviews = "page string, text string", "page string, code string, source string, text string"
    s.commit({
        "pages": st.Whole(frame("page string, status string, title string", ("a", "Processing", "one"), ("b", "Completed", "two"))),
        "words": st.Whole(frame(words, ("a", "old"), ("b", "stays"))),
        "reviews": st.Whole(frame(reviews, ("a", "x", "OCR", "old"), ("a", "x", "PageValidation", "stays"), ("b", "x", "Ruby", "stays"))),
    })
    made = {"pages": frame("page string, status string", ("a", "ReviewRequired"), ("gone", "Completed")), "words": frame(words), "reviews": frame(reviews, ("a", "y", "Merge", "new")), "refused": frame("page string")}
    s.act(lambda view: writers.changes(made, view))
    got = {t: sorted(map(tuple, s.read(t).collect())) for t in s.tables()}
    assert got == {
        "pages": [("a", "ReviewRequired", "one"), ("b", "Completed", "two")], "words": [("b", "stays")],
        "reviews": [("a", "x", "PageValidation", "stays"), ("a", "y", "Merge", "new"), ("b", "x", "Ruby", "stays")],
    }
