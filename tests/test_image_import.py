"""Imports of a folder that grows: new files only, each content once, in order, also when a batch fails."""

import os

from pyspark.sql import functions as F

from folioforge.sources import store as st
from folioforge.streaming import images


def test_a_second_import_reads_new_pictures_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "below").mkdir()
    put = lambda name, content, at=1_700_000_000: ((folder / name).write_bytes(content), os.utime(folder / name, (at, at)))
    s = st.Store(spark, f"file://{tmp_path}/project")
    s.commit({"pages": st.Whole(spark.createDataFrame([], "file_name string, source_hash string, position int"))})
    handed, failing = [], set()

    def write(rows, batch):
        handed.append((batch, sorted(r.file_name for r in rows.collect())))
        if batch in failing:
            failing.discard(batch)
            raise OSError("the store is away")
        s.act(lambda view: {"pages": st.Append(images.appended(rows, view.read("pages").count()).select("file_name", "source_hash", "position"))}, action=("import", batch))

    def run():
        q = images.imported(spark, f"file://{folder}", write, f"file://{tmp_path}/checkpoint")
        try:
            q.awaitTermination(300)
        except Exception as e:
            return str(e)
        return None

    def pages():
        return [(r.position, r.file_name) for r in s.read("pages").orderBy("position").collect()]

    put("p10.png", b"ten")
    put("p2.PNG", b"two")
    put("later.jpg", b"later", 1_700_000_100)
    put("IMG_20200101_000000.webp", b"first")
    put("copy.png", b"ten", 1_600_000_000)
    put("notes.txt", b"no picture")
    put("below/x.png", b"below")
    assert run() is None
    first = pages()
    assert [n for _, n in first if n not in ("p10.png", "copy.png")] == ["IMG_20200101_000000.webp", "p2.PNG", "later.jpg"]
    assert len(first) == 4  # one of the two that are the same
    put("p3.png", b"three")
    put("p2-again.png", b"two")
    failing.add(handed[-1][0] + 1)
    assert "the store is away" in run()
    assert run() is None
    assert handed[-1] == handed[-2] and handed[-1][1] == ["p3.png"]
    assert pages() == [*first, (4, "p3.png")]
    assert run() is None
    assert pages() == [*first, (4, "p3.png")]
    assert s.read("pages").groupBy("source_hash").count().where("count > 1").count() == 0
    assert s.read("pages").where(F.length("source_hash") == 64).count() == 5
