"""Packages as a data source: what is read, what a failed or repeated write leaves."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.operators import packages
from folioforge.sources import archives


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def archive(path, **entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_", "."), text)


def files(spark, n=3, size=4):
    return spark.range(n * size).select(F.format_string("b%d", F.col("id") % n).alias("package"), F.format_string("dir/f%02d.txt", F.col("id")).alias("path"), F.format_string("text %d 字", F.col("id")).alias("content"))


def test_entries_of_archives_and_plain_files(spark, tmp_path):
    archive(tmp_path / "a.zip", proofread_md="md", proofread_txt="﻿txt 字", images__x_png="p")
    archive(tmp_path / "B.ZIP", proofread_md="only md")
    archive(tmp_path / "none.zip")
    (tmp_path / "plain.txt").write_text("plain")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "below").mkdir()
    uri = f"file://{tmp_path}"
    got = archives.read(spark, uri)
    assert got.rdd.getNumPartitions() == 5
    rows = {(r.package, r.path): r for r in got.collect()}
    assert sorted(rows, key=str) == sorted([("B.ZIP", "proofread.md"), ("a.zip", "images/x.png"), ("a.zip", "proofread.md"), ("a.zip", "proofread.txt"), ("broken.zip", None), ("plain.txt", "plain.txt")], key=str)
    assert rows["broken.zip", None].error
    assert {(r.package, r.path) for r in archives.read(spark, uri, entries="proofread.md").where("error is null").collect()} == {("B.ZIP", "proofread.md"), ("a.zip", "proofread.md")}
    assert [r.content for r in archives.read(spark, f"{uri}/plain.txt").collect()] == [b"plain"]
    with pytest.raises(Exception, match="BadZipFile|Invalid position"):
        archives.read(spark, uri, strict="true").count()
    with pytest.raises(Exception, match="FileNotFound"):
        archives.read(spark, f"{uri}/nowhere").count()
    said = {r.package: r.text for r in archives.returned(spark, uri).collect()}
    assert said == {"a.zip": "txt 字", "B.ZIP": "only md", "broken.zip": None, "plain.txt": "plain"}


@pytest.mark.parametrize("kind", ["zip", "folder"])
def test_round_trip(spark, tmp_path, kind):
    uri = f"file://{tmp_path}/out"
    archives.write(files(spark).repartition(5), uri, kind)
    want = sorted((r.package, r.path, r.content.encode()) for r in files(spark).collect())
    if kind == "zip":
        assert tree(tmp_path / "out") == ["b0.zip", "b1.zip", "b2.zip"]
        assert sorted((r.package[:-4], r.path, bytes(r.content)) for r in archives.read(spark, uri).collect()) == want
        first = (tmp_path / "out/b0.zip").read_bytes()
        archives.write(files(spark).repartition(2), f"file://{tmp_path}/again", kind)
        assert (tmp_path / "again/b0.zip").read_bytes() == first
    else:
        assert tree(tmp_path / "out") == sorted(f"{p}/{q}" for p, q, _ in want)
        assert all((tmp_path / "out" / p / q).read_bytes() == c for p, q, c in want)


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    uri = f"file://{tmp_path}/out"
    archives.write(files(spark, 1), uri)
    before = tree(tmp_path / "out")
    bad = files(spark, 2).withColumn("path", F.when(F.col("path") == "dir/f07.txt", "../x").otherwise(F.col("path"))).where("package <> 'b0'").repartition(4)
    with pytest.raises(Exception, match="leaves its folder"):
        archives.write(bad, uri)
    assert tree(tmp_path / "out") == before
    assert sorted(os.listdir(tmp_path / "out")) == ["b0"]
    with pytest.raises(Exception, match="FileExists"):
        archives.write(files(spark, 2), uri)
    assert tree(tmp_path / "out") == before
    archives.write(files(spark, 2, 2), uri, overwrite=True)
    assert tree(tmp_path / "out") == ["b0/dir/f00.txt", "b0/dir/f02.txt", "b1/dir/f01.txt", "b1/dir/f03.txt"]


def test_a_second_attempt_gives_nothing_twice(spark, tmp_path):
    """Two attempts of a task stage the same files; only the one whose message counts is moved."""
    schema = archives.SCHEMA
    for kind in ("zip", "folder"):
        w = archives._Writer({"path": f"file://{tmp_path}/{kind}", "kind": kind}, schema, False)
        rows = [{"package": "p", "path": f"f{i}", "content": b"x"} for i in range(3)]

        def broken(rows=rows):
            yield rows[0]
            raise OSError("the executor is lost")

        with pytest.raises(OSError, match="lost"):
            w.write(broken())
        w.write(iter(rows))
        w.commit([w.write(iter(rows)), None])
        assert tree(tmp_path / kind) == (["p.zip"] if kind == "zip" else ["p/f0", "p/f1", "p/f2"])
        with pytest.raises(ValueError, match="more than one task"):
            again = archives._Writer({"path": f"file://{tmp_path}/{kind}", "kind": kind}, schema, True)
            again.commit([again.write(iter(rows)), again.write(iter(rows))])
        assert len(tree(tmp_path / kind)) == (1 if kind == "zip" else 3)


def test_limits_of_a_folder_for_upload(spark, tmp_path):
    uri = f"file://{tmp_path}/out"
    limits = {"maxfiles": str(archives.MOST_FILES), "maximagebytes": str(archives.MOST_IMAGE)}
    many = lambda n: spark.range(n).select(F.lit("book").alias("package"), F.format_string("c%03d.md", "id").alias("path"), F.lit("x").alias("content")).repartition(7)
    with pytest.raises(Exception, match="book has 101 files, more than 100"):
        archives.write(many(101), uri, **limits)
    assert tree(tmp_path / "out") == []
    archives.write(many(100), uri, **limits)
    assert len(tree(tmp_path / "out")) == 100
    picture = lambda n, name: spark.range(1).select(F.lit("p").alias("package"), F.lit(name).alias("path"), F.repeat(F.lit("x"), n).alias("content"))
    with pytest.raises(Exception, match="3145729 bytes"):
        archives.write(picture(archives.MOST_IMAGE + 1, "a.PNG"), uri, **limits)
    archives.write(picture(archives.MOST_IMAGE, "a.png").union(picture(archives.MOST_IMAGE + 1, "a.txt")), uri, **limits)


@pytest.mark.parametrize(("package", "path"), [("", "x"), ("a/b", "x"), (".a", "x"), ("a", ""), ("a", "/x"), ("a", "b/../x"), ("a", "b//x"), (None, "x"), ("a", None)])
def test_names_that_leave_their_place(package, path):
    with pytest.raises(ValueError):
        archives._Writer({"path": "file:///nowhere"}, archives.SCHEMA, False)._checked({"package": package, "path": path, "content": b""})


def test_a_proofreading_package_is_written_and_read_again(spark, tmp_path):
    made = files(spark, 2).withColumnRenamed("package", "batch")
    packages.write_packages(made, f"file://{tmp_path}/out")
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out/b1.zip").read_bytes())) as z:
        assert z.namelist() == ["dir/f01.txt", "dir/f03.txt", "dir/f05.txt", "dir/f07.txt"]
