"""Packages as a data source: entries of archives and plain files as rows, and rows written as archives or folders.

    spark.dataSource.register(Packages)
    spark.read.format("package").load(folder)                                    a partition for each file of a folder
    files.write.format("package").option("kind", "zip").mode("append").save(folder)

A write is staged by its tasks and moved file by file when all are done, so that no folder has to be moved at once, which
object stores cannot do.  What a failed or a second attempt of a task staged is not named by its message, and goes.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = T.StructType([T.StructField("package", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
#: What a folder for upload may hold, files and bytes of a picture; which files are pictures.
MOST_FILES, MOST_IMAGE = 100, 3 * 1024 * 1024
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif")
#: Files moved at once when a write is committed.
MOVERS = 16
#: Files up to this size are read at once; the archive reader looks for their end before their beginning.
_CHUNK = 1 << 20


def _opened(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Packages(DataSource):
    """Options: path; kind: zip or folder (writes); entries: names of entries that alone are read, parted by commas; strict: a
    broken archive raises, otherwise it is a row with an error; maxfiles and maximagebytes: limits of a package (writes)."""

    @classmethod
    def name(cls) -> str:
        return "package"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: Any) -> None:
        self.uri = options["path"]
        self.entries = [e.strip() for e in options.get("entries", "").split(",") if e.strip()]
        self.strict = options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[_File]:
        """A file each: archives and plain files directly in the folder, hidden ones left out; a file stands for itself."""
        from pyarrow import fs

        store, root = _opened(self.uri)
        here = store.get_file_info(root)
        if here.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = _opened(self.uri)
        name = partition.path.rsplit("/", 1)[-1]
        if not name.lower().endswith(".zip"):
            if not self.entries or name in self.entries:
                with store.open_input_stream(partition.path) as f:
                    yield name, name, f.read(), None
            return
        try:
            with store.open_input_file(partition.path) as f, zipfile.ZipFile(f if f.size() > _CHUNK else io.BytesIO(f.read())) as z:
                for entry in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
                    if not self.entries or entry.filename in self.entries:
                        yield name, entry.filename, z.read(entry), None
        except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, ValueError, OSError) as e:
            if self.strict:
                raise
            yield name, None, None, f"{type(e).__name__}: {e}"


@dataclass
class _Written(WriterCommitMessage):
    """What one attempt staged: (staged, final) of its files, and how many files each package has."""

    moves: list[tuple[str, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


class _Writer(DataSourceWriter):
    def __init__(self, options: Any, schema: T.StructType, overwrite: bool) -> None:
        self.uri, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "folder"), overwrite
        self.files, self.image = int(options.get("maxfiles", 0)), int(options.get("maximagebytes", 0))
        if self.kind not in ("zip", "folder"):
            raise ValueError(f"kind {self.kind}")
        if missing := {"package", "path", "content"} - set(schema.names):
            raise ValueError(f"columns {', '.join(sorted(missing))} are missing")
        self.job = f"_staging-{uuid.uuid4().hex}"

    def _checked(self, row: Any) -> tuple[str, str, bytes]:
        package, path, content = row["package"], row["path"], row["content"]
        if not package or "/" in package or package.startswith((".", "_")):
            raise ValueError(f"{package!r} is no name of a package")
        if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")):
            raise ValueError(f"{path!r} leaves its folder")
        content = content.encode() if isinstance(content, str) else bytes(content or b"")
        if self.image and path.lower().endswith(IMAGES) and len(content) > self.image:
            raise ValueError(f"{path} has {len(content)} bytes, more than {self.image}")
        return package, path, content

    def write(self, iterator: Iterator[Any]) -> _Written:
        store, root = _opened(self.uri)
        staged = f"{root}/{self.job}/{uuid.uuid4().hex}"  # another attempt of this task stages elsewhere
        done, seen, archive, out = _Written(), set(), None, None
        try:
            for row in iterator:
                package, path, content = self._checked(row)
                if (package, path) in seen:
                    raise ValueError(f"{path} comes twice in {package}")
                if self.kind == "folder":
                    seen.add((package, path))
                    done.counts[package] = done.counts.get(package, 0) + 1
                    done.moves.append((f"{staged}/{package}/{path}", f"{root}/{package}/{path}"))
                    store.create_dir(done.moves[-1][0].rsplit("/", 1)[0])
                    with store.open_output_stream(done.moves[-1][0]) as f:
                        f.write(content)
                    continue
                if package not in done.counts:
                    if archive is not None:
                        archive.close()
                        out.close()
                    seen = set()
                    done.moves.append((f"{staged}/{package}.zip", f"{root}/{package}.zip"))
                    done.counts[package] = 0
                    current = package
                    store.create_dir(staged)
                    out = store.open_output_stream(done.moves[-1][0])
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                elif package != current:
                    raise ValueError(f"the files of {package} do not come together")
                seen.add((package, path))
                done.counts[package] += 1
                archive.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
        finally:
            if archive is not None:
                archive.close()
                out.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves what the attempts that count have staged, unless a package is there already, comes from two tasks or is too large."""
        from pyarrow import fs

        store, root = _opened(self.uri)
        all_ = [m for m in messages if m is not None]
        try:
            counts: Counter = Counter()
            for m in all_:
                counts.update(m.counts)
            finals = Counter(final for m in all_ for _, final in m.moves)
            if twice := next((f for f, n in finals.items() if n > 1), None):
                raise ValueError(f"{twice} comes from more than one task")
            if self.files and (large := next((p for p, n in sorted(counts.items()) if n > self.files), None)):
                raise ValueError(f"{large} has {counts[large]} files, more than {self.files}")
            ends = {p: f"{root}/{p}.zip" if self.kind == "zip" else f"{root}/{p}" for p in counts}
            known = [i for i in store.get_file_info(list(ends.values())) if i.type != fs.FileType.NotFound] if ends else []
            if known and not self.overwrite:
                raise FileExistsError(known[0].path)
            for i in known:
                store.delete_dir(i.path) if i.type == fs.FileType.Directory else store.delete_file(i.path)
            for folder in sorted({final.rsplit("/", 1)[0] for final in finals}):
                store.create_dir(folder)
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda m: store.move(*m), [move for m in all_ for move in m.moves]))
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _opened(self.uri)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Packages)
    return spark


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(package, path, content, error) of the entries of a folder's archives, and of its plain files."""
    return registered(spark).read.format("package").options(**options).load(folder)


def write(files: DataFrame, folder: str, kind: str = "folder", overwrite: bool = False, **options: str) -> None:
    """Writes files (package, path, content): a folder or an archive for each package.

    Files of an archive are brought together by package, in the order of their paths; those of a folder are written where
    they are.  A package that is there already is an error, or with overwrite goes first.
    """
    rows = files.select("package", "path", F.col("content").cast("binary").alias("content"))
    if kind == "zip":
        rows = rows.repartition("package").sortWithinPartitions("package", "path")
    registered(files.sparkSession)
    rows.write.format("package").options(kind=kind, **options).mode("overwrite" if overwrite else "append").save(folder)


def returned(spark: SparkSession, folder: str) -> DataFrame:
    """(package, text, error): what each returned file says: an archive's proofread.txt, else its proofread.md, else null; any other file as it is."""
    rows = read(spark, folder)
    archive = F.lower("package").endswith(".zip")
    rank = F.when(~archive, 0).when(F.col("path") == "proofread.txt", 1).when(F.col("path") == "proofread.md", 2)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    first = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), text.alias("text"))))
    return rows.groupBy("package").agg(first["text"].alias("text"), F.max("error").alias("error"))
