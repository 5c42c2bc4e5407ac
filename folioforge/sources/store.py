"""Tables of a project that change together: each action is one version, named by one manifest that is written last.

    root/data/<table>/<id>/      rows of a table as Parquet, written once and never changed
    root/log/<version>.json      for every table, which of these count, with the range of its keys in each file

A manifest appears whole under a number that nobody had before, or not at all.  So a run that is killed between two writes
leaves what readers see as it was; of two writers of one version one wins.  What a reader has read stays as it is, since
files are only removed by sweep().  All goes through the file system that Spark itself uses.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that the keys of a change are described by, when the files that may hold them are looked for.
RANGES = 64
#: Bytes of a file that a change writes, about, by the sizes of those it takes the place of.
FILE = 128 << 20


class Conflict(RuntimeError):
    """Another action has written a table that this one read or writes."""


@dataclass
class Append:
    """Rows beside those that are there."""

    rows: DataFrame


@dataclass
class Whole:
    """Rows in place of a table."""

    rows: DataFrame


@dataclass
class Put:
    """Rows in place of those that have the same key; with `of`, of those that have one of its keys, whether or not there is a row for it."""

    rows: DataFrame
    key: list[str]
    of: DataFrame | None = None


Change = Append | Whole | Put


class View:
    """The tables of one version."""

    def __init__(self, store: Store, version: int) -> None:
        self.store, self.version, self.seen = store, version, set()

    def read(self, name: str) -> DataFrame:
        """A table's rows; that it was read counts when an action is tried again."""
        self.seen.add(name)
        return self.store.read(name, self.version)


class Store:
    def __init__(self, spark: SparkSession, root: str, file: int = FILE) -> None:
        self.spark, self.root, self.file = spark, root.rstrip("/"), file
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, uri: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(uri)

    # Manifests

    def version(self) -> int:
        """The newest version; 0 before the first action."""
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: {"schema", "files": [{"path", "rows", "bytes", "key", "low", "high"}]}}, "actions": {stream: number}, "changed": [names]}"""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "actions": {}, "changed": []}
        with contextlib.closing(self._fs.open(self._path(self._name(version)))) as f:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode())

    def _name(self, version: int) -> str:
        return f"{self.root}/log/{version:020}.json"

    def _named(self, version: int, manifest: dict) -> bool:
        """Writes a manifest under a number; False if there is one already."""
        other = self._path(f"{self.root}/log/.{uuid.uuid4().hex}.tmp")
        with contextlib.closing(self._fs.create(other, False)) as f:
            f.write(bytearray(json.dumps(manifest).encode()))
        java = self._jvm.org.apache.hadoop.fs
        never = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            java.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(other, self._path(self._name(version)), never)
        except Exception as e:
            self._fs.delete(other, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    # Rows

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table in a version, the newest if none is given."""
        found = self.manifest(version)["tables"].get(name)
        if found is None:
            raise KeyError(name)
        return self._rows(found)

    def _rows(self, table: dict, files: list[dict] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{f['path']}" for f in (table["files"] if files is None else files)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _stage(self, name: str, rows: DataFrame, key: str | None) -> list[dict]:
        """Writes rows where no manifest names them yet; what a manifest would say of their files."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))}
        back = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")
        bounds = [F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high")] if key else []
        each = back.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), *bounds)
        return [{"path": f"{folder}/{r['name']}", "rows": r["rows"], "bytes": sizes[r["name"]], "key": key, "low": r["low"] if key else None, "high": r["high"] if key else None} for r in each.collect()]

    def _held(self, files: list[dict], key: str, kind: T.DataType, keys: DataFrame) -> list[dict]:
        """The files that may hold one of keys: by the ranges of their keys, as far as these are known."""
        parts = keys.select(F.col(key).alias("k")).repartitionByRange(RANGES, "k").groupBy(F.spark_partition_id()).agg(F.min("k").cast("string").alias("low"), F.max("k").cast("string").alias("high"), F.count_if(F.col("k").isNull()).alias("nulls"))
        spans = parts.collect()
        bounds = self.spark.createDataFrame([(i, f["low"], f["high"]) for i, f in enumerate(files) if f["key"] == key and f["low"] is not None], "i int, low string, high string")
        wide = self.spark.createDataFrame([(r["low"], r["high"]) for r in spans if r["low"] is not None], "a string, b string")
        cast = lambda c: F.col(c).cast(kind)  # noqa: E731  compared as what they are, not as strings
        met = bounds.join(F.broadcast(wide), (cast("low") <= cast("b")) & (cast("high") >= cast("a"))).select("i").distinct().collect() if spans else []
        hit = {r["i"] for r in met}
        # A file's bounds leave out its null keys; files of another key, or of nulls alone, have none.
        nulls = any(r["nulls"] for r in spans)
        return [f for i, f in enumerate(files) if i in hit or nulls or f["key"] != key or f["low"] is None]

    def _changed(self, name: str, old: dict | None, change: Change) -> dict:
        """A table's entry after a change; old files that the change does not touch stay as they are."""
        rows = change.rows
        if old is not None and not isinstance(change, Whole):
            names = [f["name"] for f in old["schema"]["fields"]]
            rows = rows.select(*names)
        schema = json.loads(rows.schema.json()) if old is None or isinstance(change, Whole) else old["schema"]
        if isinstance(change, Whole) or old is None:
            key = change.key[0] if isinstance(change, Put) else None
            ordered = rows.repartitionByRange(*change.key).sortWithinPartitions(*change.key) if key else rows
            return {"schema": schema, "files": self._stage(name, ordered, key)}
        if isinstance(change, Append):
            known = next((f["key"] for f in old["files"] if f["key"]), None)
            return {"schema": schema, "files": old["files"] + self._stage(name, rows, known)}
        keys = (change.rows if change.of is None else change.of).select(*change.key).distinct()
        key = change.key[0]
        held = self._held(old["files"], key, rows.schema[key].dataType, keys)
        other = keys.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(change.key)))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(change.key)]
        both = self._rows(old, held).join(other, same, "left_anti").unionByName(rows)
        parts = max(1, -(-sum(f["bytes"] for f in held) // self.file))
        made = self._stage(name, both.repartitionByRange(parts, *change.key).sortWithinPartitions(*change.key), key)
        gone = {f["path"] for f in held}
        return {"schema": schema, "files": [f for f in old["files"] if f["path"] not in gone] + made}

    # Actions

    def commit(self, changes: dict[str, Change], base: int | None = None, seen: set[str] = frozenset(), action: tuple[str, int] | None = None) -> int:
        """Makes changes to several tables one version, and returns its number.

        They hold for version `base`, the newest if none is given.  If others have been written since, and none of them
        changed a table that this action read (seen) or changes, its files are named after them; else it is a Conflict.
        action: (stream, number): an action of a stream whose number, or a later one, is there already changes nothing, so
        that a micro-batch that comes again is written once.
        """
        base = self.version() if base is None else base
        now = self.manifest(base)
        if action and now["actions"].get(action[0], -1) >= action[1]:
            return base
        entries = {name: self._changed(name, now["tables"].get(name), change) for name, change in changes.items()}
        version = base
        while True:
            more = {"actions": now["actions"] | ({action[0]: action[1]} if action else {}), "tables": now["tables"] | entries, "changed": sorted(changes)}
            if self._named(version + 1, more):
                return version + 1
            version += 1
            now = self.manifest(version)
            if action and now["actions"].get(action[0], -1) >= action[1]:
                return version
            if both := (set(changes) | set(seen)) & set(now["changed"]):
                raise Conflict(f"version {version} changed {', '.join(sorted(both))}")

    def act(self, what: Callable[[View], dict[str, Change]], attempts: int = 3, action: tuple[str, int] | None = None) -> int:
        """Commits what(view), worked out anew on the newest version where another action came in between."""
        for left in reversed(range(attempts)):
            view = View(self, self.version())
            try:
                return self.commit(what(view), view.version, view.seen, action)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def sweep(self, keep: int = 10, younger: int = 86400) -> int:
        """Removes the manifests before the last `keep`, and files that none of these names and that are older than `younger` seconds; how many folders went.

        What is younger may belong to an action that is not named yet.
        """
        last = self.version()
        named = {f["path"].rsplit("/", 1)[0] for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for f in t["files"]}
        log, data, gone = self._path(f"{self.root}/log"), self._path(f"{self.root}/data"), 0
        before = self._jvm.System.currentTimeMillis() - younger * 1000
        for s in self._fs.listStatus(log) if self._fs.exists(log) else []:
            number = s.getPath().getName()[:-5]
            if number.isdigit() and int(number) <= last - keep:
                self._fs.delete(s.getPath(), False)
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for s in self._fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{s.getPath().getName()}" not in named and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone
