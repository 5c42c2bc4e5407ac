"""Substring dedup over a log-structured index of window fingerprints.

Documents come in batches of ascending doc_id.  A batch's window hashes are dealt to buckets by content, sorted, and merge-joined
with the bucket's immutable sorted runs of earlier batches; then they become a run themselves, and too many runs of a bucket
are compacted to one.  Hits are verified on the words before anything is removed.
"""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, scratch, sha256_hex, stored, table, text_bytes

WINDOW = 20
#: Words whose run decides the bucket of a window: neighbouring windows mostly share it and travel together.
ANCHOR = 3
#: Windows that one task handles at a time, and input bytes for each bucket.
CHUNK, BUCKET_BYTES = 1 << 19, 4 << 20
#: Runs that a bucket may have before they are compacted.
FANOUT = 4
#: Batches that a whole table is indexed in.
BATCHES = 2
#: Distinct words whose hashes a task remembers; beyond that it starts anew.
REMEMBERED = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def _rolling(h: np.ndarray, width: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A hash of each run of width values: differences of a running polynomial modulo 2**64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])))
    return _mix((total[width:] - total[:-width]) * inverse[: len(h) - width + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _windows(words: list[list[bytes]], bits: int) -> tuple[np.ndarray, ...]:
    """Hash, bucket anchor, document index and start of every window of some documents."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    h = np.fromiter((_words[w] for ws in words for w in ws), np.uint64, n)
    powers, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    doc = np.repeat(np.arange(len(words)), sizes)
    start = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if n < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = _rolling(h, WINDOW, powers, inverse)
    anchors = _sliding_min(_rolling(h, ANCHOR, powers, inverse), WINDOW - ANCHOR + 1)
    inside = (start + WINDOW <= np.repeat(sizes, sizes))[: len(hashes)]
    if bits < 64:
        hashes = hashes & np.uint64((1 << bits) - 1)
        anchors = np.zeros_like(anchors)
    return hashes[inside], anchors[inside], doc[: len(inside)][inside], start[: len(inside)][inside]


def _segments(doc, start, ref_doc, ref_start) -> np.ndarray:
    """Rows (doc, start, len, ref doc, ref start) of consecutive hits with consecutive references; input by (doc, start)."""
    if not len(doc):
        return np.empty((0, 5), np.int64)
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)))
    at = np.flatnonzero(cut)
    return np.stack((doc[at], start[at], np.diff(np.append(at, len(doc))), ref_doc[at], ref_start[at]), axis=1)


def _firsts(h, doc, start):
    """Sorts by hash, document and start.  Order, and for each sorted entry the place of its hash's first entry."""
    order = np.lexsort((start, doc, h))
    h = h[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)), new


def _hits(doc, start, ref_doc, ref_start) -> np.ndarray:
    """Segments of the entries that are not their own reference."""
    other = (doc != ref_doc) | (start != ref_start)
    doc, start, ref_doc, ref_start = doc[other], start[other], ref_doc[other], ref_start[other]
    by = np.lexsort((start, doc))
    return _segments(doc[by], start[by], ref_doc[by], ref_start[by])


_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _packed_runs(h, doc, start, ids) -> bytes:
    """Entries of one bucket by (document, start), as stretches of consecutive windows and their hashes."""
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.append(cut, len(doc)))
    narrow = lambda x: x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)
    at = ids[doc[cut]]
    return _pack(h=h, n=narrow(count), s=narrow(start[cut]), d=narrow(at - at.min()), least=np.array([at.min()]))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        h, n, s, d = z["h"], z["n"].astype(np.int64), z["s"].astype(np.int64), z["d"].astype(np.int64) + z["least"][0]
    inner = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    return h, np.repeat(d, n), np.repeat(s, n) + inner


def _chunk_rows(ids: np.ndarray, words: list[list[bytes]], buckets: int, bits: int):
    """A chunk's rows: its first windows by bucket (kind 0), and as segments what repeats inside the chunk (kind 1)."""
    h, anchor, doc, start = _windows(words, bits)
    if not len(h):
        return
    order, first, new = _firsts(h, doc, start)
    sdoc, sstart = doc[order], start[order]
    hits = _hits(ids[sdoc], sstart, ids[sdoc[first]], sstart[first])
    for at in range(0, len(hits), 1 << 16):
        part = hits[at : at + (1 << 16)]
        yield int(part[0, 0] % buckets), 1, part.tobytes()
    keep = np.zeros(len(h), bool)
    keep[order[new]] = True
    h, anchor, doc, start = h[keep], anchor[keep], doc[keep], start[keep]
    bucket = (_mix(anchor) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        yield int(bucket[own[0]]), 0, _packed_runs(h[own], doc[own], start[own], ids)


def _mapper(buckets: int, bits: int):
    def run(batches):
        for batch in batches:
            order = np.argsort(batch["doc_id"].to_numpy(zero_copy_only=False), kind="stable")
            ids, words, size, pending = [], [], 0, []

            def flush(ids=ids, words=words):
                rows = list(_chunk_rows(np.array(ids, np.int64), words, buckets, bits))
                ids.clear()
                words.clear()
                return rows

            for i in order:
                w = split_words(batch["text"][int(i)].as_py())
                if len(w) < WINDOW:
                    continue
                ids.append(batch["doc_id"][int(i)].as_py())
                words.append(w)
                size += len(w)
                if size >= CHUNK:
                    pending, size = flush(), 0
                    for at in range(0, len(pending), 64):
                        yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in pending[at : at + 64]], _ROW)
            pending = flush()
            for at in range(0, len(pending), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in pending[at : at + 64]], _ROW)

    return run


_OUT = "kind int, doc_id long, start long, len long, ref_doc long, ref_start long, bucket int, path string, compacted boolean"


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write_run(folder: str, bucket: int, h, doc, start) -> str:
    """A run's file under a name of its own: a repeated task leaves the first one's alone, the manifest names what counts."""
    uri = f"{folder}/b{bucket}-{uuid.uuid4().hex}"
    fs, path = _open(folder)
    path = f"{path}/{uri.rpartition('/')[2]}"
    narrow = lambda x: x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)
    least = doc.min() if len(doc) else 0
    with fs.open_output_stream(path) as f:
        f.write(_pack(h=h, d=(doc - least).astype(np.uint32 if not len(doc) or doc.max() - least < 1 << 32 else np.uint64), s=narrow(start), least=np.array([least])))
    return uri


def _read_run(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fs, path = _open(uri)
    with fs.open_input_stream(path) as f, np.load(io.BytesIO(f.read())) as z:
        return z["h"], z["d"].astype(np.int64) + z["least"][0], z["s"].astype(np.int64)


def _reducer(folder: str, keep_run: bool):
    """Merge-joins a bucket's new entries with its older runs, and writes them as a run."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        local = [np.frombuffer(x, np.int64).reshape(-1, 5) for x in rows.loc[rows["kind"] == 1, "data"]]
        fresh = [_unpacked(x) for x in rows.loc[rows["kind"] == 0, "data"]]
        older = [_read_run(x.decode()) for x in rows.loc[rows["kind"] == 2, "data"]]
        runs = []
        hits = local
        if fresh:
            h, doc, start = (np.concatenate(x) for x in zip(*fresh, strict=True))
            order, first, new = _firsts(h, doc, start)
            h, doc, start = h[order], doc[order], start[order]
            ref_doc, ref_start = doc[first], start[first]
            known = np.zeros(len(h), bool)
            for oh, od, os_ in older:  # both sides are sorted; runs are disjoint, so one match at most
                at = np.minimum(np.searchsorted(oh, h), max(0, len(oh) - 1))
                met = (oh[at] == h) if len(oh) else np.zeros(len(h), bool)
                ref_doc[met], ref_start[met] = od[at[met]], os_[at[met]]
                known |= met
            hits = [*local, _hits(doc, start, ref_doc, ref_start)]
            if keep_run:
                own = new & ~known
                entries, compacted = [(h[own], doc[own], start[own])], len(older) >= FANOUT
                if compacted:
                    merged = [np.concatenate(x) for x in zip(*older, *entries, strict=True)]
                    by = np.argsort(merged[0], kind="stable")
                    entries = [tuple(x[by] for x in merged)]
                runs = [(bucket, _write_run(folder, bucket, *entries[0]), compacted)]
        found = np.concatenate([*hits, np.empty((0, 5), np.int64)])
        out = pd.DataFrame(found, columns=["doc_id", "start", "len", "ref_doc", "ref_start"]).assign(kind=0, bucket=bucket, path=None, compacted=False)
        more = pd.DataFrame([{"kind": 1, "doc_id": 0, "start": 0, "len": 0, "ref_doc": 0, "ref_start": 0, "bucket": b, "path": p, "compacted": c} for b, p, c in runs], columns=[x.split()[0] for x in _OUT.split(", ")])
        return pd.concat([out[list(more.columns)], more]) if len(more) else out[list(more.columns)]

    return run


class FingerprintIndex:
    """The index: files of runs in a shared folder, manifests of those that count, and a small file that names the newest manifest.

    add() takes batches of ascending doc_id, (doc_id, text), and returns their hits: (doc_id, start, len, ref_doc, ref_start),
    len windows from start on whose hashes came earlier, there from ref_start on.  What a batch adds counts once its manifest
    is named, which is done last: an add that fails leaves the index as it was.  open() goes on with an index in another
    session.
    """

    def __init__(self, spark: SparkSession, buckets: int, bits: int = 64, folder: str | None = None) -> None:
        self.spark, self.buckets, self.bits, self.version = spark, buckets, bits, 0
        self.folder = folder or scratch(spark, "fingerprints")
        fs, path = _open(self.folder)
        fs.create_dir(path)
        self._name()

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        fs, path = _open(folder)
        with fs.open_input_stream(f"{path}/index.json") as f:
            found = json.loads(f.read())
        self = cls.__new__(cls)
        self.spark, self.folder = spark, folder
        self.buckets, self.bits, self.version = found["buckets"], found["bits"], found["version"]
        return self

    def _name(self) -> None:
        fs, path = _open(self.folder)
        with fs.open_output_stream(f"{path}/index.json") as f:
            f.write(json.dumps({"buckets": self.buckets, "bits": self.bits, "version": self.version}).encode())

    @property
    def manifest(self) -> DataFrame | None:
        """(bucket, path, compacted) of the runs that count; none before the first batch."""
        return self.spark.read.schema("bucket int, path string, compacted boolean").parquet(f"{self.folder}/manifest-{self.version}") if self.version else None

    def add(self, batch: DataFrame, keep_run: bool = True) -> DataFrame:
        """keep_run=False only looks: the batch's own windows are not kept."""
        rows = batch.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_mapper(self.buckets, self.bits), "bucket int, kind int, data binary")
        old = self.manifest
        if old is not None:
            rows = rows.union(old.select("bucket", F.lit(2), F.col("path").cast("binary")))
        out = stored(rows.groupBy("bucket").applyInPandas(_reducer(self.folder, keep_run), _OUT), "fingerprint-hits")
        if keep_run:
            new = out.where("kind = 1").select("bucket", "path", "compacted")
            if old is not None:
                new = old.join(new.where("compacted").select("bucket"), "bucket", "left_anti").select("bucket", "path", "compacted").union(new)
            new.write.mode("overwrite").parquet(f"{self.folder}/manifest-{self.version + 1}")
            self.version += 1
            self._name()
        return out.where("kind = 0").select("doc_id", "start", "len", "ref_doc", "ref_start")

    def drop(self) -> None:
        remove(self.spark, self.folder)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_DIGESTS = T.ArrayType(_struct(ref_start=T.LongType(), len=T.LongType(), digest=T.BinaryType()))
_CLEANED = _struct(n_words=T.LongType(), removed=T.ArrayType(_struct(start=T.LongType(), end=T.LongType())), kept=T.StringType(), failed=T.ArrayType(_struct(start=T.LongType(), len=T.LongType())))


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


@F.pandas_udf(_DIGESTS)
def _digests(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, wanted, strict=True):
        words = split_words(text)
        out.append([{"ref_start": s["ref_start"], "len": s["len"], "digest": _digest(words[s["ref_start"] : s["ref_start"] + s["len"] + WINDOW - 1])} for s in spans])
    return pd.Series(out)


@F.pandas_udf(_CLEANED)
def _removed(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
    rows = []
    for text, spans in zip(texts, hits, strict=True):
        words = split_words(text)
        gone, failed = np.zeros(len(words) + 1, np.int64), []
        for s in spans if spans is not None else ():
            a, b = s["start"], s["start"] + s["len"] + WINDOW - 1
            if s["digest"] is not None and _digest(words[a:b]) != s["digest"]:
                failed.append({"start": a, "len": s["len"]})
                continue
            gone[a] += 1
            gone[min(b, len(words))] -= 1
        out = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])))).reshape(-1, 2)
        kept = b" ".join([w for w, g in zip(words, out.tolist(), strict=True) if not g]) if len(edges) else b" ".join(words)
        rows.append((len(words), [{"start": int(a), "end": int(b)} for a, b in edges], kept.decode("utf-8", "surrogatepass"), failed))
    return pd.DataFrame(rows, columns=["n_words", "removed", "kept", "failed"])


def _settled(docs: DataFrame, failed: DataFrame) -> DataFrame:
    """Exact hits for windows that met another text of the same hash: their words are looked for in all documents."""
    spark = docs.sparkSession

    def all_windows(only):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    words = split_words(batch["text"][i].as_py())
                    if len(words) < WINDOW:
                        continue
                    starts = range(len(words) - WINDOW + 1)
                    if only:
                        starts = sorted({w for s in batch["failed"][i].as_py() for w in range(s["start"], s["start"] + s["len"])})
                    rows = [{"doc_id": batch["doc_id"][i].as_py(), "start": s, "w": b" ".join(words[s : s + WINDOW])} for s in starts]
                    for at in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("w", pa.binary())]))

        return run

    shape = "doc_id long, start long, w binary"
    asked = stored(failed.mapInArrow(all_windows(True), shape), "fingerprint-asked")
    words = asked.select("w").distinct()
    first = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(all_windows(False), shape).join(words, "w", "left_semi").groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("f"))
    late = asked.join(first, "w").where(F.struct("doc_id", "start") > F.col("f"))
    return late.select("doc_id", "start", F.lit(1).cast("long").alias("len"), F.lit(None).cast("binary").alias("digest"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, removed, kept): one row per row of df; removed has word ranges, kept the rest of the words.

    A word goes if a window of WINDOW words over it also starts earlier: in a smaller doc_id, or in the same document at an
    earlier place.  Windows are judged on the input.  Equal hashes alone remove nothing: the words at both places are compared
    by a 128-bit digest, and where they differ the window is settled on its words.  Null and empty texts have no words;
    rows with a null doc_id take no part and keep their words; rows that repeat a doc_id are one document; a passage that
    a third of all documents hold costs one entry for each chunk of documents.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = FingerprintIndex(df.sparkSession, buckets_of(docs), bits)
    edges = [x for x in sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))] if batches > 1 else []
    lows, highs = [None, *edges], [*edges, None]
    hits = None
    for low, high in zip(lows, highs, strict=True):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > int(low))
        if high is not None:
            part = part.where(F.col("doc_id") <= int(high))
        found = index.add(part, keep_run=high is not None)
        hits = found if hits is None else hits.union(found)
    index.drop()
    return _resolved(docs, docs, hits)


def buckets_of(docs: DataFrame) -> int:
    """How many buckets an index of so much text should have."""
    return 1 << max(2, (text_bytes(docs) // BUCKET_BYTES).bit_length())


def dedup_batch(index: FingerprintIndex, batch: DataFrame, known: DataFrame) -> DataFrame:
    """dedup() of one more batch (doc_id, text) against all that came before it, which the index then holds as well.

    Its doc_ids must be larger than those before.  known: (doc_id, text) of all documents, the batch included: the words at the
    places that the index names are compared there.  Only the batch's windows are hashed, and only buckets with new windows or
    with runs are read.
    """
    d, k = (x.select(F.col("doc_id").cast("long").alias("doc_id"), "text") for x in (batch, known))
    return _resolved(d, k, index.add(d))


def _resolved(docs: DataFrame, known: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of docs without what hits prove to be repeated, by the words of known."""
    wanted = hits.select("ref_doc", "ref_start", "len").distinct().groupBy("ref_doc").agg(F.collect_list(F.struct("ref_start", "len")).alias("wanted"))
    asked = known.join(wanted, known.doc_id == wanted.ref_doc)
    refs = asked.select("ref_doc", F.inline(_digests("text", "wanted")))
    proven = hits.join(refs, ["ref_doc", "ref_start", "len"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "digest")).alias("hits"))
    done = stored(_cleaned(docs, proven), "substring-dedup")
    failed = done.where(F.size("failed") > 0)
    if failed.limit(1).count():
        text_of = docs.join(failed.select(F.col("doc_id").alias("f_id"), "failed").distinct(), F.col("doc_id") == F.col("f_id")).select("doc_id", "text", "failed")
        fine = done.select("doc_id", "failed").join(proven.select("doc_id", F.explode("hits").alias("h")), "doc_id").where(~F.exists("failed", lambda f: (f["start"] == F.col("h.start")) & (f["len"] == F.col("h.len")))).select("doc_id", "h.start", "h.len", F.lit(None).cast("binary").alias("digest"))
        proven = fine.union(_settled(known, text_of)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "digest")).alias("hits"))
        done = stored(_cleaned(docs, proven), "substring-dedup")
    return done.select("doc_id", "n_words", "removed", "kept")


def _cleaned(docs: DataFrame, proven: DataFrame) -> DataFrame:
    p = proven.withColumnRenamed("doc_id", "p_id")
    rows = docs.join(p, docs.doc_id == p.p_id, "left").select("doc_id", _removed("text", "hits").alias("r"))
    return rows.select("doc_id", "r.n_words", "r.removed", "r.kept", "r.failed")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """dedup() of documents: null texts have no words, a null doc_id takes no part and keeps its words."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), sha256_hex(F.col("kept")).alias("kept_sha256"))


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
h AS (SELECT doc_id, i FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM h, unnest(range(0, {WINDOW})) AS t(j)),
e AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
