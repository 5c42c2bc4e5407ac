"""WARC archives: written, read back, and indexed by an external merge of sorted capture runs."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: Payload bytes of an archive file, captures of an index range, and bytes read at a time.
SEGMENT, RANGE_ROWS, READ = 64 << 20, 50_000, 1 << 20
#: Payloads of at least so many bytes are recorded once; equal later ones revisit them.
LEAST = 0
#: Revisits that may be broadcast, after they have been counted.
BROADCAST_ROWS = 100_000
_EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sort_key(url: str | None) -> str:
    """The URL with its host's labels turned round: captures of a host, and of its domain, sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
    except ValueError:
        return url.lower()
    rest = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host)) + ")" + (rest.lower() or "/")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the headers only."""
    name = "" if page_id is None else str(page_id)
    when = (_EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {when}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$&()*+,/:;=?@[]~%')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _opened(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzipped archive, one member at a time."""
    unpack, out = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            out += unpack.decompress(chunk)
            chunk = b""
            if unpack.eof:
                chunk = unpack.unused_data
                yield _parsed(bytes(out))
                unpack, out = zlib.decompressobj(31), bytearray()
    if out:
        raise ValueError("the archive ends inside a record")


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


_SEGMENT = pa.schema([("segment", pa.string()), ("records", pa.int64())])
_ENTRY = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_ENTRY_SQL = "run string, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _writer(folder: str):
    """Writes a task's records to archives; only those in the rows returned count, so a repeated task does no harm."""

    def run(batches):
        fs, root = _opened(folder)
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                out.write(_gzip(record(page_id.as_py(), url.as_py(), payload, digest32(payload), refers_to.as_py())))
                size, records = size + len(payload), records + 1
                if size >= SEGMENT:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"segment": f"{folder}/{name}", "records": records}], _SEGMENT)
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"segment": f"{folder}/{name}", "records": records}], _SEGMENT)

    return run


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
    return int(found[1]) if found else None


def _entry(segment: str, fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    size = int(re.search(rb"(?i)content-length: *([0-9]+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"{segment}: a payload does not match its digest")
    url = fields.get("warc-target-uri")
    return {
        "run": segment, "url_key": sort_key(unquote(url)) if url else "", "captured": fields["warc-date"], "page_id": _page(fields["warc-record-id"]), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
    }


def _order(e: dict) -> tuple:
    return e["url_key"], e["captured"], e["page_id"] if e["page_id"] is not None else -1


def _reader(batches):
    """A sorted run of captures for each archive; payloads are checked against their digests and let go."""
    for batch in batches:
        for segment in batch["segment"]:
            fs, path = _opened(segment.as_py())
            with fs.open_input_stream(path, compression=None) as f:
                run = sorted((_entry(segment.as_py(), *x) for x in read_records(iter(lambda: f.read(READ), b""))), key=_order)
            for at in range(0, len(run), 10_000):
                yield pa.RecordBatch.from_pylist(run[at : at + 10_000], _ENTRY)


class LoserTree:
    """k-way merge of sorted iterators: each step replays one path of the tree, log2(k) comparisons."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """-1 stands for a place not yet played, which wins; an ended run loses to all."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (self.key(x), a) < (self.key(y), b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _merger(batches):
    """Merges the runs that reach one range of the index.  A run's rows come in order from the shuffle's blocks; where a block
    came in parts, each stretch that is in order counts as a run."""
    runs: list[list[dict]] = []
    open_: dict[str, int] = {}
    for batch in batches:
        for e in batch.to_pylist():
            at = open_.get(e["run"])
            if at is None or _order(runs[at][-1]) > _order(e):
                open_[e["run"]] = at = len(runs)
                runs.append([])
            runs[at].append(e)
    out = []
    for e in LoserTree([iter(r) for r in runs], _order):
        out.append(e)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_pylist(out, _ENTRY)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _ENTRY)


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes (page_id, url, html) to WARC files in the shared folder; returns (segment, records), a row an archive.

    A null html is an empty payload.  Of equal payloads of at least `least` bytes the one with the smallest page_id is a
    response and the others revisit it; a null page_id is always a response, rows that repeat a page_id and payload are
    alike.  Extra columns are ignored.  Each record is a gzip member of its own.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = p.where(F.octet_length("html") >= least).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    digests = stored(digests, "warc-digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = stored(digests.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    named = again.withColumnsRenamed({"page_id": "r_page", "digest": "r_digest"})
    rows = p.join(named, (p.page_id == F.col("r_page")) & (F.sha1(p.html.cast("binary")) == F.col("r_digest")), "left").select("page_id", "url", "html", "refers_to")
    folder = scratch(spark, "warc")
    fs, root = _opened(folder)
    fs.create_dir(root)
    return stored(rows.mapInArrow(_writer(folder), "segment string, records long"), "warc-segments")


def read(segments: DataFrame) -> DataFrame:
    """The captures of all archives, each archive's in order: (run, url_key, captured, page_id, ...)."""
    n = max(1, segments.count())
    return stored(segments.repartition(min(n, 100_000)).mapInArrow(_reader, _ENTRY_SQL), "warc-runs")


def index(runs: DataFrame) -> DataFrame:
    """The capture histories: all captures ordered by URL key and time, with their place in the whole order.

    Ranges of keys, cut at sampled quantiles of (key, time), are merged separately; so one URL with very many captures is
    spread over many ranges.  place counts from 0 over the whole index: a range's captures start where those before it end.
    """
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    merged = runs.repartitionByRange(ranges, "url_key", "captured", F.coalesce("page_id", F.lit(-1))).mapInArrow(_merger, _ENTRY_SQL)
    # A task's rows are numbered from its partition, shifted by 33 bits, upwards.
    merged = stored(merged.withColumn("at", F.monotonically_increasing_id()), "warc-index")
    part, within = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    starts = merged.groupBy(part).agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return merged.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).select(*_ENTRY.names, (F.col("start") + within).alias("place"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Captures with their URL key and time, and with the place that the merge gave them among all, from 0."""
    histories = index(read(write(table(spark, sf_dir, "pages"))))
    return histories.select("page_id", "url_key", "captured", "place", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h, strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]*)(:[0-9]*)?([^?#]*)(\?[^#]+)?', ['login', 'host', 'port', 'path', 'query']) AS u FROM pages),
k AS (SELECT page_id, coalesce(array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || coalesce(nullif(lower(u.path || u.query), ''), '/'), '') AS url_key FROM p),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::BIGINT) AS g FROM p)
SELECT page_id, url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS place, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM v JOIN f USING (h) JOIN k USING (page_id)
"""
