"""Packages for proofreading and for readings: their files as rows (batch, path, content), then written or zipped."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markers
from ..functions import text as tx
from ..sources import archives

#: Fixed value: the folder of a package's page images.
IMAGES = "images-original"


def _image_path(page_marker: Column, file_name: Column) -> Column:
    ending = F.lower(F.regexp_extract(file_name, r"(\.[^./\\]+)$", 1))
    return F.concat(F.lit(f"{IMAGES}/PAGE-"), page_marker, F.when(ending == "", ".png").otherwise(ending))


def _per_batch(rows: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy("batch").agg(F.transform(each, lambda r: r["v"]).alias(out))


def proofreading_files(pages: DataFrame, reviews: DataFrame, project: str, instructions: str) -> DataFrame:
    """(batch, path, content) of manifest.json, ocr.txt, instructions.md and review-items.json.

    pages: (batch, position, page_id, file_name, source_hash, role, text, layer, machine_text, join, low_confidence); reviews:
    (batch, page_id, code, message, text).  Pages are marked from 0001 in order; a review of a page that is not there is out.
    """
    from pyspark.sql import Window

    p = pages.withColumn("page_marker", tx.marker(F.row_number().over(Window.partitionBy("batch").orderBy("position"))))
    entry = F.struct(
        F.col("page_marker").alias("pageMarker"), F.col("page_id").alias("projectPageId"), F.col("position").alias("sortOrder"), F.col("file_name").alias("sourceFileName"), F.col("source_hash").alias("sourceFileHash"),
        _image_path(F.col("page_marker"), F.col("file_name")).alias("originalImage"), F.col("role").alias("pageRole"), tx.text_hash(F.col("machine_text")).alias("machineTextHash"),
        tx.text_hash(F.col("text")).alias("baselineTextHash"), F.col("layer").alias("baselineSource"), F.col("join").alias("joinToNext"), F.col("low_confidence").alias("lowConfidenceCount"),
    )
    listed = _per_batch(p, "position", entry, "pages")
    head = [F.lit(2).alias("formatVersion"), F.lit(project).alias("projectId"), F.col("batch").cast("string").alias("batchId"), F.size("pages").alias("pageCount"), "pages"]
    manifest = listed.select("batch", F.lit("manifest.json").alias("path"), F.to_json(F.struct(*head)).alias("content"))
    texts = markers.rendered(pages, "batch", "position", "text", "join", F.lit(project), F.first(F.col("batch").cast("string"))).select("batch", F.lit("ocr.txt").alias("path"), "content")
    r = reviews.select(F.col("batch").alias("_b"), F.col("page_id").alias("_p"), "code", "message", F.col("text").alias("_t"))
    found = p.join(r, (F.col("batch") == F.col("_b")) & (F.col("page_id") == F.col("_p"))).select("batch", F.struct("page_marker", "code", "message", "_t").alias("o"))
    items = _per_batch(found, "o", F.struct(F.col("o.page_marker").alias("pageMarker"), F.col("o.code").alias("code"), F.col("o.message").alias("message"), F.col("o._t").alias("text")), "items")
    both = listed.select("batch").join(items.withColumnRenamed("batch", "_b"), F.col("batch") == F.col("_b"), "left")
    review = both.select("batch", F.lit("review-items.json").alias("path"), F.coalesce(F.to_json("items"), F.lit("[]")).alias("content"))
    guide = listed.select("batch", F.lit("instructions.md").alias("path"), F.lit(instructions).alias("content"))
    return manifest.unionByName(texts).unionByName(review).unionByName(guide)


def reading_files(paragraphs: DataFrame, pages: DataFrame, candidates: DataFrame, project: str, policy: str, schema: str, instructions: str) -> DataFrame:
    """(batch, path, content) of manifest.json, confirmed-document.json, ruby-candidates.json, output-schema.json and instructions.md.

    paragraphs: (batch, ordinal, paragraph_id, role, plain_text, spans array<struct<page_marker, start, length>>, document_hash);
    pages: (batch, page_marker, page_id); candidates: (batch, page_marker, ordinal, ...), written as they are.
    """
    spans = F.transform("spans", lambda s: F.struct(s["page_marker"].alias("pageMarker"), s["start"].alias("start"), s["length"].alias("length")))
    entry = F.struct(F.col("paragraph_id").alias("paragraphId"), "role", F.col("plain_text").alias("text"), tx.text_hash(F.col("plain_text")).alias("textHash"), spans.alias("sourceSpans"))
    hashes = paragraphs.groupBy(F.col("batch").alias("_h")).agg(F.first("document_hash").alias("hash"))
    head = lambda rows, out: rows.join(hashes, F.col("batch") == F.col("_h")).select(
        "batch", F.to_json(F.struct(F.lit(1).alias("formatVersion"), F.lit(project).alias("projectId"), F.col("batch").cast("string").alias("batchId"), F.col("hash").alias("documentTextHash"), F.lit(policy).alias("rubyPolicy"), out)).alias("content")
    )
    listed = _per_batch(pages, "page_marker", F.struct(F.col("page_id").alias("pageId"), F.col("page_marker").alias("pageMarker")), "pages")
    named = lambda rows, path: rows.select("batch", F.lit(path).alias("path"), "content")
    manifest = named(head(listed, "pages"), "manifest.json")
    document = named(head(_per_batch(paragraphs, "ordinal", entry, "paragraphs"), "paragraphs"), "confirmed-document.json")
    ordered = candidates.withColumn("_o", F.struct("page_marker", "ordinal"))
    some = _per_batch(ordered, "_o", F.struct(*(c for c in candidates.columns if c != "batch")), "items").withColumnRenamed("batch", "_b")
    read = named(hashes.select(F.col("_h").alias("batch")).join(some, F.col("batch") == F.col("_b"), "left").withColumn("content", F.coalesce(F.to_json("items"), F.lit("[]"))), "ruby-candidates.json")
    fixed = hashes.select(F.col("_h").alias("batch"), F.inline(F.array(*(F.struct(F.lit(n).alias("path"), F.lit(t).alias("content")) for n, t in (("output-schema.json", schema), ("instructions.md", instructions))))))
    return manifest.unionByName(document).unionByName(read).unionByName(fixed)


@F.pandas_udf(T.BinaryType())
def _zipped(files: pd.Series) -> pd.Series:
    def pack(rows) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(zipfile.ZipInfo(r["path"]), r["content"], zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return files.map(pack)


def zipped(files: DataFrame) -> DataFrame:
    """(batch, content): each batch's files (batch, path, content) as one archive, in the order of their paths."""
    rows = F.array_sort(F.collect_list(F.struct("path", F.col("content").cast("string").alias("content"))))
    return files.groupBy("batch").agg(rows.alias("f")).select("batch", _zipped("f").alias("content"))


@F.pandas_udf(T.StringType())
def _proofread(archives: pd.Series) -> pd.Series:
    def read(raw) -> str | None:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            name = next((n for n in ("proofread.txt", "proofread.md") if n in z.namelist()), None)
            return z.read(name).decode("utf-8-sig") if name else None

    return archives.map(lambda b: None if b is None else read(bytes(b)))


def proofread_text(path: Column, content: Column) -> Column:
    """What a returned file says: an archive's proofread.txt, else its proofread.md, else null; any other file as it is."""
    archive = F.lower(path).endswith(".zip")
    return F.when(archive, _proofread(F.when(archive, content))).otherwise(F.decode(content, "UTF-8"))


def write_packages(files: DataFrame, folder: str, kind: str = "zip", overwrite: bool = False, **limits: str) -> None:
    """Writes each batch's files (batch, path, content) below folder, a URI: as an archive or a folder of its name."""
    archives.write(files.select(F.col("batch").cast("string").alias("package"), "path", "content"), folder, kind, overwrite, **limits)


def write_files(files: DataFrame, folder: str, **limits: str) -> int:
    """Writes (path, content) below folder, a URI that must not be there yet; returns their number.

    Files are staged by the tasks and moved one by one when all are there; when one fails, nothing is left.  limits: those of
    archives.Packages, for folders that are uploaded.
    """
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(folder)
    above, _, name = folder.rstrip("/").rpartition("/")
    n = files.count()
    archives.write(files.select(F.lit(name).alias("package"), "path", "content"), above, "folder", **limits)
    return n


def replace_file(uri: str, content: bytes, problems) -> None:
    """Puts a file in place of the one at uri, or where there is none, once problems(content) finds nothing wrong with it.

    It is written under another name beside it first, and moved when it is whole: who reads uri sees the old file or the new one.
    """
    from pyarrow import fs as pafs

    wrong = problems(content)
    if wrong:
        raise ValueError("; ".join(wrong))
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    other = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    fs.create_dir(folder)
    try:
        with fs.open_output_stream(other) as out:
            out.write(content)
        fs.move(other, path)
    finally:
        if fs.get_file_info(other).type == pafs.FileType.File:
            fs.delete_file(other)
