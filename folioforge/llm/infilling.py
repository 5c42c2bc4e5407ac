"""Fill-in-middle training texts: seeded cuts at code points, found in Elias-Fano lists of where the code points start.

Identical texts, by their content, share one list: it is computed once for each distinct text and joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, packed, release, sha256_hex, stored, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts: so many are cut at all, and so many of these get the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Seed of the cuts.
SEED = 1
#: Rows that may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000
#: Bytes of upper bits between two entries of a list's rank directory; bytes of text handled at once.
_RANK, _PART = 512, 1 << 20
#: Rows that a task hands on at once.
TOGETHER = 256
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")
EDGES = T.StructType([T.StructField("size", T.LongType()), T.StructField("bits", T.IntegerType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("ranks", T.BinaryType())])


def _starts(text: bytes, at: int) -> np.ndarray:
    """Where code points start in one part of a text in UTF-8, and its end after the last part."""
    part = np.frombuffer(text, np.uint8, min(_PART, len(text) - at), at)
    found = np.flatnonzero((part & 0xC0) != 0x80) + at
    return found if at + len(part) < len(text) else np.append(found, len(text))


def boundaries(text: bytes) -> dict:
    """The Elias-Fano list of a text's boundaries: the offsets of its code points in UTF-8, and its length in bytes.

    Of each offset the lowest `bits` bits stand in low; the rest is in high, a one for each offset after as many zeros as its
    upper part is large.  ranks counts the ones before each block of high, so that an entry is found without reading the list.
    """
    cuts = range(0, max(1, len(text)), _PART)
    size = 1 + sum(int(((np.frombuffer(text, np.uint8, min(_PART, len(text) - at), at) & 0xC0) != 0x80).sum()) for at in cuts)
    bits = max(0, (len(text) // size).bit_length() - 1)
    high = np.zeros((len(text) >> bits) + size + 1, np.bool_)
    low = np.zeros(size * bits, np.bool_)
    done = 0
    for at in cuts:
        values = _starts(text, at)
        index = np.arange(done, done + len(values))
        high[(values >> bits) + index] = True
        for k in range(bits):
            low[index * bits + k] = values >> k & 1
        done += len(values)
    upper = np.packbits(high, bitorder="little")
    ones = np.bitwise_count(np.pad(upper, (0, -len(upper) % _RANK))).reshape(-1, _RANK).sum(axis=1, dtype=np.int64)
    return {"size": size, "bits": bits, "low": np.packbits(low, bitorder="little").tobytes(), "high": upper.tobytes(), "ranks": np.append(0, np.cumsum(ones)).astype("<i8").tobytes()}


def select(edges: dict, i: int) -> int:
    """The byte offset of boundary i of a list."""
    if not 0 <= i < edges["size"]:
        raise IndexError(i)
    ranks, bits = np.frombuffer(edges["ranks"], "<i8"), edges["bits"]
    block = int(np.searchsorted(ranks, i, side="right")) - 1
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(edges["high"], np.uint8)[block * _RANK : (block + 1) * _RANK], bitorder="little"))
    upper = block * _RANK * 8 + int(ones[i - int(ranks[block])]) - i
    low = np.frombuffer(edges["low"], np.uint8)
    return (upper << bits) | sum(int(low[(i * bits + k) // 8] >> (i * bits + k) % 8 & 1) << k for k in range(bits))


def cut(text: bytes, edges: dict, seeds: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and middle, output) of one text."""
    n = edges["size"] - 1
    h1, h2, h3, h4 = seeds
    if not n or h3 % 100 >= CUT or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = select(edges, first), select(edges, last)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, last - first, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", first, last - first, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


@F.arrow_udf(EDGES)
def _boundaries(texts: pa.Array) -> pa.Array:
    return pa.array([boundaries(t.as_py()) for t in texts.cast(pa.binary())], pa.struct([("size", pa.int64()), ("bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("ranks", pa.binary())]))


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (_row, text, edges, seeds) as (_row, text, n, form, prefix_chars, middle_chars, output), few rows at a time, so that long texts do not add up."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            found = []
            for text, known, seed in zip(part["text"].cast(pa.binary()), part["edges"], part["seeds"], strict=True):
                raw = text.as_py() or b""
                found.append(cut(raw, known.as_py() or boundaries(raw), tuple(seed.as_py())))
            n, form, first, middle, output = zip(*found, strict=True)
            made = [*(pa.array(c, k) for c, k in zip((n, form, first, middle), kinds, strict=True)), pa.array(output, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([part["_row"], part["text"], *made], ["_row", "text", *COLUMNS])
    release()


def seeds(doc_id: Column, seed: int = SEED) -> Column:
    """Four unsigned numbers of 32 bits from the SHA-256 of the seed and the id; a null id is an empty string."""
    digest = sha256_hex(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  Each mark stands once in an output that was cut, since texts that hold one are left plain."""
    rest = F.substring(output, F.lit(4), F.length(output))
    piece = lambda value, mark, k: F.split_part(value, F.lit(mark), F.lit(k))
    first, middle = piece(rest, MIDDLE, 1), piece(rest, MIDDLE, 2)
    psm = F.concat(piece(first, SUFFIX, 1), middle, piece(first, SUFFIX, 2))
    spm = F.concat(piece(first, PREFIX, 2), middle, piece(first, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def distinct_texts(copies: DataFrame) -> DataFrame:
    """The index: (key, own, edges), the first text of each key and its boundary list; copies: (text, key).  Each task sends a text once."""
    return copies.groupBy("key").agg(F.min("text").alias("own")).select("key", "own", _boundaries("own").alias("edges"))


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, bits: int = 64) -> DataFrame:
    """df and n, form (plain, psm or spm), prefix_chars, middle_chars and output; columns of df so named are kept, the new ones get a _.

    Null texts are empty; empty texts and those that hold a mark are plain; a null doc_id draws as an empty one; rows that
    repeat a doc_id are cut alike.  Texts that nothing else shares a key with are cut where they are read.  The others meet
    their key's text in the index and are compared with it, letter for letter, before they take its list; a text that has
    only its key in common with it gets a list of its own.  A text that very many rows have is one row of the index and a
    join that adaptive execution can split.  bits: of the key (tests take few).
    """
    value = F.coalesce("text", F.lit(""))
    rows = packed(df, text, text=F.col(text).cast("string"), seeds=seeds(F.col(doc_id), seed)).withColumn("key", F.shiftrightunsigned(F.xxhash64(value), 64 - bits) if bits < 64 else F.xxhash64(value))
    several = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "infilling-keys")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    copies = rows.join(several, "key", "left_semi")
    known = F.when(value == F.col("own"), F.col("edges"))
    met = copies.join(distinct_texts(copies.select("key", value.alias("text"))), "key").select("_row", "text", known.alias("edges"), "seeds")
    alone = rows.join(several, "key", "left_anti").select("_row", "text", F.lit(None).cast(EDGES).alias("edges"), "seeds")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    made = T.StructType([met.schema["_row"], T.StructField("text", T.StringType()), *(T.StructField(c, k) for c, k in zip(COLUMNS, kinds, strict=True))])
    found = alone.union(met).mapInArrow(_cuts, made)
    return found.select(*(F.col("text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns), *(F.col(c).alias(free(df, c)) for c in COLUMNS))


def op12_infilling(spark, sf_dir: str) -> DataFrame:
    """fill_in_middle() of documents, and each text rebuilt from its output."""
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS z, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS o FROM h),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR z >= {CUT} THEN 'plain' WHEN o < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM s),
p AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS q FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || q || '{MIDDLE}' || m ELSE '{SUFFIX}' || q || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
