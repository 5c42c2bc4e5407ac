"""Scores of texts by an interpolated bigram model, its mixture weights learned on held-out counts by expectation-maximisation.

The probability of a word after another is a mixture of the maximum-likelihood estimates of both words, of the word alone, and
of all words alike; each bucket of context frequencies has weights of its own.

Texts are written once as chunks of hashed tokens.  Each chunk asks for the counts of its distinct n-grams, packed by ranges of
their hashes; each range adds up what all chunks have and answers each chunk in its own order.  So an n-gram is sent once a
chunk however often it comes, the ranges are even whatever the words, and no table of counts is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, parts, release, stored, table, text_bytes

#: Of ten parts of the documents one is never learned from; another one sets the weights.
PARTS, NEVER, WEIGHTS = 10, 0, 1
KEPT, HELD, TEST = 0, 1, 2
#: Additive smoothing of the base score.
ADD = 0.1
#: Bytes of text of a chunk and of a range of hashes, about; chunks for each shuffle partition, at least, so that tasks even out.
CHUNK, RANGE, EACH = 6 << 20, 8 << 20, 2
#: Ranges of hashes, at least.
RANGES = 8
#: Cells of the held-out counts: steps an octave of both estimates.  A cell stands for its own mean.
STEPS = 4
BUCKETS = 64
ROUNDS, CLOSE = 200, 1e-7
_SEED = 13
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_END, _START = (np.uint64(xxhash.xxh64_intdigest(mark, _SEED)) for mark in (b" ", b"\n"))
_CHUNKS = "chunk long, kind int, ids array<long>, sizes array<long>, words binary, at binary"
_ASKED = "part long, grams int, chunk long, kind int, keys binary, n binary"
_TOLD = "chunk long, kind int, grams int, part long, kept binary, every binary, n_types long, n_tokens long"


def hashes(text: bytes) -> np.ndarray:
    """The hashed words of a text, A-Z lower-cased, and its end."""
    found = [np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in part.split()), np.uint64) for part in parts(text.translate(_LOWER))]
    return np.concatenate([*found, np.array([_END])])


def _packed(keys: np.ndarray) -> bytes:
    """Sorted distinct numbers: the first, and the gaps in as many bytes as the widest needs."""
    gaps = np.diff(keys)
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    if len(packed) < 9:
        return np.empty(0, np.uint64)
    narrow = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, packed[0])
    gaps = np.zeros((len(narrow), 8), np.uint8)
    gaps[:, : packed[0]] = narrow
    return np.cumsum(np.concatenate((np.frombuffer(packed[1:9], "<u8"), gaps.view("<u8").ravel())), dtype=np.uint64)


def _length(packed: bytes) -> int:
    return 0 if len(packed) < 9 else 1 + (len(packed) - 9) // packed[0]


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _large(small: bytes) -> np.ndarray:
    return np.frombuffer(small, f"<u{small[0]}", offset=1).astype(np.int64)


def _chunks(size: int):
    """Texts of a task as chunks of about `size` bytes: kinds apart, a text never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict = {k: ([], [], 0) for k in (KEPT, HELD, TEST)}

        def row(kind: int) -> pa.RecordBatch:
            ids, tokens, _ = held[kind]
            held[kind] = ([], [], 0)
            words, at = np.unique(np.concatenate(tokens), return_inverse=True)
            planes = at.astype("<u4").view(np.uint8).reshape(-1, 4).T
            values = [[(task << 32) + made], [kind], [ids], [[len(t) for t in tokens]], [_packed(words)], [zstandard.compress(planes.tobytes())]]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["chunk", "kind", "ids", "sizes", "words", "at"])

        for batch in batches:
            for doc_id, kind, text in zip(batch["doc_id"], batch["kind"], batch["text"].cast(pa.binary()), strict=True):
                kind, text = kind.as_py(), text.as_py()
                ids, tokens, used = held[kind]
                ids.append(doc_id.as_py())
                tokens.append(hashes(text))
                held[kind] = (ids, tokens, used + len(text) + 1)
                if held[kind][2] >= size:
                    yield row(kind)
                    made += 1
        for kind in held:
            if held[kind][0]:
                yield row(kind)
                made += 1

    return run


def _grams(words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a chunk in order, which of them each token ends, and which tokens are the first of their texts."""
    first = np.zeros(len(at), np.bool_)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    own = words[at]
    before = np.concatenate(([_START], own[:-1]))
    before[first] = _START
    h = before * np.uint64(0x9E3779B97F4A7C15) + (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    pairs, of = np.unique(h ^ (h >> np.uint64(32)), return_inverse=True)
    return pairs, of, first


def _read(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(chunk["at"]), np.uint8).reshape(4, -1)
    return _unpacked(chunk["words"]), np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64), np.array(chunk["sizes"], np.int64)


def _asked(ranges: int):
    """What chunks ask for: their distinct words (grams 1) and pairs (grams 2) with their own counts, by ranges of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                words, at, sizes = _read(chunk)
                pairs, of, _ = _grams(words, at, sizes)
                rows = []
                for grams, keys, n in ((1, words, np.bincount(at, minlength=len(words))), (2, pairs, np.bincount(of, minlength=len(pairs)))):
                    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    rows += [(int(part[a]), grams, chunk["chunk"], chunk["kind"], _packed(keys[a:b]), _small(n[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "grams", "chunk", "kind", "keys", "n"])

    return run


def _told(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Adds up one range, and answers each chunk in the order it asked; a row without a chunk counts the range itself."""
    release()
    part, grams = (k.as_py() for k in key)
    chunks, kinds = rows["chunk"].to_pylist(), rows["kind"].to_pylist()
    # The keys of a chunk are unpacked again where they are needed: at no time are those of all chunks held but in the one array that is sorted.
    every, at = np.empty(sum(_length(k.as_py()) for k in rows["keys"]), np.uint64), 0
    for k in rows["keys"]:
        one = _unpacked(k.as_py())
        every[at : at + len(one)] = one
        at += len(one)
    every.sort()
    new = np.ones(len(every), np.bool_)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    every = every[new]
    kept, total, spans = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), []
    for k, n, kind in zip(rows["keys"], rows["n"], kinds, strict=True):
        spans.append(np.searchsorted(every, _unpacked(k.as_py())).astype(np.uint32))
        if kind != TEST:
            total[spans[-1]] += _large(n.as_py())
        if kind == KEPT:
            kept[spans[-1]] += _large(n.as_py())
    out = [[*chunks, None], [*kinds, None], [grams] * (len(spans) + 1), [part] * (len(spans) + 1), [*(_small(kept[s]) if k == HELD else None for s, k in zip(spans, kinds, strict=True)), None], [*(_small(total[s]) for s in spans), None]]
    out += [[None] * len(spans) + [int((total > 0).sum())], [None] * len(spans) + [int(total.sum())]]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["chunk", "kind", "grams", "part", "kept", "every", "n_types", "n_tokens"])


def _estimates(chunk: dict, told: pa.Table, column: str, tokens: int) -> tuple[np.ndarray, ...]:
    """For each token of a chunk: its own count, its context's, and the maximum-likelihood estimates of the pair and of the word."""
    words, at, sizes = _read(chunk)
    pairs, of, first = _grams(words, at, sizes)
    told = told.sort_by([("grams", "ascending"), ("part", "ascending")])
    counts = {g: np.concatenate([_large(x.as_py()) for x, k in zip(told[column], told["grams"].to_pylist(), strict=True) if k == g]) for g in (1, 2)}
    own = counts[1][at]
    context = np.concatenate(([0], own[:-1]))
    context[first] = counts[1][np.searchsorted(words, _END)]  # a text begins as often as one ends
    both = np.where(context > 0, counts[2][of] / np.maximum(context, 1), 0.0)
    return own, context, both, own / max(1, tokens)


def bucket(counts: np.ndarray) -> np.ndarray:
    """Contexts of like frequency: the bits of their count, 0 for those never met."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _cells(types: int, tokens: int):
    """Held-out tokens of a chunk by context bucket and by both estimates against all words alike, on a scale of octaves."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        found: dict = {}
        if chunks.num_rows and told.num_rows:
            _, context, both, alone = _estimates(chunks.to_pylist()[0], told, "kept", tokens)
            place = lambda x: np.where(x > 0, np.round(STEPS * np.log2(np.maximum(x * (types + 1), 2.0**-64))).astype(np.int64) + 512, 0)
            key = (bucket(context) << 40) | (place(both) << 20) | place(alone)
            cells, of = np.unique(key, return_inverse=True)
            found = {"cell": cells, "n": np.bincount(of), "both": np.bincount(of, both), "alone": np.bincount(of, alone)}
        return pa.table({k: pa.array(found.get(k, []), t) for k, t in (("cell", pa.int64()), ("n", pa.int64()), ("both", pa.float64()), ("alone", pa.float64()))})

    return run


def learned(cell: np.ndarray, n: np.ndarray, both: np.ndarray, alone: np.ndarray, types: int) -> np.ndarray:
    """Weights (bucket, 3) of the pair's, the word's and the even estimate, by expectation-maximisation on counts n with mean estimates.

    One observation is spread evenly over the estimates of a bucket, so that none but the pair's after contexts never met gets
    a weight of 0.  A bucket without held-out counts takes the nearest one's, the rarer of two.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    known = [int(b) for b in np.unique(cell >> 40)]
    for b in known:
        some = (cell >> 40) == b
        f = np.stack([both[some], alone[some], np.full(some.sum(), 1 / (types + 1))], axis=1)
        prior = weights[b].copy()
        for _ in range(ROUNDS):
            share = f * weights[b]
            share *= (n[some] / share.sum(axis=1))[:, None]
            now = (share.sum(axis=0) + prior) / (n[some].sum() + 1)
            close = np.abs(now - weights[b]).max() < CLOSE
            weights[b] = now
            if close:
                break
    for b in range(1, BUCKETS):
        if b not in known and any(k > 0 for k in known):
            weights[b] = weights[min((k for k in known if k > 0), key=lambda k: (abs(k - b), k))]
    return weights


def _scores(weights: np.ndarray, types: int, tokens: int):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        chunk = chunks.to_pylist()[0]
        own, context, both, alone = _estimates(chunk, told, "every", tokens)
        w = weights[bucket(context)]
        mixed = np.log10(w[:, 0] * both + w[:, 1] * alone + w[:, 2] / (types + 1)) if tokens else np.zeros(len(own))
        base = np.log10((own + ADD) / (tokens + ADD * (types + 1)))
        sizes = np.array(chunk["sizes"], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        total = lambda x: pa.array(np.add.reduceat(x, begin))
        m = len(sizes)
        return pa.table({"doc_id": pa.array(chunk["ids"], pa.int64()), "held_out": pa.array([chunk["kind"] == TEST] * m, pa.bool_()), "n_tokens": pa.array(sizes), "n_known": total((own > 0).astype(np.int64)), "train_tokens": pa.array([tokens] * m, pa.int64()), "base_score": total(base), "score": total(mixed)})

    return run


class Model:
    """What was learned: the weights, and the chunks with the counts each of them asked for."""

    def __init__(self, chunks: DataFrame, told: DataFrame, weights: np.ndarray, types: int, tokens: int) -> None:
        self.chunks, self.told, self.weights, self.types, self.tokens = chunks, told, weights, types, tokens


def kind_of(doc_id):
    """Which documents are never learned from (TEST), set the weights (HELD) or give the estimates (KEPT): by crc32 of the id as text."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % PARTS
    return F.when(part == NEVER, TEST).when(part == WEIGHTS, HELD).otherwise(KEPT).cast("int")


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> Model:
    """Counts the n-grams of all texts that are learned from, and learns the weights on those held out among them.

    The weights are learned on estimates from the other texts; scores then use the counts of both.  What comes to the driver
    are the held-out counts in cells, whose number the buckets and steps bound, and two sums.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), kind_of(F.col(doc_id)).alias("kind"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = text_bytes(docs)
    ranges = max(RANGES, -(-size // RANGE))
    each = min(chunk, max(1 << 14, size // (EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    with arrow_batches(spark):
        chunks = stored(docs.mapInArrow(_chunks(each), _CHUNKS), "scoring-chunks")
    with arrow_batches(spark, rows=8):
        asked = chunks.mapInArrow(_asked(ranges), _ASKED)
        told = stored(asked.groupBy("part", "grams").applyInArrow(_told, _TOLD), "scoring-counts")
    types, tokens = told.where("chunk is null and grams = 1").agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    own = _beside(chunks.where(F.col("kind") == HELD), told.where((F.col("kind") == HELD) & F.col("kept").isNotNull()))
    kept = told.where((F.col("kind") == HELD) & (F.col("grams") == 1)).limit(1).count()
    weights = learned(*(np.empty(0, t) for t in (np.int64, np.int64, float, float)), types)
    if kept:
        n_held = chunks.where(F.col("kind") == HELD).agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
        cells = own.applyInArrow(_cells(types, tokens - n_held), "cell long, n long, both double, alone double")
        found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("both").alias("both"), F.sum("alone").alias("alone")).toPandas().sort_values("cell")
        n = found["n"].to_numpy()
        weights = learned(found["cell"].to_numpy(), n, found["both"].to_numpy() / n, found["alone"].to_numpy() / n, types)
    return Model(chunks, told, weights, types, tokens)


def _beside(chunks: DataFrame, told: DataFrame):
    return chunks.groupBy("chunk").cogroup(told.select("chunk", "grams", "part", "kept", "every").groupBy("chunk"))


def scores(model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text that was read, learned from or not."""
    told = model.told.where("chunk is not null")
    return _beside(model.chunks, told).applyInArrow(_scores(model.weights, model.types, model.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """scores() of a model that fit() makes of the same rows.

    A null text is empty and has one token, its end; a null doc_id is learned from; rows that repeat a doc_id are documents of
    their own; other columns are ignored; no rows give no rows.  Where nothing is learned from, every score is 0.
    """
    return scores(fit(df, doc_id, text, chunk))


def op13_interpolation(spark, sf_dir: str) -> DataFrame:
    """score() of documents."""
    return score(table(spark, sf_dir, "documents"))
