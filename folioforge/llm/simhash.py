"""Near duplicates.

op8_simhash: SimHash fingerprints of three-word shingles, pigeonhole blocks and a Hamming check.  The pipeline's stage: five-word
shingles at a Jaccard similarity of 0.8 or more; candidates by SimHash fingerprints of these, blocks and the Hamming check, and by
min-hash bands for those that are farther than 3 bits apart; every pair compared shingle for shingle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, release, stored, table
from .components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Block edges in bits: six blocks, so that two fingerprints at distance 3 or less agree on three of them at least.
EDGES = (0, 11, 22, 33, 44, 54, 64)
#: A block bucket of up to so many fingerprints is joined with itself; larger ones go through hubs (below), which is exact as well.
BUCKET = 256
#: The stage's rule: texts are near copies if their sets of so many consecutive words have this Jaccard similarity at least, as a fraction.
STAGE_SHINGLE, SIMILAR = 5, (4, 5)
#: Bands, and min-hashes of a band: of pairs at 0.8 all but 1 in 1,200 meet in a band, of pairs at 0.85 all but 1 in 19,000.
BANDS, ROWS = 18, 5
#: Words of 64 bits in which shingles are counted modulo 2: they differ in no more bits than the sets differ in shingles.
SKETCH = 16
#: Rounds of hubs before the members of a band are paired, at most; they end once the pairs left are no more than so many for each
#: member, or a round has left more than this share of them.
ROUNDS, PAIRS, LEFT = 8, 1, 0.5
#: Rows that may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000
_PART = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number; null and wordless texts have zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, total = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _PART):
        part = words[at : at + _PART + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
        h = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """df and a long column out with the fingerprint's 64 bits."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts)).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def _block(fp, at: int):
    low, width = EDGES[at], EDGES[at + 1] - EDGES[at]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)), width


def _blocks(fps: DataFrame) -> DataFrame:
    """Each fingerprint under each choice of three blocks: (t, key, fp, node)."""
    rows = []
    for t, chosen in enumerate(itertools.combinations(range(len(EDGES) - 1), len(EDGES) - 1 - DISTANCE)):
        key, shift = F.lit(0).cast("long"), 0
        for b in chosen:
            part, width = _block(F.col("fp"), b)
            key, shift = key.bitwiseOR(F.shiftleft(part, shift)), shift + width
        rows.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return fps.select("fp", "node", F.inline(F.array(*rows)))


def _hub_links(fps: DataFrame) -> DataFrame:
    """Links that join up all fingerprints within DISTANCE, in rows linear in their number.

    Each fingerprint stands at every hub within 2 bits, and marks the hubs within 1 bit as near.  All that are near one hub
    are within 2 bits of each other; all others at a hub are within 3 bits of each that is near.  So linking everyone at a hub
    with its smallest near member makes only true links, and two fingerprints within 3 bits meet at a hub between them.
    """
    ones = [1 << i for i in range(64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*(F.lit(signed(m)).cast("long") for m in (0, *ones, *(a | b for a, b in itertools.combinations(ones, 2)))))
    near = fps.select("fp", "node", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"), "node", (F.bit_count("mask") <= 1).alias("near"))
    first = near.where("near").groupBy("hub").agg(F.min("node").alias("v"))
    return near.join(first, "hub").where("node <> v").select(F.col("node").alias("u"), "v")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fps: (fp, node), distinct fingerprints.  Links (u, v) that connect all nodes within DISTANCE bits, and no others.

    Blocks are counted by partial sums, so that one that a third of the fingerprints share is no task's alone; only those that
    two meet in are looked at again.
    """
    every = _blocks(fps)
    met = stored(every.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-met")
    placed = every.join(_small(met, met.count()), ["t", "key"])
    small = placed.where(F.col("n") <= bucket)
    a, b = small.alias("a"), small.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE
    found = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    hot = stored(placed.where(F.col("n") > bucket).select("fp", "node").distinct(), "simhash-hot")
    return found.union(_hub_links(hot)) if hot.limit(1).count() else found


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of df.

    Fingerprints within 3 bits are linked, component_id is the smallest doc_id reachable.  Copies are first reduced to one
    node a fingerprint, so a group of copies costs one row in the blocks whatever its size.  A null or empty text has
    fingerprint zero and is linked like any other.  A row with a null doc_id has a fingerprint and a null component_id.
    Rows that repeat a doc_id are one document; other columns of df are ignored.
    """
    docs = stored(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), out="fp").select("doc_id", "fp"), "simhash-docs")
    named = docs.where("doc_id is not null")
    # One doc_id may come with several texts; then the document is at each of its fingerprints.
    nodes = stored(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("doc_id", F.col("least").alias("fp0"))
    at = named.join(several, "doc_id").join(nodes, "fp").join(nodes.select(F.col("fp").alias("fp0"), F.col("node").alias("u")), "fp0")
    twice = at.select("u", F.col("node").alias("v")).where("u <> v")
    labels = components(links(nodes, bucket).union(twice))
    of = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return docs.join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of documents; a null or wordless text has fingerprint zero, a null doc_id a null component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, shingle: int = STAGE_SHINGLE) -> set:
    """The runs of so many words of a text, or all its words if it has fewer; null and wordless texts have none."""
    words = _words(text)
    return set(zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else {tuple(words)} if words else set()


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


_gen = np.random.default_rng(SEED)
_TIMES, _XOR = (_gen.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_PLACES = _gen.integers(0, 1 << 64, STAGE_SHINGLE, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _majority(h: np.ndarray) -> int:
    """The SimHash fingerprint of hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _PART):
        counts += np.unpackbits(h[at : at + _PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def signature(text: str | None) -> tuple[bytes, int, list[int], list[int], int]:
    """A digest of the text's set of shingles, its size, the key of each band, the sketch and the SimHash fingerprint; a wordless text has no bands."""
    words = _words(text)
    if not words:
        return b"\0" * 16, 0, [], [0] * SKETCH, 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - STAGE_SHINGLE + 1
    sums = sum(h[k : k + n] * _PLACES[k] for k in range(STAGE_SHINGLE)) if n > 0 else (h * _PLACES[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
    grams = np.unique(_mixed(_mixed(sums)))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[None, at : at + 4096] ^ _XOR[:, None]
        part *= _TIMES[:, None]
        least = np.minimum(least, part.min(axis=1))
    bands = [xxhash.xxh64_intdigest(row.tobytes(), t) for t, row in enumerate(least.reshape(BANDS, ROWS))]
    odd = np.bincount((grams >> np.uint64(64 - (SKETCH * 64).bit_length() + 1)).astype(np.int64), minlength=SKETCH * 64) % 2
    return xxhash.xxh3_128_digest(grams.tobytes()), len(grams), bands, np.packbits(odd.astype(bool)).view("<u8").tolist(), _majority(grams)


def with_signature(df: DataFrame, text: str) -> DataFrame:
    """df and a column _s: struct<node, size, bands, sketch, fp>."""

    @F.arrow_udf(T.StructType([T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]))
    def of(texts: pa.Array) -> pa.Array:
        found = [signature(x.as_py()) for x in texts]
        release()  # sets of words of long texts, and what tasks before this one have left in the worker
        signed = lambda rows: pa.array([np.array(r, np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), signed(f[2] for f in found), signed(f[3] for f in found), pa.array(np.array([f[4] for f in found], np.uint64).view(np.int64))], ["node", "size", "bands", "sketch", "fp"])

    return df.withColumn("_s", of(F.col(text)))


def _may_be_similar(a: str, b: str):
    """False only for pairs that cannot be similar: by the sizes of their sets, and by the sketches' differing bits."""
    low, high = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    differ = sum((F.bit_count(F.get(f"{a}.sketch", i).bitwiseXOR(F.get(f"{b}.sketch", i))) for i in range(SKETCH)), F.lit(0))
    return (low * SIMILAR[1] >= high * SIMILAR[0]) & (differ * sum(SIMILAR) <= (low + high) * (SIMILAR[1] - SIMILAR[0]))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _few(df: DataFrame, label: str) -> DataFrame:
    """df written once, and broadcast if it has few rows."""
    kept = stored(df, label)
    return _small(kept, kept.count())


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose shingles, the words themselves, are similar; texts: (node, text)."""

    @F.arrow_udf(T.BooleanType())
    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, left = [], None, set()
        for x, y in zip(a, b, strict=True):
            x = x.as_py()
            if x != last:
                last, left = x, shingles(x)
            out.append(similar(left, shingles(y.as_py())))
        return pa.array(out, pa.bool_())

    wanted = _few(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-wanted")
    some = texts.join(wanted, "node", "left_semi")
    both = pairs.join(some.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(some.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    with arrow_batches(pairs.sparkSession):
        return stored(both.where(same("a", "b")).select("u", "v"), "near-links")


def similar_groups(rows: DataFrame) -> DataFrame:
    """rows: (node, text, _s), node a number of the row's own.  (digest, label): label is one number for each group of near copies.

    Exact copies, by their sets of shingles, are one node.  Each node is first compared with the representative of those whose
    SimHash fingerprints links() joins up with its own.  Members of a band are then compared with one of them, drawn anew
    for each band and round, while members of different groups still make more pairs than there are members; then all pairs
    of a band that are not yet in one group are.  So a group of near copies of any size costs rows in proportion to its
    members, and no pair that meets is left out.  What has few rows, once they are counted, is joined by broadcast.
    """
    each = rows.groupBy(F.col("_s.node").alias("digest")).agg(F.min(F.struct("node", "_s.size", "_s.bands", "_s.sketch", "_s.fp")).alias("s"))
    nodes = stored(each.select("digest", "s.*"), "near-nodes")
    texts, facts = rows.select("node", "text"), nodes.select("node", "size", "sketch")
    placed = nodes.select("node", F.explode("bands").alias("key"))
    met = _few(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-keys")
    shared = stored(placed.join(met, "key", "left_semi"), "near-bands")
    n_shared = shared.count()
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    def possible(pairs: DataFrame, most: int) -> DataFrame:
        """most: what the number of pairs cannot pass."""
        a, b = (facts.select(F.col("node").alias(n), F.struct("size", "sketch").alias(s)) for n, s in (("u", "a"), ("v", "b")))
        kept = _small(a.join(_small(pairs.distinct(), most), "u"), most).join(b, "v")
        return stored(kept.where(_may_be_similar("a", "b")).select("u", "v"), "near-pairs")

    close = _by_fingerprint(nodes)
    compared = possible(close.select(*pair(F.col("node"), F.col("first"))), close.count())
    found = _verified(compared, texts)
    n_found, labels, before = found.count(), None, None
    if n_found:
        labels = components(found)
    of, open_pairs = _mixed_bands(shared, labels, n_found)
    for turn in range(ROUNDS):
        hubs = of.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64(F.lit(turn), "key", "node")).alias("h"))
        pairs = of.join(_small(hubs, n_shared), "key").where("label <> h.label").select(*pair(F.col("node"), F.col("h.node")))
        tried = possible(pairs, n_shared)
        compared = compared.union(tried)
        links_ = _verified(tried, texts)
        n_links = links_.count()
        n_found, found = n_found + n_links, found.union(links_)
        if n_links:
            labels = components(found)
        of, open_pairs = _mixed_bands(shared, labels, n_found)
        if not n_links or open_pairs <= PAIRS * n_shared or (before is not None and open_pairs > LEFT * before):
            break
        before = open_pairs
    if open_pairs:
        of = stored(of.join(nodes, "node").select("key", "label", F.struct("node", "size", "sketch", "bands").alias("a")), "near-mixed")
        other = of.select("key", F.col("label").alias("label_b"), F.col("a").alias("b"))
        at = F.array_position("a.bands", F.col("key"))
        first_met = ~F.exists(F.slice(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), F.lit(1), (at - 1).cast("int")), lambda same: same)
        rest = of.join(other, "key").where((F.col("label") < F.col("label_b")) & _may_be_similar("a", "b") & first_met).select(*pair(F.col("a.node"), F.col("b.node")))
        rest = stored(rest.join(compared, ["u", "v"], "left_anti"), "near-pairs")
        if n_rest := rest.count():
            labels, n_found = components(found.union(_verified(rest, texts))), n_found + n_rest
    if labels is None:
        return nodes.select("digest", F.col("node").alias("label"))
    return nodes.select("digest", "node").join(_small(labels, 2 * n_found), "node", "left").select("digest", F.coalesce("label", "node").alias("label"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(node, first): the nodes that are not the first of those whose fingerprints are within DISTANCE bits, or are linked up by such."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "near-fps")
    labels = stored(components(links(fps.select("fp", "node"))), "near-close")
    of = fps.join(_small(labels, labels.count()), "node", "left").select("fp", F.coalesce("label", "node").alias("first"), ((F.col("n") > 1) | F.col("label").isNotNull()).alias("met"))
    return stored(nodes.select("fp", "node").join(_few(of.where("met").select("fp", "first"), "near-met"), "fp").where("node <> first").select("node", "first"), "near-firsts")


def _mixed_bands(shared: DataFrame, labels: DataFrame | None, n_links: int) -> tuple[DataFrame, int]:
    """(key, node, label) of the bands whose members are not all in one group, and how many pairs of different groups they have."""
    of = shared.withColumn("label", F.col("node"))
    if labels is not None:
        named = labels.withColumnsRenamed({"node": "n1", "label": "l1"})
        of = shared.join(_small(named, 2 * n_links), F.col("node") == F.col("n1"), "left").select("key", "node", F.coalesce("l1", "node").alias("label"))
    of = stored(of, "near-labelled")
    sizes = of.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    mixed = stored(sizes.select("key", ((F.col("n") * F.col("n") - F.col("own")) / 2).cast("long").alias("open")).where("open > 0"), "near-keys")
    n, open_pairs = mixed.agg(F.count("*"), F.coalesce(F.sum("open"), F.lit(0))).first()
    return of.join(_small(mixed.select("key"), n), "key", "left_semi"), open_pairs


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that with the smallest doc_id; any row counts, whatever its doc_id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what these link up;
    op8's rule (three words, 3 bits) binds that query alone.  A null doc_id comes after all others; among equal doc_ids one row
    stays for each group.  Texts without words are copies of each other.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_n"))
    with arrow_batches(spark):
        rows = stored(with_signature(row, "_row.text"), "near-rows")
    labels = similar_groups(rows.select(F.col("_n").alias("node"), F.col("_row.text").alias("text"), "_s"))
    of = rows.select("_n", F.col("_s.node").alias("digest"), F.struct(F.col("_row.doc_id").isNull(), "_row.doc_id", "_n").alias("k")).join(labels, "digest")
    of = stored(of.select("_n", "label", "k"), "near-labels")
    several = stored(of.groupBy("label").agg(F.min("k").alias("least"), F.count("*").alias("n")).where("n > 1").select("label", F.col("least._n").alias("least")), "near-groups")
    if several.count() <= BROADCAST_ROWS:
        others = of.join(F.broadcast(several), "label").where("_n <> least").select("_n")
    else:  # a label may be that of a third of all rows: nothing is shuffled by it but partial sums
        firsts = of.groupBy("label").agg(F.min("k").alias("k")).select("k._n")
        others = of.select("_n").join(firsts, "_n", "left_anti")
    others = _few(others, "near-others")
    return rows.join(others, "_n", "left_anti").select("_row.*")
