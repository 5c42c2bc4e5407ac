"""Language identification by nearest centroid over TF-IDF vectors of character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, packed, release, stored, table, unpacked, without_rows

#: Buckets that n-grams of one to three characters are hashed to.
BUCKETS = 8192
#: Labelled documents per language that the centroids are clustered from, at most: the documented bound of the fit.
SAMPLE = 1200
#: Centroids per language, and rounds of clustering.
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected where its best similarity is under this share of the lowest hundredth of the sample's texts of its language,
#: of its length or of all lengths, whichever is lower.
REJECT = 0.5
#: In texts under 2**(SHORT - 1) n-grams (about 42 letters) words score like gibberish: there the share falls with the square of the length.
SHORT = 8
#: The largest inverse document frequency.
IDF_MOST = 4.0
UNKNOWN = "und"
#: Rejected documents that may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000
_PART = 1 << 18
_MIX = np.uint32(2654435761)


def _letters() -> np.ndarray:
    """1 for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


_table: list[np.ndarray] = []


def profile(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it is null or has no letter.

    Letters are lower-cased, every run of others counts as one space.  Long texts go through in parts that overlap by two
    characters, so memory stays bounded and no n-gram is lost or counted twice.
    """
    if not text:
        return None
    if not _table:
        _table.append(_letters())
    total = np.zeros(BUCKETS, np.int64)
    tail, seen = np.array([32], np.uint32), False
    for at in range(0, len(text), _PART):
        codes = np.frombuffer(text[at : at + _PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        isletter = _table[0][codes]
        seen |= bool(isletter.any())
        codes = np.where(isletter, codes, np.uint32(32))
        space = codes == 32
        before = np.concatenate(([tail[-1] == 32], space[:-1]))
        codes = codes[~(space & before)]
        new = len(codes)
        codes = np.concatenate((tail, codes))
        lead = len(tail)
        if not new:
            continue
        one = codes * _MIX
        two = (one[:-1] ^ (codes[1:] * np.uint32(40503) + np.uint32(97))) * np.uint32(2246822519)
        three = (two[:-1] ^ (codes[2:] * np.uint32(50021) + np.uint32(193))) * np.uint32(3266489917)
        grams = np.concatenate((one[lead:], two[max(0, lead - 1) :], three[max(0, lead - 2) :]))
        total += np.bincount((grams >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
        tail = codes[-2:]
    return total if seen else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def _length_bin(counts: np.ndarray) -> int:
    """Texts of like length: powers of two of the number of n-grams."""
    return int(counts.sum()).bit_length()


def _cluster(vectors: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means, started far apart."""
    chosen = [vectors.mean(0)]
    near = vectors @ (chosen[0] / max(np.linalg.norm(chosen[0]), 1e-9))
    for _ in range(min(k, len(vectors)) - 1):
        far = vectors[int(np.argmin(near))]
        chosen.append(far)
        near = np.maximum(near, vectors @ far)
    centroids = np.stack(chosen)
    for _ in range(ROUNDS):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
        own = np.argmax(vectors @ centroids.T, axis=1)
        for j in range(len(centroids)):
            if (own == j).any():
                centroids[j] = vectors.mean(0, where=(own == j)[:, None])  # no copy of the cluster's vectors
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)


def _fitted(texts: pd.Series, idf: np.ndarray, k: int) -> tuple[np.ndarray, float, dict[int, float]]:
    """The centroids of one language's texts, the lowest hundredth of their best similarities, and that of each length.

    A text's counts go once its vector is made, so that a task holds one row of floats for each text and little else.
    """
    vectors, bins = np.empty((len(texts), BUCKETS), np.float32), []
    for text in texts:
        if (counts := profile(text)) is not None:
            vectors[len(bins)] = _vector(counts, idf)
            bins.append(_length_bin(counts))
    if not bins:
        return np.zeros((0, BUCKETS), np.float32), 0.0, {}
    vectors, lengths = vectors[: len(bins)], np.array(bins)
    found = _cluster(vectors, k)
    best = (vectors @ found.T).max(1)
    return found, float(np.quantile(best, 0.01)), {int(b): float(np.quantile(best[lengths == b], 0.01)) for b in np.unique(lengths)}


class Model:
    """idf, the centroids with their languages, and the least similarity for each language and length."""

    def __init__(self, idf, langs, centroids, floors) -> None:
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors

    def floor(self, lang: str, length: int) -> float:
        """The least similarity; a length that the language's sample does not hold takes the nearest one's, the shorter of two."""
        own = self.floors.get(lang)
        if not own:
            return 0.0
        return own[min(own, key=lambda b: (abs(b - length), b))] * 4.0 ** min(0, length - SHORT)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = profile(text)
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        near = self.centroids @ _vector(counts, self.idf)
        best = int(np.argmax(near))
        score = min(1.0, max(0.0, float(near[best])))
        return self.langs[best], score, score < self.floor(self.langs[best], _length_bin(counts))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all texts; the last bucket counts the texts."""

    def part(batches):
        release()
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if (counts := profile(text)) is not None:
                    df[:BUCKETS] += counts > 0
                    df[BUCKETS] += 1
        yield pd.DataFrame({"bucket": np.arange(BUCKETS + 1), "n": df})

    with arrow_batches(texts.sparkSession):
        found = texts.select("text").mapInPandas(part, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fits a model to (doc_id, text, lang).

    Document frequencies cover all rows.  The centroids come from at most about `sample` rows a language (rows are drawn by a
    hash of doc_id, so a run can be repeated), clustered on the executors, one language a task; only the centroids, their
    number fixed by the parameters and the languages, come to the driver.  Rows without text, letters or lang are not used.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    df, n = _document_frequencies(rows)
    # Bounded weights: an n-gram that a large corpus has once must not outweigh the rest of a short text.
    idf = np.minimum(np.log((1 + n) / (1 + df)) + 0.05, IDF_MOST)
    sizes = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    drawn = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        release()  # what tasks before this one have left in the worker
        batch = batch.sort_values("doc_id").head(2 * sample)  # a hash's chance deviation stays far below twice
        found, lowest, lows = _fitted(batch["text"], idf, centroids)
        if not len(found):
            return pd.DataFrame({"lang": [], "kind": [], "bin": [], "value": []})
        out = [{"lang": batch["lang"].iloc[0], "kind": "centroid", "bin": 0, "value": row.tolist()} for row in found]
        out += [{"lang": batch["lang"].iloc[0], "kind": "floor", "bin": b, "value": [REJECT * min(lowest, low)]} for b, low in lows.items()]
        return pd.DataFrame(out)

    got = drawn.groupBy("lang").applyInPandas(fit, "lang string, kind string, bin long, value array<float>").toPandas().sort_values(["lang", "kind", "bin"], kind="stable")
    mid = got[got["kind"] == "centroid"]
    low = got[got["kind"] == "floor"]
    floors = {lang: {int(b): float(v[0]) for b, v in zip(g["bin"], g["value"], strict=True)} for lang, g in low.groupby("lang")}
    return Model(idf, list(mid["lang"]), np.stack(mid["value"].to_list()).astype(np.float32) if len(mid) else np.zeros((0, BUCKETS), np.float32), floors)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred (und without a letter), score (cosine with the nearest centroid, 0 to 1) and rejected.

    rejected is true for texts without a letter and for those too far from every centroid for their length and the language
    predicted.  Columns of df that have one of these names are kept; the new one then gets a _ after its name.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    found = packed(df, _found=of(F.col(text)))
    return unpacked(found, df, **{c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "rejected")})


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: those without a letter, null texts too, and those like no language."""
    model = train(docs.select("doc_id", "text", "lang"))
    with arrow_batches(spark):
        out = stored(predict(docs.select("doc_id", "text"), model).where("rejected").select("doc_id", F.xxhash64("text").alias("th")).distinct(), "langid-rejected")
    return without_rows(docs, out, BROADCAST_ROWS)
