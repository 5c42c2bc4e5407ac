"""Secrets: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, stored, table, unpacked
from .spans import digest, kind_spans, matches, written

# The patterns of the base kinds, in their order.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
#: A run is looked at from its start only; shorter runs are no matches anyway.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_LEAST = 6
#: What the models score: runs of so many characters that can stand in a key, with a letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: A candidate is a secret if its log-likelihood ratio is so much in all and so much for each pair of characters, in nats.
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.7
#: Labelled documents that the models are counted from, at most about so many: the documented bound of the fit.
SAMPLE = 20_000
#: Generated random strings, so that the random model knows more alphabets than the documents' own secrets have.
GENERATED = 4000
#: The weight, in counts, of a character's own frequency where its pairs are rare.
BACKOFF = 4.0
_SIZE = len(ALPHABET) + 1


def _codes(token: Column) -> Column:
    """Positions of the characters in ALPHABET, 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame) -> list[float]:
    """samples: (token, label), label 1 for random strings and 0 for ordinary ones.  The log ratio for each pair of characters.

    Pairs are counted with partial aggregation; only the alphabet's squared number of counts comes to the driver.  Each
    model falls back on its single characters, and these on an even share, so no samples at all give a ratio of zero everywhere.  Null tokens or labels are not used.
    """
    codes = samples.where("token is not null and label is not null").select("label", _codes(F.col("token")).alias("c"))
    pairs = codes.where(F.size("c") > 1).select("label", F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> c[i] * %d + c[i + 1])" % _SIZE)).alias("pair"))
    counts = {(r.label, r.pair): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}
    each = [[[counts.get((label, a * _SIZE + b), 0) for b in range(_SIZE)] for a in range(_SIZE)] for label in (0, 1)]
    single = [[sum(row[b] for row in pairs_) for b in range(_SIZE)] for pairs_ in each]
    overall = [[(n + 1) / (sum(s) + _SIZE) for n in s] for s in single]
    p = lambda label, a, b: (each[label][a][b] + BACKOFF * overall[label][b]) / (sum(each[label][a]) + BACKOFF)
    return [round(math.log(p(1, a, b) / p(0, a, b)), 6) for a in range(_SIZE) for b in range(_SIZE)]


def _ratio(token: Column, model: list[float]) -> Column:
    """The token's log-likelihood ratio: the sum over its pairs of characters."""
    llr = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded to one literal
    return let(_codes(token), lambda c: F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(llr, F.get(c, i) * _SIZE + F.get(c, i + 1)), F.lit(0.0))))


def _is_random(token: Column, model: list[float]) -> Column:
    return let(_ratio(token, model), lambda r: (r >= LEAST_TOTAL) & (r >= LEAST_MEAN * (F.length(token) - 1)))


def base(text: Column) -> dict[str, Column]:
    """The base spans of each kind."""
    return {"assign": F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["part"]) >= ASSIGN_LEAST), "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def samples(df: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(token, label) from (doc_id, text): what the base patterns find is random, with GENERATED strings, the other words are ordinary.

    At most about `bound` documents are drawn, by a hash of doc_id.
    """
    total = max(1, df.count())
    drawn = df.where(F.pmod(F.xxhash64(F.lit("secrets"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, bound / total) * (1 << 20))).select(F.coalesce("text", F.lit("")).alias("text"))
    found = base(F.col("text"))
    hits = F.concat(F.transform(found["assign"], lambda s: s["part"]), F.transform(found["access"], lambda s: s["value"]), F.transform(found["hex"], lambda s: s["value"]))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"), F.lit(0))
    random = drawn.select(F.explode(hits).alias("token")).where(F.length("token") >= 12).distinct().select("token", F.lit(1).alias("label"))
    ordinary = drawn.select(F.explode(words).alias("token")).distinct().select("token", F.lit(0).alias("label"))
    return random.union(ordinary).union(generated(df.sparkSession))


def generated(spark, n: int = GENERATED) -> DataFrame:
    """(token, 1): n random strings in the usual alphabets, from digests of the numbers up to n."""
    raw = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    wide = F.rtrim(F.translate(F.base64(F.unhex(raw)), "=", " "))
    kinds = F.array(F.substring(raw, 1, 40), wide, F.translate(wide, "+/", "-_"), F.translate(wide, "+/", ""))
    return spark.range(n).select(F.get(kinds, (F.col("id") % 4).cast("int")).alias("token"), F.lit(1).alias("label"))


def find(df: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """df with n_assign, n_access, n_hex, base (array of start, kind, end by start, then kind) and found (base and added spans).

    Null and empty texts have none.  The base spans always stay; a candidate that the models take for random is added as
    kind markov unless it overlaps one of them.  Repeated rows have the same spans, an empty df gives no rows.  Columns of df
    that have one of these names are kept; the new one then gets a _ after its name.  Only built-in functions, one pass, no
    shuffle.
    """
    c = F.col("_text")
    kinds = base(c)
    # What one row finds is held in one struct, behind a generator: a projection above could otherwise run the patterns again.
    first = F.struct(*(kind_spans(kinds[k], i).alias(k) for i, k in enumerate(KINDS[:3])), F.filter(matches(c, CANDIDATE), lambda s: s["value"].rlike("[A-Za-z]")).alias("candidates"))
    one = packed(df, _text=F.coalesce(F.col(text), F.lit(""))).withColumn("_s", F.explode(F.array(first)))
    spans = F.array_sort(F.concat("_s.assign", "_s.access", "_s.hex"))
    two = one.withColumn("_b", F.explode(F.array(spans)))
    loose = F.filter("_s.candidates", lambda s: ~F.exists("_b", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    secret = F.filter(loose, lambda s: _is_random(s["value"], model))
    counts = {f"n_{k}": F.size(f"_s.{k}").cast("long") for k in KINDS[:3]}
    return unpacked(two, df, **counts, base=F.col("_b"), found=F.array_sort(F.concat("_b", kind_spans(secret, 3))))


def fit(labelled: DataFrame) -> list[float]:
    """A model from samples() in two steps: secrets that no base pattern knows are among the ordinary samples, so a first model
    names those that look random rather than ordinary, and the second is counted without them."""
    labelled = stored(labelled, "secret-samples")
    first = train(labelled)
    return train(labelled.where((F.col("label") == 1) | (_ratio(F.col("token"), first) <= 0)))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of every whole text; a null text is empty, rows that repeat or lack a doc_id are rows like any other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest(written(F.col("base"), KINDS)).alias("base_sha256"), written(F.col("found"), KINDS).alias("spans"))
