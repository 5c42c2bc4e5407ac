"""Source divergence, fill-in-middle and language-model scores against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import divergence, infilling, interpolation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], SCHEMA)


def audit_brute(rows, top):
    """The audit with plain loops and whole numbers of any size."""
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {f[0] for f in found}:
        own = [f for f in found if f[0] == lang]
        kept = [w for w, n in collections.Counter(w for f in own for w in set(f[2])).items() if n >= 3]
        counts = {s: collections.Counter(w for f in own if f[1] == s for w in f[2]) for s in {f[1] for f in own}}
        every = sum(counts.values(), collections.Counter())
        share = lambda c, n: 1 + 1000000000 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        shares = {s: {w: share(c[w], sum(c[x] for x in kept)) for w in kept} for s, c in counts.items()}
        whole = {w: share(every[w], sum(every[x] for x in kept)) for w in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for s in counts:
            pairs = [(-sum(far(shares[s][w], shares[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            terms = [(-far(shares[s][w], whole[w]), w.encode()) for w in kept if counts[s][w] and shares[s][w] > whole[w]]
            out |= {(lang, s, part, item.decode(), -v, k) for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, item) in enumerate(ranked, 1)}
    return out


def audit_rows():
    rng, rows = random.Random(3), []
    vocabulary = ["".join(rng.choice("abcdeéß漢ABC") for _ in range(rng.randint(1, 4))) for _ in range(90)]
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None, "big", "big", "big"])
        rows.append((i, " ".join(rng.choice(vocabulary[: rng.choice([5, 90])]) + rng.choice(["", ".", "1", "\n"]) for _ in range(rng.randint(0, 60))), lang, source))
    rows += [(200, None, "en", "silent"), (201, "", "xx", "a"), (202, "few words", "xx", "b"), (203, "few words", "yy", "only"), (None, "a b c", "en", "s1"), (5, "a a a", "en", "s1"), (5, "a a a", "en", "s1")]
    return rows


@pytest.mark.parametrize(("terms", "groups", "top"), [(divergence.TERMS, divergence.GROUPS, 200), (7, 2, 3)])
def test_divergence(spark, terms, groups, top):
    rows = audit_rows()
    d = docs(spark, rows).withColumns({"term": F.lit("clash"), "rank": F.lit(1)})
    got = [tuple(r) for r in divergence.audit(d, terms=terms, groups=groups, top=top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == audit_brute(rows, top)
    assert ("xx", "a", "pair", "b", 0, 1) in got


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs(spark, audit_rows()).limit(0)).count() == 0


def test_shares_of_large_counts():
    counts, total = np.array([[0, 1, 10**15, 7 * 10**14]]), np.array([[3 * 10**15]])
    assert divergence.smoothed(counts, total).tolist() == [[1 + 10**9 * (int(c) + 1) // (3 * 10**15) for c in counts[0]]]
    with pytest.raises(OverflowError):
        divergence.smoothed(counts, np.array([[1 << 53]]))


def test_a_task_hands_on_counts_when_it_holds_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "a", "b"], "text": ["x y x", "x", "X"]})
    got = [tuple(r.values()) for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [("en", "a", "x", 1, 1), ("en", "a", "x", 2, 1), ("en", "a", "y", 1, 1), ("en", "b", "x", 1, 1)]


def middle_brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def middle_rows():
    rng = random.Random(4)
    texts = [None, "", "x", "é", "漢字𠮷" * 50, "a <S> b", "<P", "S><M", "<<P>>", "\n\t ", "𠮷" * 9000, "plain text " * 400]
    texts += ["".join(rng.choice("ab <>PSMé漢𠮷") for _ in range(rng.randint(1, 300))) for _ in range(120)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [(1000 + i, texts[11], "en", "s") for i in range(80)] + [(None, "no id at all", "en", "s"), (7, "again 7", "en", "s"), (7, "again 7", "en", "s")]


@pytest.mark.parametrize("bits", [64, 3])
def test_infilling(spark, bits, monkeypatch):
    """With keys of three bits most texts share a key with texts unlike them; with no broadcasts the keys are joined by a shuffle."""
    if bits < 64:
        monkeypatch.setattr(infilling, "BROADCAST_ROWS", 0)
    rows = middle_rows()
    d = docs(spark, rows).withColumns({"form": F.lit("clash"), "key": F.lit(1), "_row": F.lit(2)})
    found = infilling.fill_in_middle(d, bits=bits)
    assert found.columns == [*d.columns, "n", "form_", "prefix_chars", "middle_chars", "output"]
    found = found.withColumn("back", infilling.restored(F.col("output"), F.col("form_")))
    got = sorted(((r.doc_id, r.text, r.n, r.form_, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str)
    assert got == sorted(((i, t, *middle_brute(i, t)) for i, t, _, _ in rows), key=str)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}
    assert found.where(F.col("back") != F.coalesce("text", F.lit(""))).count() == 0


def test_infilling_of_nothing(spark):
    assert infilling.fill_in_middle(docs(spark, middle_rows()).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "漢", "é" * 5000 + "𠮷a" * 9000, "ascii only " * 2000, "漢" * 400_000 + "b" * 900_000])
def test_boundaries(text):
    edges = infilling.boundaries(text.encode())
    assert edges["size"] == len(text) + 1
    rng = random.Random(1)
    for i in {0, len(text), len(text) // 2, *(rng.randint(0, len(text)) for _ in range(60))}:
        assert infilling.select(edges, i) == len(text[:i].encode())
    with pytest.raises(IndexError):
        infilling.select(edges, len(text) + 1)
    assert len(edges["high"]) + len(edges["low"]) <= len(text.encode()) // 2 + 2


def scoring_rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(70)]
    texts = [None, "", " \t\n", "x", "ONE word", "one WORD"]
    for _ in range(260):
        at, out = rng.randrange(len(words)), []
        for _ in range(rng.randint(1, 60)):
            at = (at * 7 + 3) % len(words) if rng.random() < 0.7 else rng.randrange(len(words))
            out.append(words[at] + (rng.choice("!?") if rng.random() < 0.1 else "") + (str(rng.randrange(10**6)) if rng.random() < 0.05 else ""))
        texts.append(rng.choice([" ", "\n", " \x0b "]).join(out))
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id at all", "en", "s"), (3, "x y z", "en", "s")]


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def scoring_brute(rows):
    """Counts with plain dictionaries, weights by expectation-maximisation on every held-out token, and the scores."""
    part = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 10
    seen = [(i, part(i), tokens_of(t)) for i, t, _, _ in rows]
    pairs = lambda ts: list(zip(["<", *ts[:-1]], ts, strict=True))

    def counts(kinds):
        ones = collections.Counter(w for _, k, ts in seen if kinds(k) for w in ts)
        return ones, collections.Counter(p for _, k, ts in seen if kinds(k) for p in pairs(ts))

    ones, twos = counts(lambda k: k != 0)
    v, n = len(ones), sum(ones.values())

    def estimates(ones, twos, p):
        before = ones[None] if p[0] == "<" else ones[p[0]]
        return before.bit_length(), twos[p] / before if before else 0.0, ones[p[1]] / max(1, sum(ones.values())), 1 / (v + 1)

    kept = counts(lambda k: k not in (0, 1))
    held = [estimates(*kept, p) for _, k, ts in seen if k == 1 for p in pairs(ts)]
    weights = {}
    for b in {h[0] for h in held}:
        own, w = [h[1:] for h in held if h[0] == b], (1 / 3, 1 / 3, 1 / 3) if b else (0, 0.5, 0.5)
        prior = w
        for _ in range(300):
            share = [[x * y / sum(map(lambda a, c: a * c, w, f)) for x, y in zip(w, f, strict=True)] for f in own]
            w = tuple((sum(s[j] for s in share) + prior[j]) / (len(own) + 1) for j in range(3))
        weights[b] = w
    weight = lambda b: weights[b] if b in weights else weights[min((k for k in weights if k), key=lambda k: (abs(k - b), k))] if b else (0, 0.5, 0.5)
    out = []
    for i, k, ts in seen:
        score = 0.0
        for p in pairs(ts):
            b, *f = estimates(ones, twos, p)
            score += math.log10(sum(x * y for x, y in zip(weight(b), f, strict=True)))
        out.append((i, k == 0, len(ts), sum(ones[w] > 0 for w in ts), n, sum(math.log10((ones[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), score))
    return out


@pytest.mark.parametrize("chunk", [interpolation.CHUNK, 300])
def test_scores(spark, chunk):
    rows = scoring_rows()
    d = docs(spark, rows).withColumns({"kind": F.lit("clash"), "chunk": F.lit(1)}).repartition(3)
    got = sorted((tuple(r) for r in interpolation.score(d, chunk=chunk).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(scoring_brute(rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3)  # cells of held-out counts stand for their means
    assert sum(g[6] for g in got if g[1]) > 0.8 * sum(g[5] for g in got if g[1])


def test_probabilities_add_up(spark):
    """After any context, met or not, the model's words and one unknown word share a probability of 1."""
    model = interpolation.fit(docs(spark, scoring_rows()))
    assert model.weights.sum(axis=1) == pytest.approx(np.ones(interpolation.BUCKETS))
    assert (model.weights[:, 1:] > 0).all()
    assert model.weights[0, 0] == 0


def test_scores_of_little(spark):
    d = docs(spark, scoring_rows())
    assert interpolation.score(d.limit(0)).count() == 0
    never = d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    rows = interpolation.score(never).collect()
    assert rows and all((r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 0, 0, 0.0, 0.0) for r in rows)
    few = interpolation.score(docs(spark, [(0, "a b", "en", "s"), (0, "a c", "en", "s")])).collect()  # nothing is held out to set the weights
    assert all(r.score < 0 for r in few)


def test_packed_keys():
    rng = np.random.default_rng(2)
    for keys in ([], [5], [0, 1, 2], [0, 2**64 - 1], np.unique(rng.integers(0, 1 << 64, 5000, np.uint64))):
        keys = np.array(keys, np.uint64)
        assert (interpolation._unpacked(interpolation._packed(keys)) == keys).all()
    for numbers in ([], [0, 255], [256], [2**40]):
        assert interpolation._large(interpolation._small(np.array(numbers, np.int64))).tolist() == numbers


def test_words_of_long_texts_are_not_cut():
    text = ("Ab cd\t" * 400_000 + "x").encode()
    got = interpolation.hashes(text)
    assert len(got) == 800_002 and len(np.unique(got)) == 4


def test_scores_beyond_64_bits_are_an_error(spark):
    from folioforge.llm import topk

    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, (rng.normal(size=64) * 1e8).tolist()) for i in range(100)], "vec_id long, embedding array<double>")
    for scale in (1.0, 1e12):
        big = d.withColumn("embedding", F.transform("embedding", lambda x: x * scale))  # noqa: B023
        with pytest.raises(OverflowError):
            topk.search(big, F.col("vec_id") % 20 == 0)


def test_queries_in_passes(spark, monkeypatch):
    from folioforge.llm import topk

    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    one = {tuple(r) for r in topk.search(d, F.col("vec_id") % 20 == 0).collect()}
    monkeypatch.setattr(topk, "QUERY_VALUES", 15)
    assert {tuple(r) for r in topk.search(d, F.col("vec_id") % 20 == 0).collect()} == one
    assert len(one) == 200


def crowded_texts():
    """A template that many pages share: members of its bands, somewhat alike, of which only some are linked."""
    rng = random.Random(6)
    base, texts = [f"t{k}" for k in range(60)], []
    for _ in range(70):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, 4)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("rounds", "pairs"), [(1, 1), (8, 0), (8, 1)])
def test_rounds_of_hubs_lose_no_link(spark, monkeypatch, rounds, pairs):
    from folioforge.llm import simhash

    from .test_ops import near_brute

    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    texts = crowded_texts()
    got = sorted(r.doc_id for r in simhash.stage(spark, docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), "").collect())
    assert got == near_brute(texts)
    assert 1 < len(got) < len(texts)


def test_a_block_that_most_fingerprints_share(spark):
    """Three hundred fingerprints that share most blocks, pairwise too far apart but for planted neighbours."""
    from folioforge.llm import simhash

    from .test_ops import components

    rng = random.Random(2)
    fps = {i: rng.getrandbits(31) for i in range(300)}
    fps |= {300 + i: fps[i] ^ sum(1 << b for b in rng.sample(range(64), 3)) for i in range(40)}
    d = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in fps.items()], "fp long, node long")
    from folioforge.llm.components import components as connected

    label = {r.node: r.label for r in connected(simhash.links(d, bucket=64)).collect()}
    want = components(fps)
    assert {i: label.get(i, i) for i in fps} == want


def test_counts_of_a_range_hold_little():
    """Adding up a range takes under 48 bytes for each n-gram that its chunks name, and gives what plain counters give."""
    gen, rows, plain = np.random.default_rng(3), [], {}
    for chunk in range(12):
        keys, kind = np.unique(gen.integers(0, 1 << 22, 40_000, np.uint64)), (interpolation.KEPT, interpolation.HELD, interpolation.TEST)[chunk % 3]
        n = gen.integers(1, 300, len(keys))
        rows.append((chunk, kind, interpolation._packed(keys), interpolation._small(n), keys))
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            was = plain.setdefault(k, [0, 0])
            was[0] += c * (kind == interpolation.KEPT)
            was[1] += c * (kind != interpolation.TEST)
    asked = pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "keys": pa.array([r[2] for r in rows], pa.binary()), "n": pa.array([r[3] for r in rows], pa.binary())})
    tracemalloc.start()
    told = interpolation._told((pa.scalar(5), pa.scalar(2)), asked).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for row, (chunk, kind, _, _, keys) in zip(told, rows, strict=False):
        assert (row["chunk"], row["kind"], row["grams"], row["part"]) == (chunk, kind, 2, 5)
        assert interpolation._large(row["every"]).tolist() == [plain[k][1] for k in keys.tolist()]
        assert kind != interpolation.HELD or interpolation._large(row["kept"]).tolist() == [plain[k][0] for k in keys.tolist()]
    assert (told[-1]["n_types"], told[-1]["n_tokens"]) == (sum(v[1] > 0 for v in plain.values()), sum(v[1] for v in plain.values()))
    assert peak < 48 * sum(len(r[4]) for r in rows), peak / sum(len(r[4]) for r in rows)
