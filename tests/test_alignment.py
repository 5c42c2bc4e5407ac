"""Alignments in a bit a cell against the whole table, on all short texts of a small alphabet and on random ones."""

import itertools
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from folioforge.functions import sequence, supplement


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t


def steps_brute(a, b):
    t, i, j, out = table(a, b), 0, 0, []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("Equal", a[i]))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or t[i][j + 1] >= t[i + 1][j]):
            out.append(("Added", b[j]))
            j += 1
        else:
            out.append(("Deleted", a[i]))
            i += 1
    return out


def matches_brute(a, b):
    t, i, j, out = table(a, b), 0, 0, []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_all_short_texts():
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(texts, texts):
        assert list(sequence._steps(a, b)) == steps_brute(a, b)
        assert supplement._matches(a, b) == (matches_brute(a, b) if a and b else [])


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("ab字𠮷、") for _ in range(rng.randint(1, 130))) for _ in range(2))
    assert list(sequence._steps(a, b)) == steps_brute(a, b)
    assert supplement._matches(a, b) == matches_brute(a, b)


def test_a_tenth_of_the_memory():
    """A table of 4,000,000 cells of 32 bits took 16 MB."""
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdef") for _ in range(1999)) for _ in range(2))
    tracemalloc.start()
    sequence.Choices(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_600_000


def test_counts_of_a_whole_table(spark):
    """The diff columns of a table, row by row, against the table-based spans."""
    rng = random.Random(5)
    rows = [tuple("".join(rng.choice("abc字") for _ in range(rng.randint(0, 25))) for _ in range(2)) for _ in range(150)] + [(None, "x"), ("x", None), ("", "")]
    d = spark.createDataFrame(rows, "a string, b string").repartition(3)
    for r in d.select("a", "b", sequence.diff_counts(F.col("a"), F.col("b")).alias("n")).collect():
        runs = [(k, len(list(g))) for k, g in itertools.groupby(kind for kind, _ in steps_brute(r.a or "", r.b or ""))]
        n, k = {"Added": 0, "Deleted": 0, "Changed": 0, "Equal": 0}, 0
        while k < len(runs):
            if {x for x, _ in runs[k : k + 2]} == {"Added", "Deleted"}:
                n["Changed"] += max(runs[k][1], runs[k + 1][1])
                k += 2
            else:
                n[runs[k][0]] += runs[k][1]
                k += 1
        assert (r.n.added, r.n.deleted, r.n.replaced, r.n.changed) == (n["Added"], n["Deleted"], n["Changed"], n["Added"] + n["Deleted"] + n["Changed"])
