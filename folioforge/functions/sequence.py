"""Sequence functions that need recurrences or Unicode normalisation: pure Python, applied in Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Table cells up to which two texts are aligned in full.
CELLS = 4_000_000


class Choices:
    """Which way an alignment of two texts goes on from each pair of positions, one bit for each.

    With t(i, j) the length of the longest common subsequence of a[i:] and b[j:], the bit says that passing over b[j] leaves no
    less to find than passing over a[i]: t(i, j + 1) >= t(i + 1, j); strictly: that it leaves more.  Rows of t are made from
    the last, each a running maximum and so one vector operation, and none but the one below is kept.
    """

    def __init__(self, a: str, b: str, strictly: bool = False) -> None:
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        self._bits = np.zeros((len(x), -(-len(y) // 8)), np.uint8)
        below, here = np.zeros(len(y) + 1, np.int32), np.zeros(len(y) + 1, np.int32)
        for i in range(len(x) - 1, -1, -1):
            here[:-1] = np.maximum.accumulate(np.where(x[i] == y, below[1:] + 1, below[:-1])[::-1])[::-1]
            self._bits[i] = np.packbits(here[1:] > below[:-1] if strictly else here[1:] >= below[:-1])
            below, here = here, below

    def over_b(self, i: int, j: int) -> bool:
        return bool(self._bits[i, j >> 3] >> (7 - (j & 7)) & 1)


def _steps(before: str, after: str):
    """(kind, char) of an aligned pair of texts; where both ways are as good, an addition comes first."""
    choices, i, j = Choices(before, after), 0, 0
    while i < len(before) or j < len(after):
        if i < len(before) and j < len(after) and before[i] == after[j]:
            yield "Equal", before[i]
            i, j = i + 1, j + 1
        elif j < len(after) and (i == len(before) or choices.over_b(i, j)):
            yield "Added", after[j]
            j += 1
        else:
            yield "Deleted", before[i]
            i += 1


def _ends(before: str, after: str) -> list[tuple[str, str, str]]:
    """The common start, what differs, and the common end."""
    most = min(len(before), len(after))
    head = next((i for i in range(most) if before[i] != after[i]), most)
    tail = next((i for i in range(most - head) if before[-1 - i] != after[-1 - i]), most - head)
    a, b = before[head : len(before) - tail], after[head : len(after) - tail]
    kind = "Changed" if a and b else "Added" if b else "Deleted"
    rows = [("Equal", before[:head], after[:head]), (kind, a, b), ("Equal", before[len(before) - tail :], after[len(after) - tail :])]
    return [r for r in rows if r[1] or r[2]]


def _units(text: str) -> str:
    """A text with a character for each UTF-16 unit: the halves of those beyond the basic plane stand alone."""
    if not text or max(text) <= "\uffff":
        return text
    return "".join(map(chr, np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()))


def _whole(units: str) -> str:
    """The text of UTF-16 units; a half without its other stays one."""
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def diff(before: str, after: str) -> list[tuple[str, str, str]]:
    """Spans (kind, before, after): Equal, Added, Deleted, and Changed where an addition and a deletion meet.

    Long pairs of texts, over CELLS cells, are compared at their common ends only.  UTF-16 units are compared, so that a span
    may hold half a character.
    """
    return [(kind, _whole(a), _whole(b)) for kind, a, b in _spans(_units(before), _units(after))]


def _spans(before: str, after: str) -> list[tuple[str, str, str]]:
    """diff() of units."""
    if (len(before) + 1) * (len(after) + 1) > CELLS:
        return _ends(before, after)
    runs: list[list[str]] = []
    for kind, c in _steps(before, after):
        if runs and runs[-1][0] == kind:
            runs[-1][1] += c
        else:
            runs.append([kind, c])
    out, k = [], 0
    while k < len(runs):
        kinds = {r[0] for r in runs[k : k + 2]}
        if kinds == {"Added", "Deleted"}:
            pair = dict(map(tuple, runs[k : k + 2]))
            out.append(("Changed", pair["Deleted"], pair["Added"]))
            k += 2
            continue
        kind, t = runs[k]
        out.append((kind, t if kind != "Added" else "", t if kind != "Deleted" else ""))
        k += 1
    return out


_COUNTS = T.StructType([T.StructField(k, T.LongType()) for k in ("added", "deleted", "replaced", "changed")])


@F.pandas_udf(_COUNTS)
def _diff_counts(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(before, after, strict=True):
        n = {"Added": 0, "Deleted": 0, "Changed": 0, "Equal": 0}
        for kind, x, y in _spans(_units(a or ""), _units(b or "")):
            n[kind] += max(len(x), len(y))
        rows.append((n["Added"], n["Deleted"], n["Changed"], n["Added"] + n["Deleted"] + n["Changed"]))
    return pd.DataFrame(rows, columns=_COUNTS.names)


def diff_counts(before: Column, after: Column) -> Column:
    """struct<added, deleted, replaced, changed> of two texts, in UTF-16 units; null counts as empty."""
    return _diff_counts(before, after)


def normalised_reading(text: str) -> str:
    """A reading as hiragana: compatibility forms folded, white space dropped, katakana shifted."""
    folded = "".join(c for c in unicodedata.normalize("NFKC", text) if not c.isspace())
    return unicodedata.normalize("NFC", "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in folded))


@F.pandas_udf(T.StringType())
def _reading(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalised_reading(t))


def reading_key(c: Column) -> Column:
    return _reading(c)
