"""Supplementing a recognised text by a second recognition of the same page: pure Python, applied in Arrow batches.

Both texts are aligned; what the second has between two aligned characters is a gap.  A gap is used only where enough characters
around it are aligned without a break, and only in the shapes listed in _GAPS.  Positions are characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import CELLS, Choices

#: Character classes, and the characters that a second text may add: punctuation, quotes, marks, small kana.
KATAKANA, HIRAGANA, IDEOGRAPH = "ァ-ヺ", "ぁ-ゖ", "㐀-䶿一-鿿"
ADDED = "、。！？「」『』（）…ー\nぁ-ぉっゃ-ょゎゕゖァ-ォッャ-ョヮヵヶ"
#: The longest gap taken on trust, how far a closing quote may be, the confidence of an operation.
TRUSTED_GAP, QUOTE_AHEAD, CONFIDENCE = 12, 80, 0.8

_ONLY_ADDED = re.compile(f"[{ADDED}]*")
_LEADING = re.compile(f"[{ADDED}]*")
_TITLE = re.compile(f"^((?:(?!」」」).)*による)([{KATAKANA}](?:(?!」」」|による)[^「])*)」」」", re.DOTALL)
_DOUBLED = re.compile(f"」」(?=[{HIRAGANA}{KATAKANA}{IDEOGRAPH}])")


def _matches(a: str, b: str) -> list[tuple[int, int]]:
    """Aligned positions; where both ways are as good, a's character is passed over first."""
    if not a or not b or len(a) * len(b) > CELLS:
        return []
    choices, found, i, j = Choices(a, b, strictly=True), [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif choices.over_b(i, j):
            j += 1
        else:
            i += 1
    return found


def _runs(pairs: list[tuple[int, int]], b: str) -> tuple[list[int], list[int]]:
    """For each pair, how many unbroken pairs end and begin with it; additions in b do not break a run."""
    joined = [p[0] + 1 == q[0] and bool(_ONLY_ADDED.fullmatch(b, p[1] + 1, q[1])) for p, q in zip(pairs, pairs[1:], strict=False)]
    ends, begins = [1] * len(pairs), [1] * len(pairs)
    for k, ok in enumerate(joined):
        ends[k + 1] = ends[k] + 1 if ok else 1
    for k in range(len(joined) - 1, -1, -1):
        begins[k] = begins[k + 1] + 1 if joined[k] else 1
    return ends, begins


class _Gap:
    """What stands between two aligned characters: own in the first text, new in the second, with the texts around."""

    def __init__(self, a: str, b: str, own: tuple[int, int], new: tuple[int, int]):
        self.a, self.b, self.at, self.to, self.start, self.end = a, b, *own, *new
        self.own, self.new = a[own[0] : own[1]], b[new[0] : new[1]]
        self.lead = _LEADING.match(self.new)[0]

    @property
    def blank(self) -> bool:
        return not self.own.strip()

    def closes(self) -> bool:
        return 0 <= self.b.find("」", self.end) - self.end <= QUOTE_AHEAD

    def mixed_term(self) -> bool:
        opened = self.b.rfind("「", 0, self.start)
        term = self.b[opened + 1 : self.start] if opened >= 0 else ""
        return bool(re.search(f"[{HIRAGANA}]", term) and re.search(f"[{KATAKANA}]", term))

    def trusted(self) -> str | None:
        if max(len(self.own), len(self.new)) > TRUSTED_GAP:
            return None
        if self.own:
            return self.lead if len(self.own) <= 2 and "「" in self.lead else None
        around = self.a[self.at - 1 : self.at + 1] if self.at else ""
        if "ー" in self.new and re.fullmatch(f"[{KATAKANA}]{{2}}", around):
            return "ー"
        return "」" if self.to == len(self.a) and "」" in self.new else None


#: (the new part's pattern, a further condition, what is inserted), in order of precedence; the own part is blank in all of them.
_GAPS = [
    (re.compile("ー」.*", re.DOTALL), _Gap.mixed_term, lambda g: "」「" if g.new.startswith("ー」」「") else g.new[1:]),
    (re.compile(f"[{ADDED}]+"), None, lambda g: g.new),
    (re.compile(f"」[{KATAKANA}]"), _Gap.closes, lambda g: "」「"),
    (re.compile(f"[{ADDED}]*一"), _Gap.closes, lambda g: g.new[:-1] + "「"),
]


def _supplied(g: _Gap) -> tuple[str, bool]:
    """What a gap supplies, and whether that replaces its own part instead of coming before it."""
    if not g.new:
        return "", False
    if re.fullmatch(f"[{IDEOGRAPH}]", g.own) and re.fullmatch(f"[{KATAKANA}]ー", g.new):
        return g.new, True
    if g.blank:
        for pattern, also, out in _GAPS:
            if pattern.fullmatch(g.new) and (also is None or also(g)):
                return out(g), False
    if (text := g.trusted()) is not None:
        return text, False
    quotes = re.fullmatch("[「『（]+", g.lead) and len(g.own) == len(g.new) - len(g.lead)
    return (g.lead if quotes else ""), False


def repaired(text: str) -> str:
    """Quotes doubled by a merge made single; a katakana title after による that ends in three quotes gets its own pair."""
    return _DOUBLED.sub("」", _TITLE.sub(r"\1「\2」", text, count=1).replace("「「", "「"))


def merge(primary: str, auxiliary: str) -> str:
    """primary with what auxiliary supplies.  Over CELLS cells, or with nothing aligned, primary as it is."""
    b = re.sub("([?？。])・(?=」)", r"\1", auxiliary.replace("[", "「").replace("]", "」"))
    pairs = _matches(primary, b)
    if not pairs:
        return primary
    ends, begins = _runs(pairs, b)
    fences = [(-1, -1), *pairs, (len(primary), len(b))]
    out = []
    for k, (p, q) in enumerate(zip(fences, fences[1:], strict=False)):
        left, right = ends[k - 1] if k else 0, begins[k] if k < len(pairs) else 0
        edge, most = k in (0, len(pairs)), max(left, right)
        sure = most >= 4 or (most == len(pairs) and most >= 3) if edge else left + right >= 3
        g = _Gap(primary, b, (p[0] + 1, q[0]), (p[1] + 1, q[1]))
        text, instead = _supplied(g) if sure else ("", False)
        out += [text, "" if instead else g.own, primary[q[0] : q[0] + 1]]
    return repaired("".join(out))


def _next_match(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """The equal characters from (i, j) on with the fewest passed over in both, the earliest in a; the ends if there are none."""
    best, at = len(a) + len(b), (len(a), len(b))
    for k in range(i, len(a)):
        if k - i >= best:
            break
        m = b.find(a[k], j)
        if m >= 0 and k - i + m - j < best:
            best, at = k - i + m - j, (k, m)
    return at


def propose(primary: str, auxiliary: str, words: list[tuple[int, str]]) -> tuple[str, list[tuple]]:
    """(merged text, operations) with operations (type, position, original, proposed, anchor, confidence, reason).

    words are (ordinal, text) in reading order.  An operation's anchor is the last word that begins at or before it, else the
    first one.  If a non-blank second text differs and gives no operation, it is one insertion without anchor.
    """
    merged = merge(primary, auxiliary)
    starts, ordinals, cursor = [], [], 0
    for ordinal, text in words:
        if text and (at := primary.find(text, cursor)) >= 0:
            starts.append(at)
            ordinals.append(ordinal)
            cursor = at + len(text)
    out, i, j = [], 0, 0
    while i < len(primary) or j < len(merged):
        if primary[i : i + 1] == merged[j : j + 1]:
            i, j = i + 1, j + 1
            continue
        k, m = _next_match(primary, merged, i, j)
        old, new = primary[i:k], merged[j:m]
        anchor = ordinals[max(0, bisect_right(starts, i) - 1)] if starts else None
        kind = "Insertion" if not old else "Replacement" if new else "Deletion"
        out.append((kind, j, old, new, anchor, CONFIDENCE, "AuxiliarySupplement" if _ONLY_ADDED.fullmatch(new) else "AuxiliaryCorrection"))
        i, j = k, m
    if not out and auxiliary.strip() and auxiliary != primary:
        out.append(("Insertion", 0, "", auxiliary, None, 0.0, "UnanchoredSuggestion"))
    return merged, out


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_OPERATION = T.StructType([T.StructField(k, t) for k, t in (("type", _S), ("position", _I), ("original", _S), ("proposed", _S), ("anchor", _I), ("confidence", _D), ("reason", _S))])
_PROPOSAL = T.StructType([T.StructField("suggested", _S), T.StructField("operations", T.ArrayType(_OPERATION))])


@F.pandas_udf(_S)
def _merged(primary: pd.Series, auxiliary: pd.Series) -> pd.Series:
    return pd.Series([merge(a or "", b or "") for a, b in zip(primary, auxiliary, strict=True)])


@F.pandas_udf(_PROPOSAL)
def _proposed(primary: pd.Series, auxiliary: pd.Series, words: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, w in zip(primary, auxiliary, words, strict=True):
        text, ops = propose(a or "", b or "", [(x["ordinal"], x["text"]) for x in (w if w is not None else [])])
        rows.append((text, [dict(zip(_OPERATION.names, o, strict=True)) for o in ops]))
    return pd.DataFrame(rows, columns=_PROPOSAL.names)


def merged(primary: Column, auxiliary: Column) -> Column:
    """The first text with what the second supplies; null counts as empty."""
    return _merged(primary, auxiliary)


def proposal(primary: Column, auxiliary: Column, words: Column) -> Column:
    """struct<suggested, operations>; words is array<struct<ordinal:int, text:string>> in reading order, or null."""
    return _proposed(primary, auxiliary, words)


def unanchored(operations: Column) -> Column:
    """The operations that need a review, since no word anchors them."""
    return F.filter(operations, lambda o: o["anchor"].isNull())
