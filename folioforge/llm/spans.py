"""Spans of regular expressions as columns: only built-in functions, offsets in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, sha256_hex

#: Prefix sums widen their reach so many times, each time by so much: up to 8**11 elements, more than an array can have (2**31).
#: Levels beyond an array's size leave it alone; few levels keep plans small.
_LEVELS, _WIDER = 11, 8


def _reach(reach: int):
    terms = lambda a, x, i: sum((F.coalesce(F.get(a, i - j * reach), F.lit(0)) for j in range(1, _WIDER)), x)
    return lambda a: F.when(F.size(a) > reach, F.transform(a, lambda x, i: terms(a, x, i))).otherwise(a)


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of numbers, in n log n steps."""
    for k in range(_LEVELS):
        values = let(values, _reach(_WIDER**k))
    return values


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """All leftmost non-overlapping matches: array<struct<start, end, value[, part]>>, end exclusive; part is a group's text.

    The pieces between matches come from split(), the matches from regexp_extract_all(); their lengths give the offsets.
    """

    def placed(hits: Column, parts: Column | None) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        rows = let(
            prefix_sums(lengths),
            lambda ends: F.transform(hits, lambda h, i: F.struct((F.get(ends, i) - F.length(h)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end"), h.alias("value"), *([F.get(parts, i).alias("part")] if parts is not None else []))),
        )
        return F.when(F.size(hits) > 0, rows).otherwise(F.array().cast("array<struct<start:int,end:int,value:string" + (",part:string" if parts is not None else "") + ">>"))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group is None:
        return let(whole, lambda hits: placed(hits, None))
    return let(whole, lambda hits: let(F.when(F.size(hits) > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))), lambda parts: placed(hits, parts)))


def kind_spans(spans: Column, kind: int) -> Column:
    """(start, kind, end) of each span, to be sorted by start and then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined in the order given."""
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest(joined: Column) -> Column:
    return sha256_hex(joined)
