"""The marker format of page texts: rendering as expressions, parsing as a small state machine in Arrow batches.

A file has headers [[FORMAT:n]], whose name may have a prefix of capitals and an underscore, [[PROJECT_ID:uuid]] and [[BATCH_ID:uuid]].  Format 2 has, for each page, [[PAGE:0001]], its text
between [[TEXT_BEGIN]] and [[TEXT_END]], then [[JOIN_TO_NEXT:rule]]; and one report between [[REPORT_BEGIN]] and [[REPORT_END]].
Format 1 has a page's lines up to the next page.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import marker

JOINS = ("DirectJoin", "SpaceJoin", "ParagraphBreak", "SceneBreak", "Uncertain")
_KINDS = {
    "page": re.compile(r"\[\[PAGE:(\d{4})\]\]"), "join": re.compile(r"\[\[JOIN_TO_NEXT:([A-Za-z]+)\]\]"), "header": re.compile(r"\[\[(?:(?:[A-Z]+_)?FORMAT|PROJECT_ID|BATCH_ID):(.*)"),
    "mark": re.compile(r"\[\[((?:TEXT|REPORT)_(?:BEGIN|END))\]\]"), "note": re.compile(r"\[\[(?:SOURCE_FILE|PAGE_ROLE|DISPLAY_PROFILE):(.*)"),
}


class FormatError(ValueError):
    pass


def _line(line: str) -> tuple[str, str]:
    """The kind of a line and what it names."""
    bare = line.strip()
    for kind, pattern in _KINDS.items():
        if found := pattern.fullmatch(bare):
            return (found[1] if kind == "mark" else kind), found[1]
    return ("text" if bare else "blank"), bare


def _header(lines: list[str], name: str) -> str | None:
    """The value of the one header whose name the pattern fits."""
    pattern = re.compile(rf"\[\[(?:{name}):(.*)\]\]")
    values = [found[1] for x in lines if (found := pattern.fullmatch(x.strip()))]
    if len(values) > 1:
        raise FormatError(f"more than one {name}")
    return values[0] if values else None


def _lines(content: str) -> list[str]:
    """Lines without blank edges and without a code fence around all."""
    lines = re.sub("\r\n?", "\n", content).strip("\n \t　").split("\n") if content.strip() else []
    return lines[1:-1] if len(lines) > 1 and lines[0].lstrip().startswith("```") and lines[-1].strip() == "```" else lines


def _old_pages(lines: list[str]) -> list[list]:
    pages: list[list] = []
    for line in lines:
        kind, value = _line(line)
        if kind == "page":
            pages.append([value, [], "DirectJoin"])
        elif pages and kind not in ("header", "note"):
            pages[-1][1].append(line)
    return [[m, "\n".join(t).strip(), j] for m, t, j in pages]


def _new_pages(lines: list[str]) -> tuple[list[list], str]:
    """Pages are [marker, text, join], text None until its block begins; inside is the block that is open."""
    pages: list[list] = []
    report: list[str] | None = None
    inside, body = "", []
    for line in lines:
        kind, value = _line(line)
        structural = kind in ("page", "TEXT_BEGIN", "TEXT_END", "REPORT_BEGIN", "REPORT_END") or (inside == "TEXT" and kind == "join")
        if inside and kind == f"{inside}_END":
            if inside == "TEXT":
                pages[-1][1] = "\n".join(body)
            else:
                report = body
            inside = ""
        elif inside and structural and not (inside == "REPORT" and kind == "REPORT_END"):
            raise FormatError(f"{kind} inside {inside}")
        elif inside:
            body.append(line)
        elif kind == "page":
            if report is not None or value in {p[0] for p in pages}:
                raise FormatError(f"page {value} twice or after the report")
            pages.append([value, None, None])
        elif kind == "TEXT_BEGIN":
            if not pages or report is not None or pages[-1][1] is not None:
                raise FormatError("a text without its page, or a second one")
            inside, body = "TEXT", []
        elif kind == "join":
            if not pages or report is not None or pages[-1][1] is None or pages[-1][2] is not None or value not in JOINS:
                raise FormatError(f"join {value} out of place, twice or unknown")
            pages[-1][2] = value
        elif kind == "REPORT_BEGIN":
            if report is not None:
                raise FormatError("a second report")
            inside, body = "REPORT", []
        elif kind not in ("blank", "header"):
            raise FormatError(f"{kind} out of place")
    if inside or report is None or any(p[1] is None or p[2] is None for p in pages):
        raise FormatError("a text, a join or the report is missing or open")
    return pages, "\n".join(report)


def parse(content: str) -> dict:
    """error (null if there is none), version, project_id, batch_id, pages and report; a broken file gives its error alone."""
    out = dict.fromkeys(("error", "version", "project_id", "batch_id", "pages", "report"))
    try:
        lines = _lines(content)
        version, project, batch = (_header(lines, n) for n in ("(?:[A-Z]+_)?FORMAT", "PROJECT_ID", "BATCH_ID"))
        if version not in ("1", "2"):
            raise FormatError("no known format")
        ids = [str(uuid.UUID(x or "")) for x in (project, batch)]
        pages, report = (_old_pages(lines), "") if version == "1" else _new_pages(lines)
        if not pages:
            raise FormatError("no pages")
    except ValueError as e:
        return out | {"error": str(e)}
    keys = ("page_marker", "text", "join_to_next")
    return out | {"version": int(version), "project_id": ids[0], "batch_id": ids[1], "pages": [dict(zip(keys, p, strict=True)) for p in pages], "report": report}


_S = T.StringType()
_PAGE = T.StructType([T.StructField(k, _S) for k in ("page_marker", "text", "join_to_next")])
_FILE = T.StructType([T.StructField("error", _S), T.StructField("version", T.IntegerType()), T.StructField("project_id", _S), T.StructField("batch_id", _S), T.StructField("pages", T.ArrayType(_PAGE)), T.StructField("report", _S)])


@F.pandas_udf(_FILE)
def _parsed(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(c or "") for c in contents], columns=_FILE.names)


def parsed(content: Column) -> Column:
    """struct<error, version, project_id, batch_id, pages, report> of each file's content."""
    return _parsed(content)


def rendered(pages: DataFrame, book: str, order: str, text: str, join: str, project: Column, batch: Column, format_name: str = "FORMAT") -> DataFrame:
    """(book, content): the pages of each book in format 2, numbered from 0001 in order; format_name is the first header's name, with a prefix where readers want one."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(join).alias("j"))))
    block = lambda r, i: F.concat(F.lit("[[PAGE:"), marker(i + 1), F.lit("]]\n[[TEXT_BEGIN]]\n"), r["t"], F.lit("\n[[TEXT_END]]\n[[JOIN_TO_NEXT:"), r["j"], F.lit("]]\n"))
    head = F.concat(F.lit(f"[[{format_name}:2]]\n[[PROJECT_ID:"), project, F.lit("]]\n[[BATCH_ID:"), batch, F.lit("]]\n"))
    return pages.groupBy(book).agg(F.concat(head, F.array_join(F.transform(rows, block), ""), F.lit("[[REPORT_BEGIN]]\n[[REPORT_END]]\n")).alias("content"))
