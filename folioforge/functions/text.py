"""Text functions as column expressions.  Offsets and lengths are UTF-16 units where a name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, the ideographic space included.
BLANKS = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A line that names the kind of a heading, and the marks of a scene break.
HEADINGS = r"\[\[(?:CHAPTER|TITLE|SECTION_TITLE|SECTION):[^\n]*\]\]"
SCENE_BREAKS = ("※", "***", "---")
#: What a chapter's number looks like, and how long the title below it may be.
CHAPTER_NUMBER = "^(第.{1,12}[章話部巻]|序章|終章|プロローグ|エピローグ)$"
TITLE_UNITS = 40


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{BLANKS}]")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def unit_slice(c: Column, start: Column, length: Column) -> Column:
    """The text at a UTF-16 range; null if the range leaves the text or splits a surrogate pair."""
    raw = F.encode(c, "UTF-16BE")
    first, last = start.cast("long"), start.cast("long") + length.cast("long")
    inside = (first >= 0) & (length >= 0) & (last <= units(c).cast("long"))
    part = F.decode(F.substring(raw, (first * 2 + 1).cast("int"), (length.cast("long") * 2).cast("int")), "UTF-16BE")
    return F.when(inside & ~splits_pair(c, start) & ~splits_pair(c, start + length), part)


def splits_pair(c: Column, at: Column) -> Column:
    """Whether a UTF-16 position lies between the halves of one character."""
    half = F.hex(F.substring(F.encode(c, "UTF-16BE"), (at.cast("long") * 2 + 1).cast("int"), F.lit(2)))
    return (at > 0) & F.coalesce(half.between("DC00", "DFFF"), F.lit(False))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def text_hash(c: Column) -> Column:
    return F.upper(F.sha2(c, 256))


def marker(n: Column) -> Column:
    """A number of four digits or more."""
    s = n.cast("string")
    return F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s)


def natural_key(c: Column) -> Column:
    """A key that sorts digit runs by value and the rest without regard to case."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{Nd}+|\P{Nd}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 19, "0")).otherwise(F.upper(p))), "")


def filename_time(c: Column) -> Column:
    """The first yyyymmdd_hhmmss of a file name; null if there is none or it is no time."""
    found = F.regexp_extract(c, r"([0-9]{8}_[0-9]{6})", 1)
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyyMMdd_HHmmss"))


def extreme_change(old: Column, new: Column) -> Column:
    """Whether a length differs by more than 20 and more than half."""
    return (old > 0) & (F.abs(new - old) > F.greatest(F.lit(20), F.floor(old / 2)))


def bad_markers(c: Column) -> Column:
    """Whether a text has a bracket marker that is no heading, or one that does not end."""
    rest = F.regexp_replace(c, r"\[\[(?:CHAPTER|TITLE|SECTION_TITLE|SECTION):[^\]\n]*\]\]", "")
    return F.contains(rest, F.lit("[["))


def collapse_blank_lines(c: Column) -> Column:
    """Paragraphs as lines: the lines of each, stripped, are put together, and blank lines, however many, part one from the next."""
    lines = F.transform(F.split(c, "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.when(is_blank(x), "\n").otherwise(strip(x)))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, ""), "\n+", "\n"), "^\n|\n$", "")


def markdown_escape(c: Column) -> Column:
    r"""A run of text as book markdown.

    & < > become entities, \ { } | [ ] * ! _ and backquotes get a backslash.  What would open a block at the very start is
    defused: the point of a list number, four spaces and a tab by entities, # - + * by a backslash (so * gets two).
    """
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    c = ruby_escape(c)
    c = (
        F.when(c.rlike(rf"^\p{{Nd}}+\.[{BLANKS}]"), F.regexp_replace(c, r"^(\p{Nd}+)\.", "$1&#46;"))
        .when(F.startswith(c, F.lit("    ")), F.concat(F.lit("&#32;" * 4), F.substr(c, F.lit(5))))
        .when(F.startswith(c, F.lit("\t")), F.concat(F.lit("&#9;"), F.substr(c, F.lit(2))))
        .when(c.rlike(r"^[#*+-]"), F.concat(F.lit("\\"), c)).otherwise(c)
    )
    return F.regexp_replace(c, r"([\[\]*!_`])", r"\\$1")


def ruby_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\{}|])", r"\\$1")


def alt_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def yaml_quote(c: Column) -> Column:
    """A double-quoted YAML scalar; control characters by their four-digit code."""
    c = F.regexp_replace(c, r'([\\"])', r"\\$1")
    for char, name in (("\r", "r"), ("\n", "n"), ("\t", "t")):
        c = F.replace(c, F.lit(char), F.lit(f"\\{name}"))
    code = lambda ch: F.when(ch.rlike(r"^[\x00-\x1F\x7F-\x9F]$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(ch)), 4, "0"))).otherwise(ch)
    controls = F.array_join(F.transform(F.split(c, ""), code), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1F\x7F-\x9F]"), controls).otherwise(c), F.lit('"'))


def word_key(text: Column, box: list[Column]) -> Column:
    """A key of a word by its text and its box to three decimals."""
    return text_hash(F.concat_ws("\u001f", text, *(F.format_string("%.3f", b.cast("double")) for b in box)))


def non_kana(reading: Column) -> Column:
    """Whether a normalised reading has anything but kana and their marks."""
    return reading.rlike(r"[^\u3040-\u30ff]")


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def chapter_page(c: Column) -> Column:
    """A page that opens a chapter, with its headings marked.

    The first line that is not blank is the chapter; if it is a number of the usual kind, a short line right below it is the
    title.  Blank lines before are dropped; a blank page gives an empty text.
    """
    lines = F.split(c, "\r\n|\r|\n", -1)
    at = F.array_position(F.transform(lines, lambda x: ~is_blank(x)), F.lit(True)).cast("int")
    chapter, below = strip(F.get(lines, at - 1)), strip(F.get(lines, at))
    titled = F.coalesce(chapter.rlike(CHAPTER_NUMBER) & (below != "") & (units(below) <= TITLE_UNITS), F.lit(False))
    begin = at + titled.cast("int")
    body = F.when(begin < F.size(lines), F.concat(F.lit("\n"), F.array_join(F.slice(lines, begin + 1, F.size(lines)), "\n"))).otherwise("")
    return F.when(at == 0, "").otherwise(F.concat(F.lit("[[CHAPTER:"), chapter, F.lit("]]"), F.when(titled, F.concat(F.lit("\n[[TITLE:"), below, F.lit("]]"))).otherwise(""), body))


def only_members(json: Column, allowed: dict[str, tuple[str, ...]], root: tuple[str, ...]) -> Column:
    """Whether a JSON text is an object with members of root alone, and the arrays of objects named in allowed have theirs alone.

    Null for null; names are compared with their case.
    """
    good = F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, root)))) == 0, F.lit(False))
    for name, members in allowed.items():
        rows = F.from_json(F.get_json_object(json, f"$.{name}"), "array<map<string,string>>")
        names = F.flatten(F.transform(rows, lambda r: F.map_keys(r)))
        fits = F.size(F.array_except(names, F.array(*map(F.lit, members)))) == 0
        good = good & F.coalesce(fits, F.get_json_object(json, f"$.{name}").isNull())
    return F.when(json.isNotNull(), good)


def changed_paragraphs(before: Column, after: Column) -> Column:
    """Lines that differ place by place; lines that only one side has count."""
    pairs = F.zip_with(F.split(newlines(before), "\n"), F.split(newlines(after), "\n"), lambda a, b: ~a.eqNullSafe(b))
    return F.size(F.filter(pairs, lambda d: d))
