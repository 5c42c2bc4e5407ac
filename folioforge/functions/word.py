"""Word-processor documents: the parts of the archive as text, paragraphs and their readings as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name space, styles of roles, sizes in half points, page and margins in twentieths of a point.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
STYLES = {"ChapterTitle": "Heading1", "SectionTitle": "Heading2", "SectionNumber": "SectionNumber", "SceneBreak": "SceneBreak"}
SIZES = {"Heading1": 32, "Heading2": 28, "Heading3": 24}
NORMAL, BODY_SIZE = "Normal", 21
_SECTION = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1134" w:right="1134" w:bottom="1134" w:left="1134" w:header="708" w:footer="708" w:gutter="0"/></w:sectPr>'
_PARTS = {
    "[Content_Types].xml": (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
        '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
    ),
    "_rels/.rels": (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    ),
    "word/_rels/document.xml.rels": (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
    ),
}


@dataclass(frozen=True)
class WordOptions:
    """What a document looks like: its font, whether chapters begin a page, how far readings are raised and how large they are."""

    font: str = "Yu Mincho"
    break_before_chapters: bool = False
    offset_points: int = 3
    reading_half_points: int = 10

    def __post_init__(self) -> None:
        if not 0 <= self.offset_points <= 20:
            raise ValueError("the offset is a whole number from 0 to 20")

    @property
    def raised(self) -> int:
        return self.reading_half_points + 2 * self.offset_points


def offset_of(value: str | None) -> int | None:
    """The offset that a text names; null if it is no whole number from 0 to 20."""
    try:
        found = int((value or "").strip())
    except ValueError:
        return None
    return found if 0 <= found <= 20 else None


def xml(c: Column) -> Column:
    """A text inside an element: marks as entities, characters that XML has not left out."""
    allowed = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        allowed = F.replace(allowed, F.lit(mark), F.lit(entity))
    return allowed


def style_of(role: Column) -> Column:
    pick = F.create_map(*(F.lit(x) for kv in STYLES.items() for x in kv))
    return F.coalesce(F.try_element_at(pick, role), F.lit(NORMAL))


def _text(c: Column) -> Column:
    return F.concat(F.lit('<w:t xml:space="preserve">'), xml(c), F.lit("</w:t>"))


def _run_properties(font: Column, size: Column) -> Column:
    s = size.cast("string")
    return F.concat(F.lit('<w:rPr><w:rFonts w:ascii="'), font, F.lit('" w:hAnsi="'), font, F.lit('" w:eastAsia="'), font, F.lit('"/><w:sz w:val="'), s, F.lit('"/><w:szCs w:val="'), s, F.lit('"/></w:rPr>'))


def paragraph(role: Column, inlines: Column, options: WordOptions) -> Column:
    """A paragraph's element; inlines: array<struct<text, reading>>, reading null for plain text."""
    style, font = style_of(role), F.lit(options.font.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;"))
    size = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIZES.items() for x in kv)), style), F.lit(BODY_SIZE))
    head = F.lit(f'<w:r><w:ruby><w:rubyPr><w:rubyAlign w:val="center"/><w:hps w:val="{options.reading_half_points}"/><w:hpsRaise w:val="{options.raised}"/><w:hpsBaseText w:val="')
    small = _run_properties(font, F.lit(options.reading_half_points))
    read = lambda x: F.concat(head, size.cast("string"), F.lit('"/><w:lid w:val="ja-JP"/></w:rubyPr><w:rt><w:r>'), small, _text(x["reading"]), F.lit("</w:r></w:rt><w:rubyBase><w:r>"), _run_properties(font, size), _text(x["text"]), F.lit("</w:r></w:rubyBase></w:ruby></w:r>"))
    run = lambda x: F.when(x["reading"].isNull(), F.concat(F.lit("<w:r>"), _text(x["text"]), F.lit("</w:r>"))).otherwise(read(x))
    new_page = F.when(F.lit(options.break_before_chapters) & (role == "ChapterTitle"), "<w:pageBreakBefore/>").otherwise("")
    return F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), style, F.lit('"/>'), new_page, F.lit("</w:pPr>"), F.array_join(F.transform(inlines, run), ""), F.lit("</w:p>"))


def styles(options: WordOptions) -> str:
    """The styles' part."""
    font = options.font.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    base = '<w:spacing w:after="0" w:line="360" w:lineRule="auto"/>'
    size = lambda n: f'<w:sz w:val="{n}"/><w:szCs w:val="{n}"/>'
    style = lambda name, shown, inner, default="": f'<w:style w:type="paragraph" w:styleId="{name}"{default}><w:name w:val="{shown}"/>' + ('<w:basedOn w:val="Normal"/>' if name != NORMAL else "") + f"{inner}</w:style>"
    out = [style(NORMAL, "Normal", f'<w:pPr>{base}<w:ind w:firstLineChars="100"/></w:pPr>', ' w:default="1"')]
    out += [style(f"Heading{k}", f"heading {k}", f'<w:pPr><w:keepNext/><w:ind w:firstLineChars="0"/></w:pPr><w:rPr><w:b/>{size(SIZES[f"Heading{k}"])}</w:rPr>') for k in (1, 2, 3)]
    out += [style(n, shown, '<w:pPr><w:ind w:firstLineChars="0"/><w:jc w:val="center"/></w:pPr>') for n, shown in (("SectionNumber", "Section Number"), ("SceneBreak", "Scene Break"))]
    fonts = f'<w:rPrDefault><w:rPr><w:rFonts w:ascii="{font}" w:hAnsi="{font}" w:eastAsia="{font}"/>{size(BODY_SIZE)}</w:rPr></w:rPrDefault>'
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:styles xmlns:w="{_W}"><w:docDefaults>{fonts}<w:pPrDefault><w:pPr>{base}</w:pPr></w:pPrDefault></w:docDefaults>' + "".join(out) + "</w:styles>"


def parts(paragraphs: DataFrame, book: str, order: str, options: WordOptions | None = None) -> DataFrame:
    """(batch, path, content): the parts of each book's document, to be packed by packages.zipped().

    paragraphs: book, order, role, inlines.  A book's paragraphs are put together in one row, as its one file has to be.
    """
    options = options or WordOptions()
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), paragraph(F.col("role"), F.col("inlines"), options).alias("p"))))
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W}"><w:body>'
    body = paragraphs.groupBy(F.col(book).alias("batch")).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["p"]), ""), F.lit(_SECTION + "</w:body></w:document>")).alias("content"))
    fixed = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in (*_PARTS.items(), ("word/styles.xml", styles(options)))))
    return body.select("batch", F.inline(F.concat(fixed, F.array(F.struct(F.lit("word/document.xml").alias("path"), F.col("content"))))))


def problems(archive: bytes) -> list[str]:
    """What is wrong with a document's archive: parts that are missing, or no XML, styles that are not there, readings without a base."""
    import io
    import zipfile
    from xml.etree import ElementTree

    found, trees = [], {}
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            for part in (*_PARTS, "word/styles.xml", "word/document.xml"):
                try:
                    trees[part] = ElementTree.fromstring(z.read(part))
                except KeyError:
                    found.append(f"{part} is missing")
                except ElementTree.ParseError as e:
                    found.append(f"{part}: {e}")
    except zipfile.BadZipFile:
        return ["no archive"]
    if found:
        return found
    w = f"{{{_W}}}"
    known = {s.get(f"{w}styleId") for s in trees["word/styles.xml"].iter(f"{w}style")}
    body = trees["word/document.xml"].find(f"{w}body")
    if body is None or not len(body) or body[-1].tag != f"{w}sectPr":
        found.append("the body does not end with its section")
    used = {s.get(f"{w}val") for s in trees["word/document.xml"].iter(f"{w}pStyle")}
    found += [f"style {s} is missing" for s in sorted(used - known)]
    found += ["a reading without its parts" for r in trees["word/document.xml"].iter(f"{w}ruby") if [x.tag for x in r] != [f"{w}rubyPr", f"{w}rt", f"{w}rubyBase"]]
    return found
