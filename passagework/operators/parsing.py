"""From document bytes to text: plain text, paged text (PDF) and DOCX.

Page slices, line trims, page numbers and line patterns are native expressions over an array of pages. The text of PDF
pages comes from an extractor that is plugged in (none ships with Spark); DOCX is read with the standard library.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ParseConfig
from ..errors import UnsupportedFileType
from ..functions.batches import in_slices
from ..functions.text import TEXT_TYPES, WHITE_SPACE, file_type, lines, lossy_utf8, once, unicode_trim

#: bytes of a PDF -> the text of each page
PageExtractor = Callable[[bytes], list[str]]


def kept_pages(pages: Column, c: ParseConfig) -> Column:
    """Structs (page, text) of the pages that the configuration keeps, counted from 0."""
    def kept(p: Column) -> Column:
        numbered = F.transform(p, lambda t, i: F.struct(i.alias("page"), t.alias("text")))
        if c.range:
            return F.filter(numbered, lambda x: (x["page"] >= c.start - 1) & (x["page"] < c.end - 1))
        return F.filter(numbered, lambda x: (x["page"] >= c.start) & (x["page"] < F.size(p) - c.end))

    return once(pages, kept)


def page_lines(page: Column, c: ParseConfig) -> Column:
    """Trimmed lines of a page, without its number (from 0) and without lines that a pattern matches anywhere."""
    trimmed = F.transform(lines(page["text"]), unicode_trim)
    kept = F.filter(trimmed, lambda x: x != page["page"].cast("string"))
    if c.filters:
        any_of = "|".join(f"(?:{pattern})" for pattern in c.filters)
        kept = F.filter(kept, lambda x: ~x.rlike(f"(?U){any_of}"))
    return kept


def paged_text(pages: Column, c: ParseConfig | None = None) -> Column:
    """Lines of the kept pages, each with a newline after it; null if there are none."""
    config = c or ParseConfig()
    all_lines = F.flatten(F.transform(kept_pages(pages, config), lambda p: page_lines(p, config)))
    return once(all_lines, lambda x: F.when(F.size(x) > 0, F.concat(F.array_join(x, "\n"), F.lit("\n"))))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _runs(paragraph: ET.Element) -> list[str]:
    """Texts of the paragraph's runs, and of the runs in its hyperlinks."""
    out = []
    for child in paragraph:
        for run in [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []:
            out += [t.text or "" for t in run.findall(f"{_W}t")]
    return out


def _table(table: ET.Element) -> str:
    """Markdown: each row's cells, then a row of dashes as long as the cells' bytes."""
    out = []
    for row in table.findall(f"{_W}tr"):
        cells = ["".join(f" {''.join(_runs(p))} " for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")]
        out.append(f"|{'|'.join(cells).replace('  ', ' ')}|\n|" + "".join("-" * len(x.encode()) + "|" for x in cells) + "\n")
    return "".join(out)


def docx_text(content: bytes) -> str:
    """Paragraphs a line each, their runs trimmed and followed by a space; tables as Markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            out.append("".join(f"{t} " for r in _runs(child) if (t := r.strip(WHITE_SPACE))))
        elif child.tag == f"{_W}tbl":
            out.append(_table(child))
    return "".join(f"{x}\n" for x in out)


def docx_column(content: Column) -> Column:
    """Null where the bytes are no DOCX."""

    def one(b: bytes | None) -> str | None:
        try:
            return None if b is None else docx_text(b)
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return None

    return in_slices(content, lambda files: [one(b) for b in files], "string", pa.string())


def pdf_pages(content: Column, extract: PageExtractor) -> Column:
    return in_slices(content, lambda files: [None if b is None else extract(b) for b in files], "array<string>", pa.list_(pa.string()))


def parse(files: DataFrame, c: ParseConfig | None = None, extract: PageExtractor | None = None, name: str = "name", content: str = "content") -> DataFrame:
    """files with `text` and `error` instead of the content. Text and DOCX don't look at the configuration."""
    ext = file_type(F.col(name))
    plain = F.when(ext.isin(TEXT_TYPES), lossy_utf8(F.col(content)))
    docx = docx_column(F.when(ext == "docx", F.col(content)))
    pages = pdf_pages(F.when(ext == "pdf", F.col(content)), extract) if extract else F.lit(None).cast("array<string>")
    out = files.withColumn("_ext", ext).withColumn("_pages", pages).withColumn("text", F.coalesce(plain, docx, paged_text(F.col("_pages"), c)))
    error = F.when(F.col("_ext").isNull(), "unsupported file type").when(F.col("text").isNull(), F.when((F.col("_ext") == "pdf") & F.lit(extract is None), "no PDF extractor").otherwise("empty output"))
    return out.withColumn("error", error).drop("_ext", "_pages", content)


def require_type(name: str) -> str:
    """The extension of a file name; raises where it is none of the supported ones."""
    ext = name.rsplit(".", 1)[1] if "." in name else ""
    if ext not in [*TEXT_TYPES, "pdf", "docx"]:
        raise UnsupportedFileType(name)
    return ext
