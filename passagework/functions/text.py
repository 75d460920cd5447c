"""Text functions: Unicode trim, lossy decoding, byte-wise work on UTF-8, file types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the supported file types.
TEXT_TYPES = ["md", "xml", "json", "csv", "txt"]
FILE_TYPES = [*TEXT_TYPES, "pdf", "docx"]

#: Unicode White_Space, for Python code; str.isspace() also has U+001C to U+001F.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once a row, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def unicode_trim(text: Column) -> Column:
    """Without Unicode white space at either end; trim() alone strips U+0020."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def lossy_utf8(content: Column) -> Column:
    """Bytes as text, invalid sequences as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def content_hash(content: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(content, 256)


def file_type(name: Column) -> Column:
    """What stands after the last dot, if it is a supported extension; else null."""
    ext = F.substring_index(name, ".", -1)
    return F.when((F.instr(name, ".") > 0) & ext.isin(FILE_TYPES), ext)


def lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); a final end makes no further line."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return once(parts, lambda x: F.when((F.size(x) > 1) & (F.element_at(x, -1) == ""), F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def is_continuation(data: Column, at: Column) -> Column:
    """Whether the byte at a place counted from 0 continues a character."""
    return F.substring(data, at + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))


def boundary_at_or_before(data: Column, at: Column) -> Column:
    """The last place up to `at` that starts a character; a character has four bytes at most."""
    out = F.when(at <= 0, F.lit(0))
    for j in range(3):
        out = out.when(~is_continuation(data, at - j), at - j)
    return out.otherwise(at - 3)


def boundary_at_or_after(data: Column, at: Column, size: Column) -> Column:
    """The first place from `at` on that starts a character, or the end."""
    out = F.when(at >= size, size)
    for j in range(3):
        out = out.when(~is_continuation(data, at + j), at + j)
    return F.least(out.otherwise(at + 3), size)
