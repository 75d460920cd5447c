"""Text of PDF files, page by page, from what the standard library can read: Flate streams, object streams, simple and
composite fonts with ToUnicode maps. Encrypted files, other filters and pictures of text give no text.

A page's lines end where the text moves to another height; a move along the line, or a wide gap inside an array of strings,
is a space. A file without readable pages gives an empty list; what is damaged is passed over.
"""

from __future__ import annotations

import re
import zlib
from typing import Any, NamedTuple

_SPACE, _DELIMITER = b" \t\r\n\f\0", b"()<>[]{}/%"


class Ref(NamedTuple):
    number: int


class Name(str):
    """A PDF name, without its slash."""


class Word(bytes):
    """An operator of a content stream, or a keyword."""


class Lexer:
    """Values of PDF syntax, one after another. refs: whether `1 0 R` is a reference (not so in content streams)."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def _skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:  # a comment
                while self.at < len(self.data) and self.data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def _run(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in _SPACE and self.data[self.at] not in _DELIMITER:
            self.at += 1
        return self.data[start : self.at]

    def _string(self) -> bytes:
        out, depth = bytearray(), 1
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                c = self.data[self.at : self.at + 1]
                self.at += 1
                if c.isdigit() and c < b"8":
                    digits = c
                    while len(digits) < 3 and self.data[self.at : self.at + 1] in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7"):
                        digits += self.data[self.at : self.at + 1]
                        self.at += 1
                    out.append(int(digits, 8) & 255)
                elif c == b"\r":
                    self.at += self.data[self.at : self.at + 1] == b"\n"
                elif c != b"\n":
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(c, c)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def value(self) -> Any:
        """The next value; None at the end (null is None as well)."""
        self._skip()
        c = self.data[self.at : self.at + 1]
        if not c:
            return None
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._run()).decode("latin-1"))
        if c == b"(":
            self.at += 1
            return self._string()
        if self.data[self.at : self.at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self._skip()
                if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value()
                out[str(key) if isinstance(key, Name) else key] = self.value()
        if c == b"<":
            end = self.data.find(b">", self.at)
            end = len(self.data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self._skip()
                if self.at >= len(self.data) or self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value())
        if c in b">]){}":
            self.at += 1
            return Word(c)
        word = self._run()
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            if self.refs and word.isdigit() and (m := re.compile(rb"\s+\d+\s+R(?![A-Za-z0-9])").match(self.data, self.at)):
                self.at = m.end()
                return Ref(int(word))
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Word(word))

    def done(self) -> bool:
        self._skip()
        return self.at >= len(self.data)


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, Any] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        for m in iter(lambda: re.compile(rb"(\d+)\s+\d+\s+obj\b").search(data, at), None):
            lexer = Lexer(data, m.end())
            number, value = int(m[1]), lexer.value()
            self.objects[number], at = value, lexer.at
            begins = re.compile(rb"\s*stream\r?\n").match(data, at)
            if begins and isinstance(value, dict):
                length, start = value.get("Length"), begins.end()
                stop = start + length if isinstance(length, int) and data[start + length : start + length + 12].lstrip().startswith(b"endstream") else data.find(b"endstream", start)
                stop = len(data) if stop < 0 else stop
                self.streams[number], at = data[start:stop], stop
        for number in list(self.streams):
            head = self.objects[number]
            if head.get("Type") == "ObjStm" and isinstance(head.get("N"), int) and isinstance(head.get("First"), int):
                body = self.stream(number)
                lexer = Lexer(body)
                places = [(lexer.value(), lexer.value()) for _ in range(head["N"])]
                for n, place in places:
                    if isinstance(n, int) and isinstance(place, int):
                        self.objects.setdefault(n, Lexer(body, head["First"] + place).value())

    def get(self, value: Any) -> Any:
        for _ in range(20):  # references to references
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def stream(self, number: int) -> bytes:
        """Decoded; empty if a filter isn't known."""
        data, head = self.streams.get(number, b""), self.objects.get(number) or {}
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("FlateDecode", "Fl"):
                return b""
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
        parms = self.get(head.get("DecodeParms"))
        return b"" if isinstance(parms, dict) and parms.get("Predictor", 1) != 1 else data

    def pages(self) -> list[dict]:
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: Any, inherited: dict) -> None:
            if isinstance(ref, Ref):
                if ref.number in seen:
                    return
                seen.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            node = {**inherited, **node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, {k: node[k] for k in ("Resources",) if k in node})
            elif node.get("Type") in ("Page", None):
                out.append(node)

        roots = [v for _, v in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == "Catalog"]
        for root in roots[-1:]:
            walk(root.get("Pages"), {})
        return out or [v for _, v in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == "Page"]

    def content(self, page: dict) -> bytes:
        held = page.get("Contents")
        refs = held if isinstance(held, list) else self.get(held) if isinstance(self.get(held), list) else [held]
        return b"\n".join(self.stream(r.number) for r in refs if isinstance(r, Ref))

    def fonts(self, page: dict) -> dict[str, Font]:
        known = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        return {name: Font(self, self.get(v)) for name, v in known.items() if isinstance(self.get(v), dict)}


class Font:
    """From codes to text: by the ToUnicode map, else Windows-1252."""

    def __init__(self, doc: Document, head: dict):
        self.width, self.map = 2 if head.get("Subtype") == "Type0" else 1, {}
        ref = head.get("ToUnicode")
        if isinstance(ref, Ref):
            self._read(doc.stream(ref.number))

    def _read(self, data: bytes) -> None:
        lexer, held = Lexer(data, refs=False), []
        while not lexer.done():
            v = lexer.value()
            if not isinstance(v, Word):
                held.append(v)
                continue
            if v in (b"endbfchar", b"endbfrange", b"endcodespacerange"):
                step = 2 if v != b"endbfrange" else 3
                for i in range(0, len(held) - step + 1, step):
                    self._entry(v, held[i : i + step])
            held = []

    def _entry(self, kind: bytes, parts: list) -> None:
        if not all(isinstance(p, bytes) for p in parts[:2]):
            return
        text = lambda b: b.decode("utf-16-be", "replace")
        lo = int.from_bytes(parts[0])
        if kind == b"endcodespacerange":
            self.width = max(1, len(parts[0]))
        elif kind == b"endbfchar":
            self.map[lo] = text(parts[1])
        else:
            for k in range(min(int.from_bytes(parts[1]) - lo, 0xFFFF) + 1):
                if isinstance(parts[2], list):
                    if k < len(parts[2]) and isinstance(parts[2][k], bytes):
                        self.map[lo + k] = text(parts[2][k])
                elif isinstance(parts[2], bytes) and len(parts[2]) >= 2:
                    self.map[lo + k] = text(parts[2][:-2] + ((int.from_bytes(parts[2][-2:]) + k) & 0xFFFF).to_bytes(2))

    def text(self, data: bytes) -> str:
        if not self.map:
            return data.decode("cp1252", "replace") if self.width == 1 else ""
        codes = (int.from_bytes(data[i : i + self.width]) for i in range(0, len(data), self.width))
        return "".join(self.map.get(c, "") for c in codes)


#: Thousandths of the font's size by which a gap in an array of strings is a space.
GAP = 200


def page_text(content: bytes, fonts: dict[str, Font]) -> str:
    """Lines of the page, each with its end."""
    lexer, held, font = Lexer(content, refs=False), [], None
    lines: list[list[str]] = [[]]
    height: float | None = None

    def line() -> None:
        if lines[-1]:
            lines.append([])

    def show(data: Any) -> None:
        if isinstance(data, bytes):
            lines[-1].append(font.text(data) if font else data.decode("cp1252", "replace"))

    while not lexer.done():
        v = lexer.value()
        if not isinstance(v, Word):
            held.append(v)
            continue
        if v == b"Tf" and len(held) > 1:
            font = fonts.get(str(held[-2]))
        elif v in (b"Tj", b"'", b'"') and held:
            if v != b"Tj":
                line()
            show(held[-1])
        elif v == b"TJ" and held and isinstance(held[-1], list):
            for item in held[-1]:
                if isinstance(item, (int, float)) and item < -GAP and lines[-1]:
                    lines[-1].append(" ")
                show(item)
        elif v in (b"Td", b"TD") and len(held) > 1:
            if held[-1] != 0:
                line()
            elif lines[-1]:
                lines[-1].append(" ")
        elif v == b"Tm" and len(held) > 5:
            if height is not None and held[-1] != height:
                line()
            elif lines[-1]:
                lines[-1].append(" ")
            height = held[-1]
        elif v in (b"T*", b"ET"):
            line()
        elif v == b"BI":  # a picture in the stream
            end = lexer.data.find(b"EI", lexer.at)
            lexer.at = len(lexer.data) if end < 0 else end + 2
        held = []
    return "".join(f"{re.sub(r' +', ' ', ''.join(parts)).rstrip()}\n" for parts in lines if parts)


def pdf_text(data: bytes) -> list[str]:
    """The text of each page."""
    if b"%PDF-" not in data[:1024]:
        return []
    doc = Document(data)
    return [page_text(doc.content(p), doc.fonts(p)) for p in doc.pages()]
