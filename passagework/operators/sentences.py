"""Sentence scanning: three notions of where a sentence stops, over delimiters found by str.find.

Ahead: a single delimiter before white space stops; runs of delimiters and delimiters before anything else don't; text
of which one byte or less is left counts as done, and a scan that gets there takes all of it. Backwards: every single
delimiter stops. Patterns after or before a delimiter can lift a stop in either direction.
"""

from __future__ import annotations

from ..functions.text import WHITE_SPACE

_WHITE = frozenset(WHITE_SPACE)


def _done(text: str, at: int) -> bool:
    left = len(text) - at
    return left <= 0 or left == 1 and ord(text[at]) < 128


def _next_stop(text: str, at: int, delimiter: str) -> int:
    """The place after the next stop, or the end."""
    n = len(text)
    while not _done(text, at):
        hit = text.find(delimiter, at)
        if hit < 0 or _done(text, hit + 1):
            break
        after = hit + 1
        while after < n and text[after] == delimiter:
            after += 1
        if after == hit + 1 and text[after] in _WHITE:
            return after
        at = after
    return n


def sentences_ahead(text: str, start: int, count: int, delimiter: str, skip_f: list[str], skip_b: list[str]) -> int:
    """Where the `count` sentences end that begin at `start`; the text's length if they reach its end."""
    rest = text[start:] if start else text
    at, n = 0, len(rest)
    for _ in range(count):
        at = _next_stop(rest, at, delimiter)
        while not _done(rest, at):
            over = next((f for f in skip_f if at + len(f) < n and rest.startswith(f, at)), None)
            if over is not None:
                at += len(over)
            elif not any(at > len(b) and rest.endswith(b, 0, at - 1) for b in skip_b):
                break
            at = _next_stop(rest, at, delimiter)
    return len(text) if _done(rest, at) else start + at


def sentences_before(text: str, count: int, delimiter: str, skip_f: list[str], skip_b: list[str]) -> int:
    """Where the last `count` sentences of the text begin; its last character is taken for a delimiter."""
    at = max(len(text) - 1, 0)

    def back(place: int) -> int:
        while place > 0:
            hit = text.rfind(delimiter, 0, place)
            if hit <= 0:
                return 0
            run = hit
            while run > 0 and text[run - 1] == delimiter:
                run -= 1
            if run == hit:
                return hit
            place = run
        return 0

    for _ in range(count):
        at = back(at)
        while at > 0:
            if not any(text.startswith(f, at + 1) and at + len(f) < len(text) for f in skip_f):
                under = next((b for b in skip_b if text.endswith(b, 0, at)), None)
                if under is None:
                    break
                at = max(at - len(under), 0)
            at = back(at)
    return at + 1 if at > 0 else 0


def groups(text: str, size: int, delimiter: str, skip_f: list[str], skip_b: list[str]) -> list[str]:
    """The text in groups of `size` sentences (0 counts as 1); the last may be smaller."""
    out, start = [], 0
    while start < len(text):
        end = sentences_ahead(text, start, max(size, 1), delimiter, skip_f, skip_b)
        out.append(text[start:end])
        start = end
    return out
