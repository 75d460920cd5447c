"""Chunking, parsing and paging configurations: validation and their camel-case JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from .errors import InvalidConfig

# Patterns that keep a delimiter from ending a sentence, if they stand after or before it.
SKIP_FORWARD = ["com", "org", "net", "g.", "e.", "sh", "rs", "js", "json"]
SKIP_BACK = ["www", "etc", "e.g", "i.e"]

# Names of the similarity functions.
DISTANCES = ["cosine", "euclidean", "manhattan", "angular", "chebyshev", "dotProduct", "minkowski"]

DEFAULT_PAGE, DEFAULT_PER_PAGE = 1, 10


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise InvalidConfig(why)


def _count(value: Any, name: str, least: int = 0) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name} must be an integer of {least} or more")
    return value


def _patterns(values: list[str], name: str) -> None:
    _need(all(isinstance(v, str) and v for v in values), f"{name} must hold strings that aren't empty")


@dataclass(frozen=True)
class Sliding:
    """Windows of `size` bytes, widened by `overlap` bytes on both sides."""

    size: int = 1000
    overlap: int = 200
    display = "SlidingWindow"

    def __post_init__(self):
        _count(self.size, "size", 1)
        _count(self.overlap, "overlap")
        _need(self.overlap <= self.size, "overlap must not exceed size")


@dataclass(frozen=True)
class Snapping:
    """Chunks of at least `size` bytes that end with a sentence, with `overlap` sentences from before and after."""

    size: int = 1000
    overlap: int = 5
    delimiter: str = "."
    skip_f: list[str] = field(default_factory=lambda: list(SKIP_FORWARD))
    skip_b: list[str] = field(default_factory=lambda: list(SKIP_BACK))
    display = "SnappingWindow"

    def __post_init__(self):
        _count(self.size, "size")
        _count(self.overlap, "overlap")
        _need(self.overlap <= self.size, "overlap must not exceed size")
        _need(len(self.delimiter) == 1, "delimiter must be one character")
        _patterns(self.skip_f, "skipF")
        _patterns(self.skip_b, "skipB")

    def extended(self, forward: list[str], back: list[str]) -> Snapping:
        return Snapping(self.size, self.overlap, self.delimiter, [*self.skip_f, *forward], [*self.skip_b, *back])


@dataclass(frozen=True)
class Semantic:
    """Groups of `size` sentences, clustered by their embeddings' similarity."""

    size: int = 10
    threshold: float = 0.9
    distance: str = "cosine"
    p: int | None = None
    delimiter: str = "."
    skip_f: list[str] = field(default_factory=lambda: list(SKIP_FORWARD))
    skip_b: list[str] = field(default_factory=lambda: list(SKIP_BACK))
    model: str = "hashing-64"
    provider: str = "hashing"
    best_match: bool = False
    display = "SemanticWindow"

    def __post_init__(self):
        _count(self.size, "size")
        _need(self.distance in DISTANCES, f"distanceFn must be one of {', '.join(DISTANCES)}")
        _need((self.p is not None) == (self.distance == "minkowski"), "minkowski takes a power, the others none")
        _need(self.p is None or self.p >= 1, "minkowski's power must be 1 or more")
        _need(len(self.delimiter) == 1, "delimiter must be one character")
        _patterns(self.skip_f, "skipF")
        _patterns(self.skip_b, "skipB")


ChunkConfig = Sliding | Snapping | Semantic


def chunk_config_from_json(text: str) -> ChunkConfig:
    """{"sliding": {...}}, {"snapping": {...}} or {"semantic": {...}}."""
    try:
        ((kind, body),) = json.loads(text).items()
    except (ValueError, AttributeError) as e:
        raise InvalidConfig("a chunker has exactly one kind") from e
    try:
        if kind == "sliding":
            return Sliding(body["size"], body["overlap"])
        if kind == "snapping":
            return Snapping(body["size"], body["overlap"], body["delimiter"], body["skipF"], body["skipB"])
        if kind == "semantic":
            distance, p = body["distanceFn"], None
            if isinstance(distance, dict):
                ((distance, p),) = distance.items()
            model = body.get("embeddingModel", body.get("embedModel"))
            provider = body.get("embeddingProvider", body.get("embedProvider"))
            return Semantic(body["size"], body["threshold"], distance, p, body["delimiter"], body["skipF"], body["skipB"], model, provider)
    except KeyError as e:
        raise InvalidConfig(f"{kind}: {e.args[0]} is missing") from e
    raise InvalidConfig(f"unknown chunker {kind}")


def chunk_config_to_json(c: ChunkConfig) -> str:
    if isinstance(c, Sliding):
        return json.dumps({"sliding": {"size": c.size, "overlap": c.overlap}})
    if isinstance(c, Snapping):
        return json.dumps({"snapping": {"size": c.size, "overlap": c.overlap, "delimiter": c.delimiter, "skipF": c.skip_f, "skipB": c.skip_b}})
    distance = {"minkowski": c.p} if c.distance == "minkowski" else c.distance
    body = {"size": c.size, "threshold": c.threshold, "distanceFn": distance, "delimiter": c.delimiter, "skipF": c.skip_f, "skipB": c.skip_b, "embeddingModel": c.model, "embeddingProvider": c.provider}
    return json.dumps({"semantic": body})


@dataclass(frozen=True)
class ParseConfig:
    """Pages to keep and patterns of lines to drop. range: pages [start, end) counted from 1; else `start` pages from the
    front and `end` from the back are left out."""

    start: int = 0
    end: int = 0
    range: bool = False
    filters: list[str] = field(default_factory=list)

    def __post_init__(self):
        _count(self.start, "start")
        _count(self.end, "end")
        if self.range:
            _need(self.start > 0, "start must be 1 or more in a range")
            _need(self.end > self.start, "end must exceed start in a range")
        for f in self.filters:
            try:
                re.compile(f)
            except re.error as e:
                raise InvalidConfig(f"bad pattern {f!r}") from e

    def to_json(self) -> str:
        return json.dumps({"start": self.start, "end": self.end, "range": self.range, "filters": self.filters})

    @classmethod
    def from_json(cls, text: str) -> ParseConfig:
        body = json.loads(text)
        missing = {"start", "end", "range", "filters"} - set(body)
        _need(not missing, f"parser: {', '.join(sorted(missing))} missing")
        return cls(body["start"], body["end"], body["range"], body["filters"])


@dataclass(frozen=True)
class Page:
    """A page of a listing: order by any column, `page` counted from 1."""

    page: int = DEFAULT_PAGE
    per_page: int = DEFAULT_PER_PAGE
    sort_by: str = "updated_at"
    descending: bool = True

    def __post_init__(self):
        _count(self.page, "page", 1)
        _count(self.per_page, "perPage", 1)
        _need(bool(re.fullmatch(r"[A-Za-z0-9_]{1,64}", self.sort_by)), "sort column must be 1 to 64 letters, digits or underscores")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.per_page


def collection_name(name: str) -> str:
    """The trimmed name, if it is a capital letter with letters, digits and underscores after it."""
    name = name.strip()
    _need(bool(re.fullmatch(r"[A-Z][A-Za-z0-9_]*", name)), "a collection's name starts with a capital letter and has only letters, digits and underscores")
    return name
