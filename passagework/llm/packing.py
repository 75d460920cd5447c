"""Best-fit packing of documents into sequences, with exact-complement hashing.

Documents are tokenized and end with an end token; only longer ones are cut. The histogram of piece lengths has at most
`capacity` rows, so the plan is made on the driver from it alone, whatever the number of documents. The plan takes
lengths from the largest down. It indexes the sums of single, pair and triple lengths by hash and consumes, under the
counts still there, combinations that fill the gap exactly; what no combination completes goes by best fit, largest
first. A plan is a list of patterns (lengths side by side) with counts; a piece finds its sequence from its length and
its gapless rank among pieces of that length, without any gathering or moving of pieces.

Defined results: a null or empty text is its end token alone; a table without rows gives none; repeated rows are packed
each; columns other than those named are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, lean, materialize

#: Rows (part, length) of the table of first ranks up to which it is broadcast: 64 MB at 16 bytes each.
BROADCAST_ROWS = 1 << 22

Pattern = tuple[tuple[int, ...], int]


class Complements:
    """Lengths with counts, and hash indexes from sums to the pairs of available lengths that make them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.triples: dict[int, np.ndarray] = {}
        lengths = sorted(self.left, reverse=True)
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b < capacity:
                    self.pairs[a + b].append((a, b))  # by the larger length, descending

    def times(self, combination: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        need: dict[int, int] = defaultdict(int)
        for n in combination:
            need[n] += 1
        return min(self.left.get(n, 0) // k for n, k in need.items())

    def take(self, combination: tuple[int, ...], times: int) -> None:
        for n in combination:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]

    def filling(self, gap: int, besides: int) -> Iterator[tuple[int, ...]]:
        """Single, pair and triple combinations with the sum gap, each available beside one piece of length `besides`."""
        if self.times((besides, gap)):
            yield (gap,)
        for a, b in self._live(gap):
            if self.times((besides, a, b)):
                yield (a, b)
        for a, b, c in self._triples(gap):
            if besides not in self.left:
                break
            if self.times((besides, a, b, c)):
                yield (a, b, c)

    def _triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """Triples with this sum, by their largest lengths, descending; a sum's entry is made when it is first looked up."""
        if total not in self.triples:
            sizes = np.array(sorted(self.left, reverse=True), np.int32)
            there = np.zeros(total + 1, bool)
            there[sizes[sizes <= total]] = True
            first, second = (x.ravel() for x in np.meshgrid(sizes[sizes < total], sizes[sizes < total], indexing="ij"))
            third = total - first - second
            ok = (second <= first) & (third <= second) & (third > 0)
            ok[ok] = there[third[ok]]
            self.triples[total] = np.stack([first[ok], second[ok], third[ok]], 1)
        known = self.triples[total]
        for i in range(0, len(known), 256):  # lengths run out while combinations are consumed
            some = known[i : i + 256]
            left = np.array(sorted(self.left), np.int32)
            for row in some[np.isin(some, left).all(axis=1)].tolist():
                yield tuple(row)

    def _live(self, total: int) -> list[tuple[int, int]]:
        """Pairs with this sum whose lengths are still there; others leave the index."""
        live = [p for p in self.pairs.get(total, ()) if p[0] in self.left and p[1] in self.left]
        self.pairs[total] = live
        return live


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns with counts that hold all pieces of the histogram."""
    out: list[Pattern] = []
    if full := histogram.get(capacity):
        out.append(((capacity,), full))
    stock = Complements({n: c for n, c in histogram.items() if n < capacity}, capacity)
    for n in sorted(stock.left, reverse=True):
        if n in stock.left:
            for rest in stock.filling(capacity - n, n):
                if times := stock.times((n, *rest)):
                    stock.take((n, *rest), times)
                    out.append(((n, *rest), times))
                if n not in stock.left:
                    break
    return out + best_fit(stock.left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: equal pieces go into equal gaps many at a time."""
    gaps: dict[int, list[list]] = defaultdict(list)  # gap -> [pattern, count]
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            gap = min((g for g, some in gaps.items() if g >= n and some), default=None)
            if gap is None:
                each = min(capacity // n, left)
                opened = left // each
                gaps[capacity - each * n].append([(n,) * each, opened])
                left -= each * opened
                continue
            group = gaps[gap][-1]
            each = min(gap // n, left)
            filled = min(group[1], left // each)
            group[1] -= filled
            gaps[gap - each * n].append([group[0] + (n,) * each, filled])
            if not group[1]:
                gaps[gap].remove(group)
            left -= each * filled
    return [(tuple(p), c) for some in gaps.values() for p, c in some if c]


class Slots:
    """From (length, rank) to (sequence, offset)."""

    def __init__(self, patterns: list[Pattern]):
        rows, first = [], 0
        used: dict[int, int] = defaultdict(int)
        for lengths, count in patterns:
            offset = 0
            for n in lengths:
                rows.append((n << 44 | used[n], first - used[n], offset))
                used[n] += count
                offset += n
            first += count
        rows.sort()
        self.key, self.shift, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.sequences = first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 44) | rank, "right") - 1
        return rank + self.shift[at], self.offset[at]


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, made by their rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


_encoders: dict[str, object] = {}


@cache
def _library(path: str):
    """The library's own tokenizer, loaded where a text needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


forget += [_encoders.clear, _library.cache_clear]


def encoder(path: str):
    """texts -> lists of ids, as the tokenizers library gives them for this file with add_special_tokens=False.

    A plain byte-level BPE whose ids follow its merges is run by tiktoken from the same file, about five times as fast;
    the ids are the same. Texts in which an added token of the file occurs literally, and all texts under other files, go
    through tokenizers itself.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        simple = (
            model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        joined = [vocab.get(a + b, -1) for a, b in merges] if simple else []
        if simple and joined == sorted(set(joined)) and joined[0] >= 256:
            import public_tokenizers
            import tiktoken

            of = _byte_characters()
            added = [t["content"] for t in spec.get("added_tokens", [])]
            ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in added}
            fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            _encoders[path] = lambda texts: [_library(path).encode(t, add_special_tokens=False).ids if any(x in t for x in added) else fast.encode_ordinary(t) for t in texts]
        else:
            _encoders[path] = lambda texts: [e.ids for e in _library(path).encode_batch(texts, add_special_tokens=False)]
    return _encoders[path]


def tokenized_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text: str, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents with their end token, longer ones in pieces of
    `capacity` of which the first may be shorter; part (the task's number) and rank (0, 1, ... among its pieces of that
    length). No shuffle. Write it before use: another run may number other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .common import pieces

        encode, own_part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part, _, _ in pieces(batch, "text"):
                rows, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for k, got in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    all_ids = np.array([*got, end_id], "<u4")
                    cut, at, p = len(all_ids) % capacity or min(capacity, len(all_ids)), 0, 0
                    while at < len(all_ids):
                        own = all_ids[at:cut]
                        rows.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        rank.append(seen[len(own)])
                        seen[len(own)] += 1
                        if with_ids:
                            ids.append(own.astype(np.int32))
                        at, cut, p = cut, cut + capacity, p + 1
                cols = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                cols += [pa.array(np.full(len(rows), own_part, np.int32)), pa.array(rank, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), schema)


def first_ranks(counts: DataFrame) -> DataFrame:
    """(c_part, first): for each part an array by length - 1 of the number of pieces of that length in the parts before it."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return first.groupBy(F.col("part").alias("c_part")).agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("first"))


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all rows with sequence_id and offset; every sequence is gapless from 0 and at most `capacity` long.

    Pieces are ranked by their length where they are made and keep their place: a part's own ranks follow those of the
    parts before it, of which a table of at most `capacity` numbers a part tells. It is broadcast up to BROADCAST_ROWS
    rows, and joined by part beyond.
    """
    pieces_df = materialize(tokenized_pieces(df, tokenizer, capacity, end_id, id_col, text, with_ids), "pieces")
    counts = materialize(pieces_df.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots = Slots(plan(histogram, capacity))
    first = first_ranks(counts)
    first = F.broadcast(first) if counts.count() <= BROADCAST_ROWS else first
    columns = [c for c in pieces_df.columns if c not in ("part", "rank")]
    ranked = pieces_df.join(first, F.col("part") == F.col("c_part")).select(*columns, (F.col("rank") + F.element_at("first", F.col("length"))).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_length, at_rank = columns.index("length"), len(columns)
        for b in batches:
            sequence, offset = slots.find(b.column(at_length).to_numpy(), b.column(at_rank).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:at_rank], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    kept = [f for f in pieces_df.schema.fields if f.name in columns]
    return ranked.mapInArrow(lean(place), T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
