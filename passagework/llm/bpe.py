"""Byte-level BPE encoding and decoding with rank files, in padded numpy matrices.

Texts are split by the vocabulary's pattern; each distinct piece is encoded once for a batch and kept for the next ones.
Pieces are put into buckets of similar length, as rows of a padded matrix. In each round every row merges its leftmost
pair of least rank: the ranks of all pairs stand in a second matrix that a hashed pair lookup fills, rows without a pair
leave, and the matrix is compacted. Pieces beyond the widest bucket go through a heap of pairs, with the same result.

Defined results: a null or empty text has no ids and decodes to no bytes; equal rows have equal ids; ids out of range
or null in decode() raise. Whole texts are encoded, of any length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Widths of the matrices; longer pieces are merged through a heap.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)
#: Distinct pieces that a Python worker keeps; then it starts anew.
KEPT_PIECES = 400_000
NO_RANK = np.int32(2**31 - 1)

#: Unicode White_Space, which \s means in the patterns of rank files.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_spaces(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


class PairTable:
    """(left id, right id) -> id of the joined token, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 6))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        todo, slot = np.arange(len(keys)), self.slots(keys)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]
            mine = self.keys[slot] == keys[todo]
            self.values[slot[mine]] = values[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        flat = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(len(flat), NO_RANK, np.int32)
        todo, slot = np.arange(len(flat)), self.slots(flat)
        while len(todo):
            found = self.keys[slot]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            todo, slot = todo[more], (slot[more] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks of tokens and the pattern that splits text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(plain_spaces(pattern)).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.pair_ranks = dict(zip(keys, values, strict=True))
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of byte ids padded with -1."""
        n, width = matrix.shape
        done: list[np.ndarray | None] = [None] * n
        who = np.arange(n)
        ids = matrix
        ranks = np.where(ids[:, 1:] >= 0, self.pairs.get(ids[:, :-1], np.maximum(ids[:, 1:], 0)), NO_RANK)
        steps = np.arange(width)
        while len(who):
            col = ranks.argmin(axis=1)
            best = ranks[np.arange(len(who)), col]
            over = best == NO_RANK
            if over.any():
                rows = ids[over]
                for k, row, size in zip(who[over].tolist(), rows, (rows >= 0).sum(axis=1).tolist(), strict=True):
                    done[k] = row[:size]
                on = ~over
                who, ids, ranks, col, best = who[on], ids[on], ranks[on], col[on], best[on]
                if not len(who):
                    break
            row = np.arange(len(who))
            ids[row, col] = best
            w = ids.shape[1]
            if w > 2:
                take = steps[: w - 1] + (steps[: w - 1] > col[:, None])
                ids = np.take_along_axis(ids, take, axis=1)
                take = steps[: w - 2] + (steps[: w - 2] > col[:, None])
                ranks = np.take_along_axis(ranks, np.minimum(take, w - 2), axis=1)
            else:
                for k, i in zip(who.tolist(), ids[:, 0], strict=True):
                    done[k] = np.array([i], np.int32)
                break
            for near in (col - 1, col):  # the pairs that the new token is in
                ok = (near >= 0) & (near < w - 2)
                r, c = row[ok], near[ok]
                right = ids[r, c + 1]
                ranks[r, c] = np.where(right >= 0, self.pairs.get(ids[r, c], np.maximum(right, 0)), NO_RANK)
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in time n log n."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.pair_ranks.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([x for x, live in zip(ids, alive, strict=True) if live], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(p) > WIDTHS[-1]:
                out[k] = self.merge_long(p).astype("<i4").tobytes()
            elif p:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(p)), []).append(k)
        for width, some in buckets.items():
            step = max(64, (1 << 21) // width)  # bounds the matrices, not the work
            for i in range(0, len(some), step):
                part = some[i : i + step]
                raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in part), np.uint8).reshape(-1, width)
                sizes = np.array([len(pieces[k]) for k in part])
                matrix = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], np.int32(-1))
                for k, ids in zip(part, self.merge(matrix), strict=True):
                    out[k] = ids.astype("<i4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > KEPT_PIECES:
            self.cache.clear()
        new = list({w for ws in split for w in ws if w not in self.cache})
        self.cache.update(zip(new, self.encode_pieces([w.encode() for w in new]), strict=True))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in split]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after another."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id that the vocabulary doesn't have")
        starts, sizes = self.token_at[ids], self.token_at[ids + 1] - self.token_at[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(starts - (ends - sizes), sizes)
        return self.token_bytes[shift + np.arange(ends[-1])]


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Once for a Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary.from_file(path, pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `ids` (array<int>), the ids of the whole text; no shuffle. Other columns of df are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part, _, _ in pieces(batch, "text"):
                rows = vocab.encode([t or "" for t in part.column(1).to_pylist()])
                at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with `decoded` (binary): the bytes of the ids' tokens; no ids (or null) give no bytes."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                column = part.column(place)
                got = [vocab.decode(x.values.to_numpy(zero_copy_only=False)).tobytes() if x.is_valid else b"" for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, "decoded"])

    return df.mapInArrow(lean(run), schema)

