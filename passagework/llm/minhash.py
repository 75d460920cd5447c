"""One-permutation MinHash fingerprints: each shingle is hashed once and falls into one bin by its high bits; empty bins
are filled by optimal densification (each takes the value of a bin that a hash of its own number and of the attempt
picks, until that bin has one); the low-order bits of the values are packed. Likeness is the share of equal bins,
corrected for the 2**-bits that differing values agree by chance.

Defined results: a null text counts as empty; a text without words has the fingerprint "", like to itself (1) and to
nothing else (0); a text of fewer words than a shingle is one shingle, beside its shingles of characters. Equal texts have
equal fingerprints. Every row has one result: repeated rows, equal and null ids each, of which null ones come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, lean, mix, prefix_sums, span_hash, text_or_empty, words

BINS, LOW_BITS, SHINGLE = 512, 4, 5
#: Attempts of densification before a bin takes the first value of its row (under 1e-7 of bins, of texts with two shingles).
ATTEMPTS = 4096
#: Text bytes that a range of ids has, about, and ranges at most; beyond, ranges grow and are sorted with spilling.
RANGE_BYTES, RANGES = 8 << 20, 16_384
#: A word of more bytes counts as so many words of one character; texts of fewer characters have shingles of characters as well.
LONG_WORD, FEW = 24, 100

_odd = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles, and their offsets by row."""
    return sized_shingles(raw, at, size)[:2]


def sized_shingles(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles, their offsets by row, and the bytes of each shingle's words, 63 at most: the shorter the
    words, the more texts hold a shingle, as a rule."""
    starts, ends, first = words(raw, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.uint64)
    h = span_hash(prefix_sums(LOWER[raw]), starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(np.arange(len(n)), n)
    word = first[:-1][rows] + np.arange(offsets[-1]) - offsets[:-1][rows]
    last = first[1:][rows]
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    out, long = np.zeros(len(word), np.uint64), np.concatenate([[0], np.cumsum(ends - starts)])
    for j in range(size):
        out += np.where(word + j < last, padded[word + j] * _odd[j], np.uint64(0))
    n_bytes = long[np.minimum(word + size, last)] - long[word]
    return mix(out), offsets, np.minimum(n_bytes, 63).astype(np.uint64)


def features(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what likeness counts, and their offsets by row: word shingles, where a long word (text without spaces) is
    taken character by character, and for short texts the shingles of `size` characters as well."""
    plain, offsets = shingle_hashes(raw, at, size)
    starts, ends, first = words(raw, at)
    n_words = np.diff(first)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    n_chars = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at])
    short = (n_chars < FEW) & (n_words > 0)
    other = short.copy()
    other[row_of[ends - starts > LONG_WORD]] = True
    out = [plain[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    for k in np.flatnonzero(other).tolist():
        data = LOWER[raw[at[k] : at[k + 1]]]
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
        edges = np.append(lead, len(data))
        tokens = []
        for s, e in zip((starts[first[k] : first[k + 1]] - at[k]).tolist(), (ends[first[k] : first[k + 1]] - at[k]).tolist(), strict=True):
            if e - s <= LONG_WORD:
                tokens.append((s, e))
            else:
                i, j = np.searchsorted(lead, [s, e])
                tokens += zip(lead[i:j].tolist(), edges[i + 1 : j + 1].tolist(), strict=True)
        sums = prefix_sums(data)
        h = span_hash(sums, *np.array(tokens, np.int64).T)
        n = max(1, len(h) - size + 1)
        own = np.zeros(n, np.uint64)
        for j in range(min(size, len(h))):
            own += h[j : j + n] * _odd[j]
        own = mix(own)
        if short[k]:
            width = min(size, len(lead))
            own = np.concatenate([own, mix(span_hash(sums, lead[: len(lead) - width + 1], edges[width:]) + np.uint64(3))])
        out[k] = own
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]).astype(np.int64)


_picks: dict[int, np.ndarray] = {}


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Values of a row's empty bins from its filled ones; rows without any stay as they are."""
    bins = values.shape[1]
    one = filled.argmax(axis=1)
    out = np.where(filled, values, 0)
    single = filled.sum(axis=1) == 1
    out[single] = values[single, one[single]][:, None]
    row, col = np.nonzero(~filled & (filled.any(axis=1) & ~single)[:, None])
    for attempt in range(ATTEMPTS):
        if not len(row):
            break
        if attempt not in _picks:
            _picks[attempt] = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        source = _picks[attempt][col]
        ok = filled[row, source]
        out[row[ok], col[ok]] = values[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    out[row, col] = values[row, one[row]]
    return out


def sketch(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE, bins: int = BINS, low_bits: int = LOW_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bins) low-order bits, and which rows have a shingle."""
    hashes, offsets = features(raw, at, size)
    n, shift = len(at) - 1, int(bins).bit_length() - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    values = np.full(n * bins, np.uint64(2**64 - 1))
    np.minimum.at(values, rows * bins + (hashes >> np.uint64(64 - shift)).astype(np.int64), hashes << np.uint64(shift))
    values = values.reshape(n, bins)
    filled = values != np.uint64(2**64 - 1)
    low = (mix(values) & np.uint64((1 << low_bits) - 1)).astype(np.uint8)
    return densify(low, filled), filled.any(axis=1)


def packed(low: np.ndarray, has: np.ndarray, low_bits: int = LOW_BITS) -> list[str]:
    """Hex strings of the packed bits; "" for rows without shingles."""
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - low_bits :].reshape(len(low), -1)
    return [r.tobytes().hex() if ok else "" for r, ok in zip(np.packbits(bits, axis=1), has.tolist(), strict=True)]


def unpacked(fingerprint: str, bins: int = BINS, low_bits: int = LOW_BITS) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8))[: bins * low_bits].reshape(bins, low_bits)
    return np.packbits(np.pad(bits, ((0, 0), (8 - low_bits, 0))), axis=1).ravel()


def likeness(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray, low_bits: int = LOW_BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the rows' shingles, from 0 to 1."""
    chance = 2.0**-low_bits
    got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_has & b_has, got, (a_has == b_has).astype(float))


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pa.array(texts, pa.large_string()))


def with_next(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (b, guest, none, doc_id, h, text) in ranges b of descending ids, sorted; each range ends with a guest: the row
    that comes after its last one (after the very last: the first row). Rows with equal ids go by h, the text's hash; null
    ids come last (none). An id that fills several ranges by itself, or null, is split into them by h.

    At most RANGES ranges reach the driver and the workers; each text is shuffled once, the first of a range twice.
    """
    key = F.col(id_col).cast("long")
    rows = df.select(key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("h"), text_or_empty(text).alias("text"))
    weight = F.octet_length("text") + 64
    size, loose = rows.agg(F.sum(weight), F.sum(F.when(F.col("none"), weight))).first()
    of = lambda part, least: min(RANGES, max(least, int((part or 0) // RANGE_BYTES)))
    ranges, null_parts = of(size, 16), of(loose, 1)
    cuts = rows.where("not none").select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    limit = float(1 << 63)
    ends, times = np.unique(np.array([int(min(max(c, -limit), limit - 1024)) for c in cuts], np.int64), return_counts=True)
    # descending: ids above the last end, then for each end the ids up to it and above the one before; null ids
    parts = np.concatenate([[1], times[::-1], [null_parts]])
    first = np.concatenate([[0], np.cumsum(parts)])

    def place(none: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.where(none, len(parts) - 1, len(ends) - np.searchsorted(ends, ids, "left"))
        # only an end itself is split: the ids below it, which come later, go with its last part
        share = ((h.astype(np.float64) / 2.0**64 + 0.5) * parts[at]).astype(np.int64)
        share = np.minimum(share, parts[at] - 1)
        if len(ends):
            own_end = ~none & (ids == ends[np.clip(len(ends) - at, 0, len(ends) - 1)])
            share = np.where(none | own_end, share, parts[at] - 1)
        return first[at] + share

    @F.pandas_udf("int")
    def range_of(none: pd.Series, ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place(none.to_numpy(bool), ids.to_numpy(np.int64), h.to_numpy(np.int64)))

    placed = rows.withColumn("b", range_of("none", "doc_id", "h"))
    head = F.min(F.struct("none", F.bitwise_not("doc_id").alias("down"), "h")).alias("head")  # ~x turns the order and never overflows
    heads = placed.select("b", "none", "doc_id", "h").groupBy("b").agg(head).orderBy("b").collect()  # RANGES + RANGES rows at most
    used = np.array([r["b"] for r in heads], np.int64)
    known = [np.array([r["head"][c] for r in heads]) for c in ("none", "down", "h")]
    before = np.roll(used, 1)

    @F.pandas_udf("int")
    def guest_of(b: pd.Series, none: pd.Series, ids: pd.Series, h: pd.Series) -> pd.Series:
        at = np.searchsorted(used, b.to_numpy(np.int64))
        own = none.to_numpy(bool), ~ids.to_numpy(np.int64), h.to_numpy(np.int64)
        is_head = np.logical_and.reduce([x == k[at] for x, k in zip(own, known, strict=True)])
        return pd.Series(np.where(is_head, before[at], -1).astype(np.int32))

    held = placed.withColumn("guest_of", guest_of("b", "none", "doc_id", "h"))
    targets = F.when(F.col("guest_of") < 0, F.array(F.struct(F.col("b"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("b"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("b"), F.lit(True).alias("guest"))))
    dealt = held.withColumn("t", F.explode(targets)).select("t.b", "t.guest", "none", "doc_id", "h", "text")
    return dealt.repartition("b").sortWithinPartitions("b", "guest", "none", F.col("doc_id").desc(), "h", "text")


def fingerprints_with_edits(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of its edited text (the last third replaced from the next row by descending
    id), and the likeness of its fingerprint to the edited text's and to the next row's."""
    rows = with_next(df, id_col, text)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
        n = len(texts)
        low, has = sketch(*_bytes_of(texts + edited + nexts[-1:]))
        # a row's next is the row after it, but for the last and at the ends of ranges
        after = [i + 1 if i + 1 < n and nexts[i] is texts[i + 1] else 2 * n if i == n - 1 else -1 for i in range(n)]
        lone = [i for i in range(n) if after[i] < 0]
        if lone:
            more, more_has = sketch(*_bytes_of([nexts[i] for i in lone]))
            for k, i in enumerate(lone):
                after[i] = len(low) + k
            low, has = np.concatenate([low, more]), np.concatenate([has, more_has])
        hexed = packed(low[: 2 * n], has[: 2 * n])
        near_edited = likeness(low[:n], has[:n], low[n : 2 * n], has[n : 2 * n])
        near_next = likeness(low[:n], has[:n], low[after], has[after])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexed[:n]), pa.array(hexed[n:]), pa.array(near_edited), pa.array(near_next)],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        held: tuple | None = None  # a row that waits for its next
        for batch in batches:
            for part, _, _ in pieces(batch, "text"):
                ids, texts, nexts = [], [], []
                for b, guest, none, i, _, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held is not None:
                        if held[0] != b:
                            raise RuntimeError(f"the last row of range {held[0]} has no next")
                        ids.append(held[1])
                        texts.append(held[2])
                        nexts.append(t)
                    held = None if guest else (b, None if none else i, t)
                if ids:
                    yield emit(ids, texts, nexts)
        if held is not None:
            raise RuntimeError(f"the last row of range {held[0]} has no next")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(lean(run), schema)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        for batch in batches:
            for part, raw, at in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(*sketch(raw, at)))], ["doc_id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, fingerprint string")
