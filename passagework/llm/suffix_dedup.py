"""Removal of repeated byte strings: every byte that a `length`-byte string covers which also starts elsewhere.

Which windows (strings of `length` bytes) repeat is decided by merging Burrows-Wheeler transforms (bwt.py). What must be
merged together is found first, without loss: the anchor of a window is its k-gram of least hash (the rightmost of
equals), so equal windows have equal anchors, at the same distance. Windows in a row with one anchor make a stretch, the
text from the first one's start to the last one's end. Anchors that occur once in the corpus end here. Equal stretches
are summed up, with their number as weight, before they are shuffled by anchor. Stretches with one anchor, a few shards
of them at a time, are merged; the blocks of the merged order that have `length` symbols in common are the repeated
strings.

An anchor with more than HOT different stretches is split, by how far before the anchor a window starts, into PARTS ranges of
distances: the windows that start in a near range share the anchor with more bytes after it, those in a far one with more
bytes before it, and these longer grams are the new anchors. Each part is shorter, so stretches become equal and are summed
up, or fall apart by their surroundings. What stays hot is split again; when one distance is left an anchor is a whole
window, its stretches are all equal, and the splitting has ended: after 4 rounds at most, whatever the numbers.

Defined results: a null text counts as empty; texts shorter than a window lose nothing; matches never cross documents;
strings are judged on the input; rows with equal ids and texts are copies of each other and each lose what repeats;
an empty table gives none. Other columns than those named are not read by find_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bwt import Q, repeated_starts
from .common import discard, lean, materialize, mix, pieces, powers, prefix_sums, span_hash, text_or_empty

LENGTH, GRAM = 200, 50
#: Different stretches of an anchor that one merge takes, and symbols of a merge.
HOT, MERGE_SYMBOLS = 2048, 60_000
#: Ranges of distances that an anchor with more stretches is split into.
PARTS = 4
_SEGMENT = 1 << 23
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    y = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    y[:n] = x
    y = y.reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, anchor's hash, hash of the stretch, anchor's place in the stretch), places of
    windows counted from the row's start."""
    out: list[tuple[np.ndarray, ...]] = []
    step = _SEGMENT - length
    for begin in range(0, max(1, len(raw) - length + 1), step):  # places must fit 24 bits; windows overlap, not stretches
        part = raw[begin : begin + step + length - 1]
        if len(part) < length:
            break
        sums = prefix_sums(part)
        _, down = powers(len(sums))
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        least = sliding_min((h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), length - gram + 1)
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        window = np.arange(len(anchor))
        row = np.searchsorted(at, begin + window, "right") - 1
        ok = begin + window + length <= at[row + 1]
        anchor, window, row = anchor[ok], window[ok], row[ok]
        if not len(window):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(window)))
        lo = window[first]
        out.append((row[first], begin + lo - at[row[first]], count, h[anchor[first]], span_hash(sums, lo, lo + count + length - 1), anchor[first] - lo))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> (doc_id, key, anchors): one for each stretch."""
    for batch in batches:
        for part, raw, at in pieces(batch, "text"):
            row, _, _, anchor, _, _ = stretches(raw, at, length)
            edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(anchor.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "key", "anchors"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, anchors) -> the stretches of those anchors."""
    for batch in batches:
        for part, raw, at in pieces(batch, "text"):
            row, first, count, anchor, own, rel = stretches(raw, at, length)
            lists = part.column(3)
            wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.isin(_paired(anchor, row), _paired(wanted, of))
            row, first, count, anchor, own, rel = (x[keep] for x in (row, first, count, anchor, own, rel))
            if not len(row):
                continue
            data, begin = raw.tobytes(), at[row] + first
            text = [data[i:j] for i, j in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(first), pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(rel.astype(np.int32)), pa.array(text, pa.binary())],
                ["doc_id", "key", "first", "anchor", "own", "rel", "stretch"],
            )


def _paired(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(anchor + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _runs(offsets: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the bytes that windows at the sorted offsets cover."""
    if not len(offsets):
        return [], []
    gap = np.flatnonzero(offsets[1:] > offsets[:-1] + length)
    return offsets[np.concatenate([[0], gap + 1])].tolist(), (offsets[np.append(gap, len(offsets) - 1)] + length).tolist()


_FOUND = pa.schema([("anchor", pa.int64()), ("own", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _merge_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, own, stretch, weight) sorted by anchor, HOT of each at most -> covered runs of each stretch that has any. A
    stretch that stands alone has nothing to be merged with: its weight tells whether all of it repeats."""
    group: list[tuple] = []
    waiting: list[tuple] = []
    size, out = 0, []

    def solve() -> None:
        nonlocal size
        if waiting:
            string, offset = repeated_starts([r[2] for r in waiting], np.array([r[3] for r in waiting]), length)
            edges = np.concatenate([[0], np.flatnonzero(string[1:] != string[:-1]) + 1, [len(string)]])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if i == j:
                    continue
                k = int(string[i])
                out.append((waiting[k][0], waiting[k][1], *_runs(offset[i:j], length)))
        waiting.clear()
        size = 0

    def close() -> None:
        nonlocal size
        if len(group) == 1 and group[0][3] > 1:
            anchor, own, text, _ = group[0]
            out.append((anchor, own, [0], [len(text)]))
        elif len(group) > 1:
            own = sum(len(r[2]) + 1 for r in group)
            if size + own > MERGE_SYMBOLS:
                solve()
            waiting.extend(group)
            size += own
        group.clear()

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)
            out.clear()

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and r[0] != group[0][0]:
                close()
                yield from flush(4096)
            group.append(r)
    close()
    solve()
    yield from flush(1)


def _hash(*parts: bytes) -> int:
    h = blake2b(digest_size=8)
    for x in parts:
        h.update(x)
    return int.from_bytes(h.digest(), "little", signed=True)


_PART = ["old_anchor", "old_own", "weight", "shift", "anchor", "own", "rel", "near", "far", "stretch"]


def _parted(batches: Iterator[pa.RecordBatch], length: int, gram: int = GRAM) -> Iterator[pa.RecordBatch]:
    """Stretches (anchor, own, weight, rel, near, far, stretch) of windows that start near to far bytes before the anchor, which
    is at rel -> those of each of PARTS ranges of these distances, `shift` further on, under the longer anchors that its windows
    share."""
    whole = length - gram
    for batch in batches:
        out = []
        for anchor, own, weight, rel, near, far, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            edges = [near + (far + 1 - near) * k // PARTS for k in range(PARTS + 1)]
            for lo, hi in ((i, j - 1) for i, j in zip(edges[:-1], edges[1:], strict=True)):
                first, last = max(0, rel - hi), min(len(text) - length, rel - lo)
                if lo <= hi and first <= last:
                    part, shared = text[first : last + length], text[rel - lo : rel + gram + whole - hi]
                    out.append((anchor, own, weight, first, _hash(b"%d %d " % (lo, hi), shared), _hash(part), rel - first, lo, hi, part))
        if out:
            kinds = [pa.int64()] * 6 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], _PART)


def _hot(rows: DataFrame) -> DataFrame:
    """(h_anchor): anchors with more than HOT different stretches in rows (anchor, own)."""
    sizes = rows.select("anchor", "own").distinct().groupBy(F.col("anchor").alias("h_anchor")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(sizes.where(F.col("n") > HOT).select("h_anchor"), "hot")


def _merged(summed: DataFrame, length: int) -> DataFrame:
    """(f_anchor, f_own, runs) of the stretches that have any."""
    rows = summed.select("anchor", "own", "stretch", "weight").repartition("anchor").sortWithinPartitions("anchor", "own")
    found = materialize(rows.mapInArrow(lean(lambda b: _merge_groups(b, length)), "anchor long, own long, starts array<int>, ends array<int>"), "runs")
    return found.select(F.col("anchor").alias("f_anchor"), F.col("own").alias("f_own"), F.arrays_zip("starts", "ends").alias("runs"))


def find_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, runs): the covered runs (start, end) of every document that has any, as sorted arrays of structs, which
    may overlap and repeat; key is xxhash64 of the text."""
    if length < 2 * GRAM or length % Q:
        raise ValueError(f"length must be a multiple of {Q} and at least {2 * GRAM}")
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("key"), text_or_empty(text).alias("text")).where(F.octet_length("text") >= length)
    lists = materialize(docs.mapInArrow(lean(lambda b: _anchors(b, length)), f"doc_id {kind}, key long, anchors array<bigint>"), "lists")
    anchors = lists.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    wanted = anchors.join(often, "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors"))  # as many as a text has
    wanted = materialize(wanted.select(F.col("doc_id").alias("w_id"), F.col("key").alias("w_key"), "anchors"), "wanted")
    discard(lists)
    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("doc_id", "key", "text", "anchors")
    cut = materialize(met.mapInArrow(lean(lambda b: _cut_out(b, length)), f"doc_id {kind}, key long, first long, anchor long, own long, rel int, stretch binary"), "stretches")
    places = cut.select("doc_id", "key", "first", "anchor", "own")
    of_group = [F.first(c).alias(c) for c in ("rel", "near", "far", "stretch")]
    rows = cut.withColumn("near", F.lit(0)).withColumn("far", F.lit(length - GRAM)).withColumn("weight", F.lit(1).cast("long"))
    out = None
    while True:
        hot = _hot(rows)
        split = not hot.isEmpty()
        cold = rows.join(hot, F.col("anchor") == F.col("h_anchor"), "left_anti") if split else rows
        runs = _merged(cold.groupBy("anchor", "own").agg(F.sum("weight").alias("weight"), F.first("stretch").alias("stretch")), length)
        here = places.join(runs, (F.col("anchor") == F.col("f_anchor")) & (F.col("own") == F.col("f_own"))).select("doc_id", "key", "first", "runs")
        out = here if out is None else out.unionByName(here)
        if not split:
            break
        parts = rows.join(hot, F.col("anchor") == F.col("h_anchor"), "left_semi").groupBy("anchor", "own").agg(F.sum("weight").alias("weight"), *of_group)
        names = ["anchor", "own", "weight", "rel", "near", "far", "stretch"]
        rows = materialize(parts.select(names).mapInArrow(lean(lambda b: _parted(b, length)), "old_anchor long, old_own long, weight long, shift long, anchor long, own long, rel int, near int, far int, stretch binary"), "parts")
        moves = rows.select("old_anchor", "old_own", "shift", F.col("anchor").alias("n_anchor"), F.col("own").alias("n_own"))
        moved = places.join(moves, (F.col("anchor") == F.col("old_anchor")) & (F.col("own") == F.col("old_own")))
        places = materialize(moved.select("doc_id", "key", (F.col("first") + F.col("shift")).alias("first"), F.col("n_anchor").alias("anchor"), F.col("n_own").alias("own")), "places")
    flat = F.transform("runs", lambda r: F.struct((r["starts"] + F.col("first")).alias("start"), (r["ends"] + F.col("first")).alias("end")))
    return out.groupBy("doc_id", "key").agg(F.array_sort(F.flatten(F.collect_set(flat))).alias("runs"))  # as many as a text has


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching runs of the same bytes; starts are sorted."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def whole_characters(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans, nor those of characters that a span's edge cuts in two."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(texts, starts, ends, strict=True):
            if a is None or not len(a):
                out.append(t)
                continue
            data, at, parts = t.encode(), 0, []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                while i > at and data[i] & 0xC0 == 0x80:
                    i -= 1
                while j < len(data) and data[j] & 0xC0 == 0x80:
                    j += 1
                parts.append(data[at:i])
                at = j
            out.append(b"".join([*parts, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    return left(text, spans["start"], spans["end"])


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of df, with _kept (binary, the remaining bytes), _n_bytes, _n_removed and _spans (the removed runs)."""
    from pyspark.sql import types as T

    runs = find_repeats(df, length, id_col, text).select(F.col("doc_id").alias("_r_id"), F.col("key").alias("_r_key"), F.col("runs").alias("_runs"))
    joined = df.join(runs, F.col(id_col).eqNullSafe(F.col("_r_id")) & (F.xxhash64(text_or_empty(text)) == F.col("_r_key")), "left").drop("_r_id", "_r_key")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [*df.schema.fields, T.StructField("_kept", T.BinaryType()), T.StructField("_n_bytes", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_spans", span)]
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in pieces(batch, text):
                kept, removed, spans = [], [], []
                for k, own in enumerate(part.column(width)):
                    data = raw[at[k] : at[k + 1]]
                    if not own.is_valid:
                        kept.append(data.tobytes())
                        removed.append(0)
                        spans.append([])
                        continue
                    values = own.values
                    a, b = union_of(values.field(0).to_numpy(), values.field(1).to_numpy())
                    edges = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(data)]])
                    kept.append(b"".join(data[i:j].tobytes() for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
                    removed.append(int((b - a).sum()))
                    spans.append([{"start": int(i), "end": int(j)} for i, j in zip(a, b, strict=True)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(kept, pa.binary()), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, kind)], [f.name for f in fields])

    return joined.mapInArrow(lean(run), T.StructType(fields))

