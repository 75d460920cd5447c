"""Periodic runs of words, by an all-lag scan.

A run is a stretch of words with the smallest period q (words q apart are identical) and a length of at least
max(least, min_exp * q), which no neighbouring word extends. The words of a text become numbers; the array of numbers is
compared with itself at every shift q up to n / min_exp, and true stretches of at least max(least, min_exp * q) - q places
are runs of that period. A stretch that several periods have is a run of its smallest one: of runs of at least four periods
the others are multiples of it and begin and end at the same words.

Every document is scanned over ranges of lags: one for each RANGE_BYTES of its text, so a range's work grows with the
text, not with its square. Ranges of one document are dealt to different tasks, and their runs are put together again;
a document with one range is done where it is read.

Defined results: a null text counts as empty; texts without words have no runs and an empty rest; every row has one result,
repeated rows, equal and null ids each; an empty table gives none. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_or_empty

#: Text bytes of a document for each range of its lags.
RANGE_BYTES = 1 << 16
#: Places that are compared at once.
STEP = 1 << 19

Rewrite = Callable[[object, list[bytes]], list[bytes]]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULT = f"runs {RUNS}, start long, length long, period long, exponent_milli long, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    known: dict[bytes, int] = {}
    out = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    return out.astype(np.int16) if len(known) < 1 << 15 else out


def lag_range(n: int, part: int, parts: int, min_exp: int) -> tuple[int, int]:
    """The lags [from, to) of a part of all lags 1 to n / min_exp."""
    most = n // min_exp
    return 1 + most * part // parts, 1 + most * (part + 1) // parts


def stretches(ids: np.ndarray, lags: tuple[int, int], min_exp: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period): the maximal stretches of at least max(least, min_exp * lag) words whose words at these lags
    are identical."""
    n, (first, last) = len(ids), lags
    if n < least or first >= last:
        return []
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.full(last, -1, ids.dtype)]), n)
    out: list[tuple[int, int, int]] = []
    step = max(1, STEP // n)
    for q in range(first, last, step):
        lag = np.arange(q, min(q + step, last))
        same = shifted[lag[0] : lag[-1] + 1] == ids
        need = np.maximum(least - lag, (min_exp - 1) * lag)
        bits = np.packbits(same, axis=1)
        enough = np.flatnonzero(np.bitwise_count(bits).sum(axis=1, dtype=np.int64) >= need)
        if not len(enough):
            continue
        edges = np.zeros((len(enough), n + 2), np.int8)
        edges[:, 1:-1] = same[enough]
        edges = np.diff(edges, axis=1)
        row, start = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        long = end - start >= need[enough][row]
        period = lag[enough][row[long]]
        out += zip(start[long].tolist(), (end[long] - start[long] + period).tolist(), period.tolist(), strict=True)
    return out


def primitive(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs among these stretches, by start and period: of equal stretches the one of the smallest period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, of equal ones the first, then the one of the smallest period."""
    best = None
    for r in runs:
        if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run has after its first period, joined by spaces."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(kept).tolist()).decode()


def _columns(told: list[tuple[list[bytes], list[tuple[int, int, int]]]]) -> list[pa.Array]:
    best = [greatest(runs) for _, runs in told]
    runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for _, runs in told], _RUNS)
    one = [pa.array([b and b[k] for b in best], pa.int64()) for k in range(3)]
    return [runs, *one, pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()), pa.array([collapsed(words, runs) for words, runs in told], pa.string())]


def _words(id_: object, text: str | None, rewrite: Rewrite | None) -> list[bytes]:
    words = (text or "").encode().split()  # at space and the controls 9 to 13
    return rewrite(id_, words) if rewrite else words


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            if part.num_rows:
                yield part, [c.to_pylist() for c in part.columns]


def repetition(df: DataFrame, min_exp: int = 4, least: int = 6, id_col: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """For each row: doc_id, its runs (start, length, period, in words; by start, then period), the start, length, period and
    exponent (in thousandths, rounded down) of the one with the greatest exponent, null if there is none, and the text without
    the repeats: words joined by one space. rewrite, if given, makes another list of words of a row's id and words first."""
    if min_exp < 4:
        raise ValueError("runs have four periods or more, or their smallest periods aren't told by their ends")
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    docs = docs.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(RANGE_BYTES)).cast("int")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (ids, texts) in _rows(batches):
            told = []
            for id_, t in zip(ids, texts, strict=True):
                words = _words(id_, t, rewrite)
                told.append((words, primitive(stretches(numbered(words), lag_range(len(words), 0, 1, min_exp), min_exp, least))))
            yield pa.RecordBatch.from_arrays([part.column(0), *_columns(told)], ["doc_id", "runs", "start", "length", "period", "exponent_milli", "collapsed"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                id_, digest, t, parts, part = (c[i].as_py() for c in batch.columns)
                words = _words(id_, t, rewrite)
                found = stretches(numbered(words), lag_range(len(words), part, parts, min_exp), min_exp, least)
                if found:
                    cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found))), pa.array([digest] * len(found), pa.int64()), *cols], ["doc_id", "digest", "start", "length", "period"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (ids, texts, found) in _rows(batches):
            told = [(_words(i, t, rewrite), primitive([(r["start"], r["length"], r["period"]) for r in runs or []])) for i, t, runs in zip(ids, texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *_columns(told)], ["doc_id", "runs", "start", "length", "period", "exponent_milli", "collapsed"])

    short = docs.where("parts = 1").select("doc_id", "text").mapInArrow(lean(whole), f"doc_id {kind}, {RESULT}")
    long = docs.where("parts > 1").withColumn("digest", F.xxhash64("text"))
    dealt = long.select("doc_id", "digest", "text", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition("doc_id", "digest", "part")
    found = dealt.mapInArrow(lean(ranges), f"doc_id {kind}, digest long, start long, length long, period long")
    by_text = found.groupBy(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest")).agg(F.collect_set(F.struct("start", "length", "period")).alias("found"))  # of one text
    met = long.join(by_text, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("doc_id", "text", "found")
    return short.unionByName(met.mapInArrow(lean(together), f"doc_id {kind}, {RESULT}"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run, and SHA-256 of the list of runs and of the text without repeats."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
