"""Convolutional text classifier for toxicity, trained in numpy.

Words are runs of letters, digits and non-ASCII bytes, lower-cased. A word's embedding is the sum of the table's rows for
its hash and for those of its first 3, 4, 5 and 7 characters, so inflected forms share what was learned, and a chance
collision in one row leaves the others. Filters of several widths run over the whole text,
each is max-pooled, and a linear layer gives the logit. It is shifted so that 0.5 is the best cut on calibration rows;
languages with enough of these get thresholds of their own. Language, source, labels and ids are no input of a score.

Trained on all labelled rows but every CALIBRATE-th of a label, by hashes of ids, which calibrate. The rows are dealt over parts
of bounded size by such a hash; in each round a task trains the model on a part's rows, and the changes are averaged, those of a row
of the table over the parts that changed it. The driver gets these averages alone, which have a fixed size. The cuts are exact
over all calibration rows and are found by grouping and windows. Every row is scored, whole, without a shuffle. Defined results: a null text is scored as an empty one, which has the
score of pooled zeros; labels that are null are no labels, and a document with several counts as toxic if one says so; a
null language gets the common threshold; without two kinds of labels every score is the share of toxic ones (0 if none).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, discard, lean, materialize, mix, prefix_sums, span_hash, text_or_empty

#: Rows and text bytes of a part, about; rounds over all rows; what changes are rounded to, so that their sums are exact.
PART_ROWS, PART_BYTES, EPOCHS, UNIT = 12_000, 64 << 20, 5, 2.0**-32
WIDTHS, FILTERS, DIM, ROWS = (1, 2, 3), 12, 12, 1 << 18
#: Characters of the beginnings of a word that have rows of their own, and all rows of a word.
BEGINNINGS = (3, 4, 5, 7)
PARTS = 1 + len(BEGINNINGS)
#: One of so many rows of a label calibrates and isn't trained on; toxic rows that a language needs for its own threshold.
CALIBRATE, LEAST = 5, 25

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def word_rows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PARTS x words): rows of the table for every word, and the words' offsets by text."""
    n = len(raw)
    if not n:
        return np.zeros((PARTS, 0), np.int32), np.zeros(len(at), np.int64)
    solid = IN_WORD[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(LOWER[raw])
    lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), [n] * max(BEGINNINGS))  # where characters start
    begin = np.searchsorted(lead, starts)
    out = np.empty((PARTS, len(starts)), np.int32)
    for k, chars in enumerate((None, *BEGINNINGS)):
        upto = ends if chars is None else np.minimum(lead[begin + chars], ends)
        h = mix(span_hash(sums, starts, upto) + np.uint64(chars or 1))
        out[k] = (h & np.uint64(ROWS - 1)).astype(np.int32)
    return out, np.searchsorted(starts, at)


class Progress:
    """Sums of squared gradients: of the table's rows, the dense parameters, the last bias."""

    def __init__(self, model: Model):
        self.squares = np.full(ROWS, 1e-3, np.float32)
        self.sums = [np.full_like(p, 1e-2) for p in model.dense()]
        self.bias = 1e-2


class Model:
    """Table, filters and output weights; offset is added to the logit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.03, (ROWS, DIM)).astype(np.float32)
        self.filters = [r.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.4, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.offset = 0.0
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}
        self.progress: Progress | None = None

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out]

    def convolved(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Padded embeddings, the places of the words in them, activations by width, and the texts' starts."""
        pad = max(WIDTHS)
        n = np.diff(at)
        starts = at[:-1] + pad * np.arange(len(n))
        place = np.arange(at[-1]) + pad * np.repeat(np.arange(len(n)), n)
        x = np.zeros((at[-1] + pad * len(n) + pad, DIM), np.float32)
        own = self.table[rows[0]]
        for k in rows[1:]:
            own += self.table[k]
        x[place] = own
        size = at[-1] + pad * len(n)
        after = np.ones(size, bool)  # the padding after a text, from where a window could reach into the next one
        after[place] = False
        acts = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            z = x[:size] @ f[0]
            for j in range(1, w):
                z += x[j : size + j] @ f[j]
            z[after] = 0
            acts.append(z)
        return x, place, acts, starts

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        _, _, acts, starts = self.convolved(rows, at)
        pooled = np.concatenate([np.maximum(np.maximum.reduceat(z, starts, axis=0) + c, 0) for z, c in zip(acts, self.bias, strict=True)], axis=1)
        return pooled.astype(np.float64) @ self.out + float(self.out_bias) + self.offset

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*word_rows(raw, at)), -30, 30)))

    def train(self, docs: list[np.ndarray] | Texts, y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.08, seed: int | list[int] = 11) -> None:
        """Adagrad on the log loss, from where `progress` is. Only the windows that were the maximum get a gradient."""
        r = np.random.default_rng(seed)
        self.progress = self.progress or Progress(self)
        squares, sums, params = self.progress.squares, self.progress.sums, self.dense()
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                own = [docs[k] for k in some.tolist()]
                rows = np.concatenate(own, axis=1)
                at = np.concatenate([[0], np.cumsum([x.shape[1] for x in own])]).astype(np.int64)
                x, place, acts, starts = self.convolved(rows, at)
                stops = np.append(starts[1:], len(acts[0]))
                tops = [np.stack([z[s:e].argmax(axis=0) + s for s, e in zip(starts, stops, strict=True)]) for z in acts]
                raw = [np.take_along_axis(z, p, axis=0) + c for z, p, c in zip(acts, tops, self.bias, strict=True)]
                pooled = np.concatenate([np.maximum(v, 0) for v in raw], axis=1)
                logit = pooled @ self.out + self.out_bias
                g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y[some]) / len(some)
                back = g[:, None] * self.out
                grads_f, grads_b, moved_at, moved = [], [], [], []
                for k, w in enumerate(WIDTHS):
                    d = (back[:, k * FILTERS : (k + 1) * FILTERS] * (raw[k] > 0)).astype(np.float32)
                    gf = np.zeros_like(self.filters[k])
                    for j in range(w):
                        seen = x[tops[k] + j]
                        gf[j] = np.einsum("bf,bfd->df", d, seen)
                        moved_at.append((tops[k] + j).ravel())
                        moved.append((d[:, :, None] * self.filters[k][j].T).reshape(-1, DIM))
                    grads_f.append(gf)
                    grads_b.append(d.sum(axis=0))
                grads = [*grads_f, *grads_b, g.astype(np.float32) @ pooled]
                word_of = np.full(len(x), -1, np.int64)
                word_of[place] = np.arange(len(place))
                where, change = word_of[np.concatenate(moved_at)], np.concatenate(moved)
                real = (where >= 0) & change.any(axis=1)
                ids, inverse = np.unique(rows[:, where[real]].ravel(), return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse, np.tile(change[real], (PARTS, 1)))
                squares[ids] += (total**2).sum(axis=1)
                self.table[ids] -= rate * total / np.sqrt(squares[ids])[:, None]
                for p, s, gr in zip(params, sums, grads, strict=True):
                    s += gr**2
                    p -= rate * 0.5 * gr / np.sqrt(s)
                self.progress.bias += float(g.sum()) ** 2
                self.out_bias -= np.float32(rate * 0.5 * g.sum() / np.sqrt(self.progress.bias))

    def state(self) -> np.ndarray:
        """(n x DIM + 1): the table's rows with their sums of squares, then all else that training changes."""
        return np.concatenate([np.column_stack([self.table, self.progress.squares]), self.rest()])

    def rest(self) -> np.ndarray:
        flat = np.concatenate([np.ravel(x) for x in (*self.dense(), self.out_bias, *self.progress.sums, self.progress.bias)]).astype(np.float32)
        return np.pad(flat, (0, -len(flat) % (DIM + 1))).reshape(-1, DIM + 1)

    def moved(self, rows: np.ndarray, by: np.ndarray) -> None:
        """Adds changes to these rows of the state."""
        of_table = rows < ROWS
        self.table[rows[of_table]] += by[of_table, :DIM]
        self.progress.squares[rows[of_table]] += by[of_table, DIM]
        new = self.rest()
        new[rows[~of_table] - ROWS] += by[~of_table]
        rest = iter(np.split(new.ravel(), np.cumsum([x.size for x in (*self.dense(), self.out_bias, *self.progress.sums)])))
        for x in self.dense():
            x[...] = next(rest).reshape(x.shape)
        self.out_bias = np.float32(next(rest)[0])
        for x in self.progress.sums:
            x[...] = next(rest).reshape(x.shape)
        self.progress.bias = float(next(rest)[0])


def best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit, midway between two rows', from which calling a row toxic gives the best F1."""
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(y[order] * weight[order])
    called = np.cumsum(weight[order])
    f1 = 2 * hit / (called + (y * weight).sum())
    sorted_logit = logit[order]
    f1[:-1][sorted_logit[:-1] == sorted_logit[1:]] = -1  # equal rows are called alike
    k = int(f1.argmax())
    return float(sorted_logit[k] if k + 1 == len(order) else (sorted_logit[k] + sorted_logit[k + 1]) / 2)


class Vocabulary:
    """Distinct words, with the table's rows of each; texts are kept as the words' numbers, a fifth of the memory."""

    def __init__(self):
        self.keys, self.numbers, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int32), []
        self.size = 0

    def numbered(self, rows: np.ndarray) -> np.ndarray:
        """The words' numbers. Words with three equal rows count as equal."""
        key = rows[0].astype(np.int64) | rows[2].astype(np.int64) << 20 | rows[-1].astype(np.int64) << 40
        own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == own
        number = np.empty(len(own), np.int32)
        number[known] = self.numbers[at[known]]
        fresh = np.flatnonzero(~known)
        number[fresh] = self.size + np.arange(len(fresh), dtype=np.int32)
        self.size += len(fresh)
        self.parts.append(rows[:, first[fresh]])
        self.keys, self.numbers = np.insert(self.keys, at[fresh], own[fresh]), np.insert(self.numbers, at[fresh], number[fresh])
        return number[inverse]

    def table(self) -> np.ndarray:
        return np.concatenate([np.zeros((PARTS, 0), np.int32), *self.parts], axis=1)


class Texts:
    """A list of texts, each as (PARTS x words) when it is asked for."""

    def __init__(self, docs: list[np.ndarray], table: np.ndarray):
        self.docs, self.of = docs, table

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.of[:, self.docs[k]]


def _changes(model: Model, epochs: int, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, text, y) sorted by part -> for each part, what training on it changes in rows of the state, in UNITs."""

    def learned(part: int, docs: list[np.ndarray], y: list[int], words: Vocabulary) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(model)
        before = own.state()
        own.train(Texts(docs, words.table()), np.array(y, np.float32), epochs, seed=[11, number, part])
        by = own.state() - before
        rows = np.flatnonzero(by.any(axis=1) | (np.arange(len(by)) >= ROWS))
        for i in range(0, len(rows), 1 << 14):
            some = rows[i : i + (1 << 14)]
            columns = np.rint(by[some] / np.float64(UNIT)).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in columns]], _STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        now, docs, y, words = None, [], [], Vocabulary()
        for batch in batches:
            for some, raw, at in pieces(batch, "text"):
                rows, first = word_rows(raw, at)
                number_of = words.numbered(rows)
                for k, (part, label) in enumerate(zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    if part != now:
                        if docs:
                            yield from learned(now, docs, y, words)
                        now, docs, y, words = part, [], [], Vocabulary()
                        number_of = np.zeros(first[k], np.int32)
                        number_of = np.concatenate([number_of, words.numbered(rows[:, first[k] :])])
                    docs.append(number_of[first[k] : first[k + 1]].copy())
                    y.append(label)
        if docs:
            yield from learned(now, docs, y, words)

    return run


_STATE = ["row", *[f"c{k}" for k in range(DIM + 1)]]


def _round(rows: DataFrame, parts: int, model: Model, epochs: int, number: int) -> None:
    """One round of training on (l_id, h, text, y), which the model takes in."""
    dealt = rows.select(F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"), "text", "y", "h", "l_id")
    dealt = dealt.repartition(1 if parts == 1 else 4 * parts, "part").sortWithinPartitions("part", "h", "l_id").select("part", "text", "y")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _changes(shared.value, epochs, number)(batches)

    changed = dealt.mapInArrow(lean(run), ", ".join(f"{c} {'long' if k else 'int'}" for k, c in enumerate(_STATE)))
    mean = changed.groupBy("row").agg(*[(F.sum(c) * F.lit(UNIT) / F.count(F.lit(1))).cast("float").alias(c) for c in _STATE[1:]])
    got = mean.toArrow()
    model.moved(got["row"].to_numpy(), np.column_stack([got[c].to_numpy() for c in _STATE[1:]]))
    shared.destroy()


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, y, logit) of (lang, y, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        for batch in batches:
            for some, raw, at in pieces(batch, "text"):
                own, first = word_rows(raw, at)
                # each by itself, as sums in a batch depend on what else is in it
                logit = [float(shared.value.logits(own[:, i:j], np.array([0, j - i]))[0]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(logit, pa.float64())], ["lang", "y", "logit"])

    return rows.select("lang", "y", "text").mapInArrow(lean(run), "lang string, y int, logit double")


def cuts(judged: DataFrame) -> dict[str | None, float]:
    """best_cut() of all of (lang, y, logit), whose key is None, and of each language with LEAST rows of both labels; without a
    group being gathered: rows of a logit are one row, and ranges of logits are counted before the places in them are."""
    # beside all rows, a row for each language
    named = judged.where("lang <> ''").select("lang", "y", "logit")
    each = judged.select(F.lit(None).cast("string").alias("lang"), "y", "logit").unionByName(named)
    counted = materialize(each.groupBy("lang", "logit").agg(F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("logit") * 64)), "logits")
    ahead = Window.partitionBy("lang").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("lang", "bin").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    everywhere = Window.partitionBy("lang")
    bins = bins.select(F.col("lang").alias("b_lang"), F.col("bin").alias("b"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("hit", "n")], F.sum("hit").over(everywhere).alias("ones"), F.sum("n").over(everywhere).alias("rows"))
    bins = bins.where("b_lang is null").unionByName(bins.where((F.col("ones") >= LEAST) & (F.col("rows") - F.col("ones") >= LEAST) & F.col("b_lang").isNotNull()))
    inside = Window.partitionBy("lang", "bin").orderBy(F.col("logit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(bins, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("bin") == F.col("b")))
    hit, called = F.col("hit_ahead") + F.sum("hit").over(inside), F.col("n_ahead") + F.sum("n").over(inside)
    best = placed.withColumn("f1", 2 * hit / (called + F.col("ones"))).groupBy("lang").agg(F.max(F.struct("f1", "logit"))["logit"].alias("logit"))
    top = {r.lang: r.logit for r in best.collect()}
    under = F.lit(None).cast("double")
    for lang, logit in top.items():  # a number for each language
        under = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(logit)).otherwise(under)
    after = {r.lang: r.next for r in counted.where(F.col("logit") < under).groupBy("lang").agg(F.max("logit").alias("next")).collect()}
    discard(counted)
    return {lang: (logit + after.get(lang, logit)) / 2 for lang, logit in top.items()}


def _split(known: DataFrame) -> DataFrame:
    """(l_id, y) -> (l_id, y, h, held): by the order of ids' hashes every CALIBRATE-th row of a label is held, counted by ranges
    of hashes."""
    h = known.withColumn("h", F.xxhash64("l_id")).withColumn("b", F.shiftright("h", 52))
    before = Window.partitionBy("y").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    first = h.groupBy("y", "b").count().select(F.col("y").alias("f_y"), F.col("b").alias("f_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("y", "b").orderBy("h", "l_id")) - 1
    placed = h.withColumn("place", place).join(F.broadcast(first), (F.col("y") == F.col("f_y")) & (F.col("b") == F.col("f_b")))
    return placed.select("l_id", "y", "h", ((F.col("place") + F.col("first")) % CALIBRATE == 0).alias("held"))


def fit(df: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "toxic") -> Model:
    """A model from all labelled rows of df; `trainable`, on the id, says which labels may be seen."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("l_id").isNotNull())
    if trainable is not None:
        known = known.where(trainable)
    known = _split(known.groupBy("l_id").agg(F.max("y").alias("y")))
    docs = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text).cast("string").alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    # of several rows with one id the least text is taken
    one = docs.join(known, F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min(F.struct("text", "lang")).alias("row"), *[F.max(c).alias(c) for c in ("h", "y", "held")])
    rows = materialize(one.select("l_id", "h", "row.text", "row.lang", "y", "held"), "labelled")
    told = {r.y: r for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("held"), F.sum(F.octet_length("text")).alias("size")).collect()}
    model = Model()
    if len(told) < 2:
        model.constant = 30.0 if 1 in told else -30.0
        return model
    split = all(0 < r.held <= r.n - CALIBRATE for r in told.values())
    learn, judge = (rows.where("not held"), rows.where("held")) if split else (rows, rows)
    parts = max(1, -(-sum(r.n for r in told.values()) // PART_ROWS), -(-sum(r.size for r in told.values()) // PART_BYTES))
    model.progress = Progress(model)
    # one part alone has no changes to put together before its end
    for k in range(1 if parts == 1 else EPOCHS):
        _round(learn, parts, model, EPOCHS if parts == 1 else 1, k)
    model.progress = None
    found = cuts(_judged(judge, model))
    discard(rows)
    model.offset = -found.pop(None)
    model.thresholds = {name: float(1 / (1 + np.exp(-np.clip(cut + model.offset, -30, 30)))) for name, cut in sorted(found.items())}
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row of df, whole texts; no shuffle. The model has a fixed size."""
    return with_score(df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), model, "text").select("doc_id", "score")


def with_score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of df and the score."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        own = shared.value
        for batch in batches:
            for part, raw, at in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.scores(raw, at))], [*part.schema.names, name])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def threshold_of(model: Model, lang: Column) -> Column:
    """The language's threshold, 0.5 where it has none."""
    out = F.lit(0.5)
    for name, cut in model.thresholds.items():
        out = F.when(lang == name, F.lit(cut)).otherwise(out)
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def keep_civil(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df, all columns, that score below their language's threshold."""
    model = fit(df, labels, None, id_col, text, lang)
    return with_score(df, model, text, "_score").where(F.col("_score") < threshold_of(model, F.col(lang))).drop("_score")
