"""SimHash fingerprints and their links by the generalised pigeonhole principle.

Fingerprints: each text's lower-cased words in shingles, hashed by XXH64 (seed 42); a bit is set if it is in over half of
the hashes, repeats included.

Links: distinct fingerprints at `tau` or fewer differing bits. The bits are grouped into partitions, correlated ones
together. If thresholds t_i of m partitions sum to tau - m + 1, two linked fingerprints differ by at most t_i bits in
some partition i; a threshold of -1 leaves a partition out. Counts over all fingerprints estimate each partition's
candidates under each threshold, and dynamic programming allocates the thresholds (and chooses m) at the least sum.
Fingerprints probe the partitions' buckets, and candidates are verified inside each bucket, of which only a spanning set
of links leaves. Buckets of more than HOT members take an exact linear way instead: two of their members are linked if
and only if they have a common neighbour at ceil(tau / 2) bits, so each is sent to all its neighbours at that distance;
what meets there is verified.

Near duplicates by similarity (groups(), keep_one()): texts are equal, or their sets of 5-word shingles have a Jaccard
similarity of 0.8 or more, in chains. SimHash fingerprints over the sets of words, at WORD_TAU or fewer differing bits,
give families by the links above, and shared shingles give those that the fingerprints miss, without loss: under one order
of all shingles, two sets of n and m shingles at 0.8 have one in common among the first n - ceil(0.8 n) + 1 and
m - ceil(0.8 m) + 1 (the prefix filter). The order puts shingles that are frequent in a sample last, so few documents meet
by them; any order is right. Of shingles by which the same documents meet one is kept. Where HOT or fewer meet, they are
linked if the sizes allow 0.8 and if the parities of hashed bits differ in no more places than the sets may differ, both of
which every pair at 0.8 passes; where more meet, all are linked with the first of them, without a look at pairs.

Families are verified on sets of shingle hashes. Every member is compared with its family's first, in salted parts, which
settles nearly all; only those that are not similar to it (the rest) are compared with the others, in blocks of bounded
size: each block of the rest with each of the family.

Defined results: null or empty texts, or those without words, have the fingerprint zero; texts of fewer words than a
shingle are one shingle; rows with equal ids or texts are linked like any others, and a component's id is the least
non-null one of its rows. Empty tables give none. Columns other than those named are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, is_in, lean, marked, materialize, prefix_sums, span_hash, text_or_empty, words
from .components import components
from .minhash import sized_shingles

BITS, HOT = 64, 256


def shingle_spans(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text with single spaces between words, the starts and ends of the shingles in it, and their offsets by row."""
    starts, ends, first = words(raw, at)
    low = LOWER[raw]
    depth = np.zeros(len(raw) + 1, np.int32)
    depth[starts] += 1
    np.subtract.at(depth, ends, 1)
    inside = np.cumsum(depth)[:-1] > 0
    space = ~inside
    keep = inside.copy()
    keep[1:] |= space[1:] & inside[:-1]
    to = np.concatenate([[0], np.cumsum(keep)])
    text = np.where(space, np.uint8(32), low)[keep]
    s, e = to[starts], to[ends]
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(np.arange(len(n)), n)
    word = first[:-1][rows] + np.arange(offsets[-1]) - offsets[:-1][rows]
    last = np.minimum(word + size, first[1:][rows]) - 1
    return text, s[word], e[last], offsets


def fingerprints_of(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A uint64 for each row."""
    import xxhash

    text, s, e, offsets = shingle_spans(raw, at, size)
    out = np.zeros(len(at) - 1, np.uint64)
    if not len(s):
        return out
    data, f = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([f(data[i:j], 42) for i, j in zip(s.tolist(), e.tolist(), strict=True)], ">u8")
    has = np.flatnonzero(np.diff(offsets))
    step = 1 << 16  # bounds the matrix of bits
    counts = np.zeros((len(has), BITS), np.int64)
    row_of = np.repeat(np.arange(len(has)), np.diff(offsets)[has])
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].view(np.uint8).reshape(-1, 8), axis=1)
        own = row_of[i : i + step]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    over = counts * 2 > np.diff(offsets)[has][:, None]
    out[has] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        for batch in batches:
            for part, raw, at in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(raw, at, size).view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set; one small row leaves each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy().astype(">i8")
            for i in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["both"])

    parts = distinct.select("fp").mapInArrow(lean(run), "both array<double>")
    total = distinct.count()
    summed = parts.select(F.posexplode("both").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # BITS * BITS rows
    both = np.zeros(BITS * BITS)
    for r in summed:
        both[r["k"]] = r["v"]
    return total, both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; a partition grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        sub = corr[np.ix_(left, left)]
        own = [left[int(sub.max(axis=1).argmax())]]
        left.remove(own[0])
        while len(own) < width:
            best = max(left, key=lambda b: corr[b, own].mean())
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def candidate_estimates(n: int, both: np.ndarray, part: list[int], equal_pairs: float, tau: int) -> list[float]:
    """Estimated cost of thresholds -1, 0, ..., tau in this partition: probes and the candidates that they meet.

    equal_pairs: sum of squared bucket sizes, counted over all fingerprints. A bit that two fingerprints share with
    probability e lets 1 / e - 1 times as many pairs differ in it.
    """
    p = np.diag(both)[part] / max(n, 1)
    odds = 1 / np.maximum(p**2 + (1 - p) ** 2, 0.5) - 1
    symmetric = np.zeros(tau + 1)
    symmetric[0] = 1
    for x in odds:
        symmetric[1:] += x * symmetric[:-1].copy()
    costs, probes = [0.0], 0
    for t in range(tau + 1):
        probes += comb(len(part), t)
        costs.append(n * (probes + (t > 0)) + equal_pairs * symmetric[: t + 1].sum())
    return costs


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more, with the sum tau - m + 1 and the least total cost. costs[i][t + 1]: of t in partition i."""
    m = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of t + 1 so far, which must reach tau + 1
    for i in range(m):
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t in range(-1, tau + 1):
                if (s := total + t + 1) <= tau + 1 and (s not in now or cost + costs[i][t + 1] < now[s][0]):
                    now[s] = (cost + costs[i][t + 1], [*ts, t])
        best = now
    return best[tau + 1]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], least: int, most: int) -> list[int]:
    return [_signed(_mask(list(c))) for r in range(least, most + 1) for c in itertools.combinations(bits, r)]


def choose_partitions(distinct: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds for these fingerprints."""
    n, both = bit_statistics(distinct)
    plans = {m: group_bits(n, both, m) for m in range(max(1, (tau + 2) // 2), tau + 2)}
    masks = [(m, i, _signed(_mask(part))) for m, parts in plans.items() for i, part in enumerate(parts)]
    spread = distinct.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for m, i, x in masks])).alias("x")).select("x.*")
    equal = spread.groupBy("m", "i", "v").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()  # a row for each partition
    pairs = {(r.m, r.i): r.pairs for r in equal}
    choices = []
    for m, parts in plans.items():
        cost, ts = allocate([candidate_estimates(n, both, part, pairs.get((m, i), 0.0), tau) for i, part in enumerate(parts)], tau)
        choices.append((cost, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _outwards(rest: np.ndarray, linked) -> Iterator[tuple[np.ndarray, object]]:
    """(members, root): the connected components of `rest`, without their roots. linked(some, rest) marks what of rest is
    linked to any of some. Each member is compared once, with what no component holds yet, so large ones cost little."""
    while len(rest):
        root, queue, rest = rest[0], rest[:1], rest[1:]
        while len(queue) and len(rest):
            some, queue = queue[:64], queue[64:]
            hit = linked(some, rest)
            if hit.any():
                yield rest[hit], root
                queue, rest = np.concatenate([queue, rest[hit]]), rest[~hit]


def _verified(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket..., fp) sorted by bucket -> a spanning set of verified links of each bucket."""
    kept: list[np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        rows = kept
        if b is not None and b.num_rows:
            new = [c.to_numpy() for c in b.columns]
            rows = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
        if rows is None or not len(rows[0]):
            continue
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[:-1]], axis=0)) + 1
        begins = np.concatenate([[0], change])
        upto = begins[-1] if b is not None else len(rows[0])
        kept = [x[upto:] for x in rows]
        fp, ends = rows[-1].view(np.uint64), np.concatenate([change, [len(rows[0])]])
        whole = ends <= upto
        begins, ends = begins[whole], ends[whole]
        a, c = [], []
        two = ends - begins == 2
        x, y = fp[begins[two]], fp[begins[two] + 1]
        ok = np.bitwise_count(x ^ y) <= tau
        a.append(x[ok])
        c.append(y[ok])
        for i, j in zip(begins[ends - begins > 2].tolist(), ends[ends - begins > 2].tolist(), strict=True):
            own = np.unique(fp[i:j])
            if len(own) > 4 * HOT:
                for x, root in _outwards(own, lambda some, rest: np.bitwise_count(some[:, None] ^ rest).min(axis=0) <= tau):
                    a.append(x)
                    c.append(np.full(len(x), root))
                continue
            near = np.bitwise_count(own[:, None] ^ own) <= tau
            label = np.arange(len(own))
            while True:
                least = np.where(near, label, len(own)).min(axis=1)
                if (least == label).all():
                    break
                label = least
            moved = label != np.arange(len(own))
            a.append(own[moved])
            c.append(own[label[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, c)], ["a", "b"])


def _probes(distinct: DataFrame, tau: int) -> DataFrame:
    """(part, key, fp): every fingerprint in the buckets that it probes, its own included."""
    rows = None
    for i, (part, t) in enumerate(choose_partitions(distinct, tau)):
        key = F.col("fp").bitwiseAND(F.lit(_signed(_mask(part))))
        keys = F.array(*[key.bitwiseXOR(F.lit(x)) for x in _flips(part, 0, t)])
        own = distinct.select(F.lit(i).alias("part"), F.explode(keys).alias("key"), "fp")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def links(distinct: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (fp) which chains of links at tau bits or fewer connect."""
    rows = _probes(distinct, tau)
    radius = (tau + 1) // 2
    if sum(comb(BITS, r) for r in range(radius + 1)) > 100:
        # too many neighbours for the linear way: a large bucket is searched from its linked members outwards
        dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
        return dealt.mapInArrow(lean(lambda b: _verified(b, tau)), "a long, b long")
    sizes = rows.groupBy("part", "key").count().where("count > 1").select(F.col("part").alias("p"), F.col("key").alias("k"), (F.col("count") > HOT).alias("hot"))
    met = materialize(rows.join(sizes, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k"))).select("part", "key", "fp", "hot"), "buckets")
    cold = met.where("not hot").select("part", "key", "fp").repartition("part", "key").sortWithinPartitions("part", "key")
    out = cold.mapInArrow(lean(lambda b: _verified(b, tau)), "a long, b long")
    near = F.explode(F.transform(F.array(*[F.lit(x) for x in _flips(list(range(BITS)), 0, radius)]), lambda x: F.col("fp").bitwiseXOR(x))).alias("key")
    around = met.where("hot").select("fp").distinct().select(near, "fp").repartition("key").sortWithinPartitions("key")
    return out.unionByName(around.mapInArrow(lean(lambda b: _verified(b, tau)), "a long, b long"))


def near_duplicates(df: DataFrame, tau: int = 2, size: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least id that links of tau bits or fewer reach."""
    rows = materialize(fingerprints(df, size, id_col, text), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), tau)).select(F.col("node"), F.col("root"))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of near duplicates: differing bits of word-set fingerprints, words of a shingle, shingles of a block's documents (16 MB).
WORD_TAU, WORDS, BLOCK = 2, 5, 1 << 21
#: Documents of the sample that orders shingles, at least: it grows with the table, so that shingles of more than HOT documents
#: are found; occurrences in it that make one frequent, and frequent ones at most.
SAMPLE, FREQUENT, OFTEN = 20_000, 16, 1 << 20
#: Text bytes that are taken apart at once: 1 MB of them took 77 MB of a worker.
TEXT = 1 << 18
#: Bits of a set's parities, those of sets over LONG shingles, for which they would say little, and LONG.
PARITIES, MORE, LONG = 1024, 8192, 1200


def _word_sets(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of the set of each row's lower-cased words."""
    starts, ends, first = words(raw, at)
    out = np.zeros(len(at) - 1, np.uint64)
    if not len(starts):
        return out
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    h = span_hash(prefix_sums(LOWER[raw]), starts, ends)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    h, row = h[new], row[new]
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    size = np.diff(np.append(begins, len(h)))
    out[row[begins]] = np.packbits(counts * 2 > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_sets(raw: np.ndarray, at: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each row, ascending, those in `last` after the others, and their offsets by row. The high 6
    bits are by the shingle's length, so that long ones, of which few texts that aren't alike share one, come first."""
    h, offsets, long = sized_shingles(raw, at, WORDS)
    h = (np.uint64(63) - long) << np.uint64(58) | h >> np.uint64(6)
    row = np.repeat(np.arange(len(at) - 1), np.diff(offsets))
    late = np.zeros(len(h), bool) if last is None else is_in(h, last)
    order = np.lexsort((h, late, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(at) - 1))]).astype(np.int64)


def parities(h: np.ndarray, offsets: np.ndarray, width: int = PARITIES) -> np.ndarray:
    """(rows x width / 64) words: whether an odd number of a row's hashes falls on a bit. They differ in no more bits than
    the sets differ in members."""
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets)) * width + (h % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * width) & 1).astype(np.uint8).reshape(n, width)
    return np.packbits(odd, axis=1).view(np.uint64)


def _may_be_alike(n: np.ndarray, bits: np.ndarray, other_n: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """False only for sets whose similarity is under 0.8: at 0.8 the sets differ in a ninth of their sizes' sum at most."""
    differ = np.bitwise_count(bits ^ other_bits).sum(axis=-1, dtype=np.int64)
    return (5 * np.minimum(n, other_n) >= 4 * np.maximum(n, other_n)) & (9 * differ <= n + other_n)


def _words_of(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), PARITIES // 64)


class Marks:
    """Sizes and parities of sets: what tells, without loss, that two can't be similar."""

    def __init__(self, n: np.ndarray, bits: np.ndarray | list[bytes], more: list[bytes | None]):
        self.n = n
        self.bits = bits if isinstance(bits, np.ndarray) else _words_of(bits)
        long = [k for k, x in enumerate(more) if x]
        self.more = np.frombuffer(b"".join(more[k] for k in long), np.uint64).reshape(len(long), MORE // 64)
        self.at = np.full(len(n), -1)
        self.at[long] = np.arange(len(long))

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sets x and y (indices, pairwise; or one x) may be at 0.8 or more."""
        out = _may_be_alike(self.n[x], self.bits[x], self.n[y], self.bits[y])
        both = np.flatnonzero(out & (self.at[x] >= 0) & (self.at[y] >= 0))
        if len(both):
            x, y = np.broadcast_to(x, out.shape)[both], y[both]
            out[both] = _may_be_alike(self.n[x], self.more[self.at[x]], self.n[y], self.more[self.at[y]])
        return out

    def outwards(self, rest: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(members, root) of the components of these sets by what may be alike."""

        def linked(some: np.ndarray, rest: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rest), bool)
            for x in some:
                left = np.flatnonzero(~out)
                out[left] = self.alike(x, rest[left])
            return out

        return _outwards(rest, linked)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that occur in FREQUENT or more of the sampled documents, the OFTEN most frequent at most: 8 MB, which every task
    gets. They only decide in which order shingles are looked at. The sample has SAMPLE documents, and one of HOT / FREQUENT of a
    larger table: what it doesn't call frequent is in HOT documents or fewer, about, however large the table is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        for batch in batches:
            for _, raw, at in pieces(batch, "text", TEXT):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(raw, at)[0].view(np.int64))], ["h"])

    share = max(1, min(docs.count() // SAMPLE, HOT // FREQUENT))
    sample = docs.where(F.pmod("key", F.lit(share)) == 0).select("text").mapInArrow(lean(run), "h long")
    counted = materialize(sample.groupBy("h").count().where(F.col("count") >= FREQUENT), "frequent")
    often = counted.orderBy(F.col("count").desc(), "h").limit(OFTEN).select("h").toArrow()
    return np.sort(often["h"].to_numpy().view(np.uint64))


def _prefixes(batches: Iterator[pa.RecordBatch], last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (shingle, key): the shingles of which two similar sets share one."""
    from .common import pieces

    for batch in batches:
        for part, raw, at in pieces(batch, "text", TEXT):
            h, offsets = shingle_sets(raw, at, last)
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            first = np.arange(len(h)) - offsets[row] < (n + -4 * n // 5 + 1)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), part.column(0).take(pa.array(row[first]))], ["shingle", "key"])


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, key) sorted by both -> those, once each, whose shingle stands with several keys."""
    held = [np.zeros(0, np.int64)] * 2
    carried = False  # whether the held row's shingle was met before it
    for b in itertools.chain(batches, [None]):
        shingle, key = ([np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns, strict=True)]) if b is not None else held
        if not len(shingle):
            continue
        same = shingle[1:] == shingle[:-1]
        new = np.concatenate([[True], ~same | (key[1:] != key[:-1])])
        shingle, key = shingle[new], key[new]
        same = shingle[1:] == shingle[:-1]
        met = np.concatenate([[carried], same]) | np.concatenate([same, [False]])
        upto = len(shingle) - (b is not None)
        held, carried = [shingle[upto:], key[upto:]], bool(met[-1])
        if met[:upto].any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:upto][met[:upto]]) for x in (shingle, key)], ["shingle", "key"])


def _joined_by_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, fp, n, bits, more) sorted by shingle, HOT rows of one at most -> links (a, b) that connect the fp of the rows
    of a shingle that may be alike."""
    held = None
    for b in itertools.chain(batches, [None]):
        for part in [None] if b is None else (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
            if part is not None:
                numbers = np.stack([c.to_numpy().astype(np.int64) for c in part.columns[:3]])
                now = numbers, _words_of(part.column(3).to_pylist()), part.column(4).to_pylist()
                held = now if held is None else (np.concatenate([held[0], now[0]], axis=1), np.concatenate([held[1], now[1]]), held[2] + now[2])
            if held is None:
                continue
            (shingle, fp, n), bits, more = held
            edges = np.concatenate([[0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(fp)]])
            if part is not None:
                edges = edges[:-1]  # the last group may go on
            upto = int(edges[-1])
            if not upto:
                continue
            marks = Marks(n[:upto], bits[:upto], more[:upto])
            begins, sizes = edges[:-1], np.diff(edges)
            two = begins[sizes == 2]
            two = two[marks.alike(two, two + 1)] if len(two) else two
            out = [np.stack([fp[two], fp[two + 1]], 1)]
            for i, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += [np.stack([fp[members], np.full(len(members), fp[root])], 1) for members, root in marks.outwards(np.arange(i, i + size))]
            pairs = np.concatenate(out)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            held = (held[0][:, upto:].copy(), bits[upto:].copy(), more[upto:])


def links_by_shingles(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of the fp of texts (key, fp, n, bits, more): chains of them connect all texts at 0.8 or more. docs: key,
    text."""
    last = _frequent(docs)
    prefixes = docs.select("key", "text").mapInArrow(lean(lambda b: _prefixes(b, last)), "shingle long, key long")
    met = prefixes.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(lean(_met_again), "shingle long, key long")
    met = materialize(met, "shingles")
    who = [F.count(F.lit(1)).alias("meet"), F.bit_xor(F.xxhash64("key")).alias("who"), F.min("key").alias("least"), F.max("key").alias("most")]
    one = met.groupBy("shingle").agg(*who).groupBy("meet", "who", "least", "most").agg(F.min("shingle").alias("only"), F.first("least").alias("first")).select("only", "meet", "first")
    rows = met.join(one, F.col("shingle") == F.col("only")).select("shingle", "key", "meet", "first")
    few = rows.where(F.col("meet") <= HOT).join(texts.select("key", "fp", "n", "bits", "more"), "key").select("shingle", "fp", "n", "bits", "more")
    near = few.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(lean(_joined_by_shingles), "a long, b long")
    # where more meet, they are one family as they are: no task looks at all of them, verification deals them over blocks
    named = texts.select(F.col("key").alias("t_key"), "fp")
    many = rows.where(F.col("meet") > HOT).join(named, F.col("key") == F.col("t_key")).select("first", F.col("fp").alias("a"))
    many = many.join(named, F.col("first") == F.col("t_key")).select("a", F.col("fp").alias("b")).where("a <> b")
    return materialize(near.unionByName(many).distinct(), "links")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> (doc_id, key, fp, n, bits, more)."""
    from .common import pieces

    for batch in batches:
        for part, raw, at in pieces(batch, "text", TEXT):
            h, offsets = shingle_sets(raw, at)
            n = np.diff(offsets)
            bits = [x.tobytes() for x in parities(h, offsets)]
            more = [parities(h[i:j], np.array([0, j - i]), MORE).tobytes() if j - i > LONG else None for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            cols = [part.column(0), part.column(1), pa.array(_word_sets(raw, at).view(np.int64)), pa.array(n), pa.array(bits, pa.binary()), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "fp", "n", "bits", "more"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, pivot, blocks, key, bits, more, text) -> the same with n and the hashes of the text's shingles for the text."""
    from .common import pieces

    for batch in batches:
        for part, raw, at in pieces(batch, "text", TEXT):
            h, offsets = shingle_sets(raw, at)
            own = [h[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(np.diff(offsets)), pa.array(own, pa.binary())], ["root", "pivot", "blocks", "key", "bits", "more", "n", "shingles"])


def _similar(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sets (ascending hashes) are at 0.8 or more of the union with `own`; sets without members are alike."""
    n = np.array([len(x) for x in others], np.int64)
    shared = np.zeros(len(others), np.int64)
    has = np.flatnonzero(n)
    if len(own) and len(has):
        flat = np.concatenate([others[k] for k in has.tolist()])
        common = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared[has] = np.add.reduceat(common, np.cumsum(n[has]) - n[has], dtype=np.int64)
    return 9 * shared >= 4 * (len(own) + n)


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, salt, key, pivot, shingles), sorted, the pivot itself first in each salt -> (root, key, pivot, alike)."""
    group, own = None, None
    for batch in batches:
        roots, salts, keys, pivots, sets = (c.to_pylist() for c in batch.columns)
        at, n = 0, len(roots)
        while at < n:
            if (roots[at], salts[at]) != group:
                group, own = (roots[at], salts[at]), np.frombuffer(sets[at], np.uint64)
                if keys[at] != pivots[at]:
                    raise RuntimeError("a part of a family lacks its first")
                at += 1
                continue
            to = at
            while to < n and to - at < 1024 and (roots[to], salts[to]) == group:
                to += 1
            alike = _similar(own, [np.frombuffer(x, np.uint64) for x in sets[at:to]])
            yield pa.RecordBatch.from_arrays([pa.array(roots[at:to]), pa.array(keys[at:to]), pa.array(pivots[at:to]), pa.array(alike)], ["root", "key", "pivot", "alike"])
            at = to


def _rest_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, i, j, side, key, pivot, alike, n, bits, more, shingles) sorted by root, i, j -> links (a, b): side 0, a block of
    the rest, with side 1, a block of the family. The members that are alike to the pivot count as one with it."""
    now, rows = None, []

    def solve() -> Iterator[pa.RecordBatch]:
        side, key, pivot, alike = (np.array([r[k] for r in rows]) for k in range(3, 7))
        marks = Marks(np.array([r[7] for r in rows], np.int64), [r[8] for r in rows], [r[9] for r in rows])
        sets = [np.frombuffer(r[10], np.uint64) for r in rows]
        joined, loose = np.flatnonzero((side == 1) & alike), np.flatnonzero((side == 1) & ~alike)
        label = {k: k for k in key.tolist()}

        def find(k: int) -> int:
            while label[k] != k:
                label[k] = label[label[k]]
                k = label[k]
            return k

        a, b = [], []
        for x in np.flatnonzero(side == 0).tolist():
            for some, one in ((joined, True), (loose, False)):
                near = some[marks.alike(x, some)] if len(some) else some
                if not one:
                    near = near[[find(k) != find(int(key[x])) for k in key[near].tolist()]] if len(near) else near
                if not len(near):
                    continue
                hits = near[_similar(sets[x], [sets[k] for k in near.tolist()])]
                for y in [int(pivot[x])] if one and len(hits) else key[hits].tolist() if not one else []:
                    a.append(int(key[x]))
                    b.append(y)
                    if not one:
                        label[find(y)] = find(int(key[x]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:3] != now:
                if rows:
                    yield from solve()
                now, rows = r[:3], []
            rows.append(r)
    if rows:
        yield from solve()


def _verified_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of keys that connect what chains at 0.8 or more connect inside families. sets: see _sets()."""
    salt = F.pmod(F.xxhash64("key"), "blocks")
    own = sets.where("key <> pivot").select("root", salt.alias("salt"), F.lit(1).alias("side"), "key", "pivot", "shingles")
    first = sets.where("key = pivot").select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("side"), "key", "pivot", "shingles")
    dealt = own.unionByName(first).repartition("root", "salt").sortWithinPartitions("root", "salt", "side").drop("side")
    told = materialize(dealt.mapInArrow(lean(_against_pivot), "root long, key long, pivot long, alike boolean"), "told")
    out = told.where("alike").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    rest = told.where("not alike").select(F.col("root").alias("r_root"), F.col("key").alias("r_key"))
    if rest.isEmpty():
        return out
    loose = materialize(sets.join(rest, (F.col("root") == F.col("r_root")) & (F.col("key") == F.col("r_key"))).drop("r_root", "r_key"), "rest")
    parts = loose.groupBy(F.col("root").alias("p_root")).agg(F.ceil(F.sum(F.col("n") + 1) / BLOCK).alias("parts"))
    mark = rest.select("r_root", "r_key", F.lit(True).alias("loose"))
    family = sets.join(parts, F.col("root") == F.col("p_root")).join(mark, (F.col("root") == F.col("r_root")) & (F.col("key") == F.col("r_key")), "left")
    columns = ["key", "pivot", "alike", "n", "bits", "more", "shingles"]
    below = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    one = loose.join(parts, F.col("root") == F.col("p_root")).withColumn("alike", F.lit(False))
    one = one.select("root", F.pmod(F.xxhash64("key"), "parts").alias("i"), below("blocks").alias("j"), F.lit(0).alias("side"), *columns)
    other = family.withColumn("alike", F.col("loose").isNull()).select("root", below("parts").alias("i"), salt.alias("j"), F.lit(1).alias("side"), *columns)
    dealt = one.unionByName(other).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return out.unionByName(dealt.mapInArrow(lean(_rest_in_blocks), "a long, b long"))


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (xxhash64 of the text), keeper: the least id (none: null) and its key of each row's group."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("key"), text_or_empty(text).alias("text"))
    rows = materialize(docs.mapInArrow(lean(_marks), f"doc_id {kind}, key long, fp long, n long, bits binary, more binary"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")).alias("first")
    texts = materialize(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("fp", "n", "bits", "more")], first), "texts")
    family = components(links(texts.select("fp").distinct(), WORD_TAU).unionByName(links_by_shingles(docs, texts)))
    rooted = texts.join(family, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), F.col("key").alias("m_key"), "n", "bits", "more", F.col("first.id").alias("m_id"))
    sizes = rooted.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum(F.col("n") + 1) / BLOCK).alias("blocks"), F.min(F.struct("n", "m_key"))["m_key"].alias("pivot")).where("members > 1")
    members = materialize(rooted.join(sizes, F.col("root") == F.col("r")).select("root", "pivot", "blocks", "m_key", "m_id", "bits", "more"), "members")
    own = marked(docs, F.col("key"), members, F.col("m_key"))[0].join(members, (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id"))).dropDuplicates(["key"]).select("root", "pivot", "blocks", "key", "bits", "more", "text")
    sets = materialize(own.mapInArrow(lean(_sets), "root long, pivot long, blocks long, key long, bits binary, more binary, n long, shingles binary"), "sets")
    found = components(_verified_links(sets))
    named = texts.select("key", "first").join(found, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("g"))
    keepers = named.groupBy(F.col("g").alias("h")).agg(F.min("first").alias("keeper"))
    by_key = named.join(keepers, F.col("g") == F.col("h")).select(F.col("key").alias("k"), "keeper")
    return rows.select("doc_id", "key").join(by_key, F.col("key") == F.col("k")).select("doc_id", "key", F.struct(F.col("keeper.id").alias("doc_id"), F.col("keeper.key").alias("key")).alias("keeper"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns, of which each is the keeper of its group; of equal rows one."""
    found = groups(df, id_col, text).groupBy("doc_id", "key", "keeper").agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key"))
    found = materialize(found.select(F.col("doc_id").alias("_k_id"), F.col("key").alias("_k_key"), F.col("n").alias("_k_n"), stays.alias("stays")), "keepers")
    kept = found.where("stays").drop("stays")
    key = F.xxhash64(text_or_empty(text))
    # most rows are kept and stand once: those that surely do aren't shuffled
    asked, sure = marked(df, F.xxhash64(F.col(id_col), key), found.where("not stays or _k_n > 1"), F.xxhash64("_k_id", "_k_key"))
    rows = asked.join(kept, F.col(id_col).eqNullSafe(F.col("_k_id")) & (key == F.col("_k_key")))
    once = sure.unionByName(rows.where("_k_n = 1").drop("_k_id", "_k_key", "_k_n"))
    if kept.where("_k_n > 1").isEmpty():
        return once
    return once.unionByName(rows.where("_k_n > 1").dropDuplicates(["_k_id", "_k_key"]).drop("_k_id", "_k_key", "_k_n"))
