"""Pages of an ordered table by order statistics.

A page near the beginning is a top-k. A deep one would make a task and the driver hold every row before it; here its place is
narrowed down first: a bounded sample gives CUTS - 1 boundaries, one scan counts the rows of the ranges between them, and
the range that the page falls into is cut again, until it and what the page needs after it are FEW rows or one range can't be
cut further. Only the rows of that range are sorted, and none before it.

Defined results: descending order has nulls first, ascending order nulls last; equal values go by id, ascending, null ids
first; a page beyond the end is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets up to which a page is a top-k, rows of a range that are sorted as they are, ranges of a cut, rows of the sample (about).
SHALLOW, FEW, CUTS, SAMPLE = 1000, 4096, 64, 4096


def order(by: Column, id_: Column, descending: bool) -> list[Column]:
    return [by.desc_nulls_first() if descending else by.asc_nulls_last(), id_.asc_nulls_first()]


def _not_before(by: Column, id_: Column, descending: bool, value: object, key: object) -> Column:
    """Whether a row is the boundary (value, key) or comes after it."""
    same = F.lit(True) if key is None else F.coalesce(id_ >= F.lit(key), F.lit(False))
    if value is None:
        return by.isNotNull() | same if descending else by.isNull() & same
    at = F.lit(value)
    later = by < at if descending else by.isNull() | (by > at)
    return F.coalesce(later | ((by == at) & same), F.lit(False))


def page(df: DataFrame, by: str, id_col: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of df in this order."""
    column, id_ = F.col(by), F.col(id_col)
    some, before = df, 0
    while offset - before > SHALLOW:
        total = some.count()
        if total <= max(FEW, limit):
            break
        share = max(1, total // SAMPLE)
        sample = some.select(column.alias("v"), id_.alias("k")).where(F.pmod(F.xxhash64(id_), F.lit(share)) == 0) if share > 1 else some.select(column.alias("v"), id_.alias("k"))
        rows = sample.orderBy(F.xxhash64("k")).limit(2 * SAMPLE).orderBy(*order(F.col("v"), F.col("k"), descending)).collect()  # of bounded size
        cuts = list(dict.fromkeys((rows[i * len(rows) // CUTS].v, rows[i * len(rows) // CUTS].k) for i in range(1, CUTS) if rows))
        if not cuts:
            break
        tests = [_not_before(column, id_, descending, v, k) for v, k in cuts]
        number = sum((t.cast("int") for t in tests), F.lit(0))
        counts = {r.range: r["count"] for r in some.groupBy(number.alias("range")).count().collect()}  # CUTS rows
        at = begin = 0
        while at < len(cuts) and begin + counts.get(at, 0) <= offset - before:
            begin, at = begin + counts.get(at, 0), at + 1
        end, held = at, counts.get(at, 0)
        while end < len(cuts) and begin + held < offset - before + limit:  # a page may reach over several ranges
            end += 1
            held += counts.get(end, 0)
        if at == 0 and end == len(cuts):
            break
        if at > 0:
            some = some.where(tests[at - 1])
        if end < len(cuts):
            some = some.where(~tests[end])
        before += begin
        if held >= total:
            break
    return some.orderBy(*order(column, id_, descending)).offset(offset - before).limit(limit)
