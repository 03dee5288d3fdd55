"""Column expressions over array cells. All of them stay in the row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_tail(values: Column, n: int) -> Column:
    """Last ``n`` elements; a shorter list is kept whole."""
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, n)


def list_mean(values: Column) -> Column:
    """Mean of the non-null elements, null when there are none."""
    known = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(known))


def list_median(values: Column) -> Column:
    """Median of the non-null elements, null when there are none."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(ordered)
    lower = F.try_element_at(ordered, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    upper = F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    return (lower.cast("double") + upper.cast("double")) / 2


def list_diff(values: Column) -> Column:
    """Differences to the previous element; the first is null."""
    return F.transform(values, lambda x, i: F.when(i > 0, x - F.get(values, i - 1)))


def pad_right(values: Column, n: int | Column, pad: int) -> Column:
    """Cut to ``n`` elements and fill up with ``pad`` on the right; null lists and elements count as pads."""
    width = F.lit(n) if isinstance(n, int) else n
    filler = F.lit(pad).cast("bigint")
    whole = F.transform(F.coalesce(values, F.array().cast("array<bigint>")), lambda x: F.coalesce(x, filler))
    cut = F.slice(whole, 1, width)
    return F.concat(cut, F.array_repeat(filler, (width - F.size(cut)).cast("int")))


def pad_left(values: Column, n: int, pad: int) -> Column:
    """Keep the last ``n`` elements and fill up with ``pad`` on the left, so the last stays the most recent."""
    tail = list_tail(F.coalesce(values, F.array().cast("array<bigint>")), n)
    known = F.transform(tail, lambda x: F.coalesce(x, F.lit(pad).cast("bigint")))
    return F.concat(F.array_repeat(F.lit(pad).cast("bigint"), (F.lit(n) - F.size(known)).cast("int")), known)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays of one length, in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
