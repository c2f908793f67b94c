"""Running sums over arrays inside one row, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that one fold appends to its array, which is copied at each step; folds of folds keep the cost near n.
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often and deep inside other lambdas it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefixes(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For an array of n longs the n + 1 totals of its beginnings, from none (0) to all."""
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() AS array<bigint>)")

    def each(of: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(of, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, plus))
        return let(totals, lambda t: F.array_append(F.flatten(F.zip_with(chunks, each(t, zero), each)), F.aggregate(t, zero, plus)))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int"))
        return let(F.transform(starts, lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))), of_chunks)

    return let(values, cut)


def add(a: Column, b: Column) -> Column:
    return a + b


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)
