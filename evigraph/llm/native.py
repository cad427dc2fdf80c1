"""Column expressions shared by the operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_shingles(words: Column, k: int) -> Column:
    """Hashes (long) of the ``k``-word shingles of an array of words, in order.

    Fewer words than ``k`` make one shingle, no words none.
    """

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " "), n))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def split_words(text: Column) -> Column:
    """Lower-case words between white space; an empty array for null."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n\t\r\x0b\x0c", "     ")
    return F.array_remove(F.split(flat, " "), "")


def longs(values: list[int]) -> Column:
    """A constant array of whole numbers, folded by the planner."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def constants(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """A small table of whole numbers given in the plan itself."""
    n = len(next(iter(columns.values())))
    return spark.range(n).select(*[F.get(longs(v), F.col("id").cast("int")).alias(k) for k, v in columns.items()])


def range_bounds(df: DataFrame, key: str, rows: int, most: int) -> list[int]:
    """Bounds that deal the keys to ranges of about ``rows`` rows, ``most`` ranges at most; found by one pass over the keys."""
    ranges = max(1, min(most, -(-df.count() // rows)))
    if ranges == 1:
        return []
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return sorted(set(df.agg(F.percentile_approx(key, cuts, 10 * ranges).alias("p")).first()["p"] or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``key``, found in two steps of about the square root of their number.

    None for a null key.
    """
    if not bounds:
        return F.lit(0)
    g = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + g] for i in range(0, len(bounds), g)]
    lists = F.split(F.lit(";".join(",".join(map(str, x)) for x in groups)), ";")
    coarse = F.size(F.filter(longs([x[-1] for x in groups]), lambda b: b < key))
    fine = lambda c: c * g + F.when(c >= len(groups), F.lit(len(bounds) - len(groups) * g)).otherwise(F.size(F.filter(F.split(F.get(lists, c), ",").cast("array<bigint>"), lambda b: b < key)))
    return F.coalesce(let(coarse, fine), F.lit(0))
