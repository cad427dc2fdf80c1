"""Substring search over names: posting lists of trigrams, so that few names are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import runs_of

N = 3


def postings(named: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """``gram, id``: each distinct trigram of each name in lower case, in order of trigram, so that a scan for few of them skips the rest.

    Dealt by ranges of both, as a trigram that all names hold would else be one task's, and before rows are compared: the trigrams of few bytes of names are many.
    """
    return named.select(F.col(key).alias("id"), F.explode(runs_of(F.lower(F.col(name)), N)).alias("gram")).select("gram", "id").repartitionByRange("gram", "id").distinct().sortWithinPartitions("gram", "id")


def holding(index: DataFrame, term: str) -> DataFrame | None:
    """``id`` of the names that have all trigrams of the term, those that hold it among them; None for a term shorter than a trigram."""
    low = term.lower()
    grams = sorted({low[i : i + N] for i in range(len(low) - N + 1)})
    if not grams:
        return None
    rows = index.where(F.col("gram").isin(grams)).distinct()
    return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
