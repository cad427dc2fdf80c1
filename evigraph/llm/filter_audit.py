"""Filter interaction audit: what each filter removes in every order, from a packed bitmap index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, rows_of, ship, slices

#: Filters by letter; bit ``i`` of a document's flags is set if it fails the ``i``-th. E is table-wide and set by a join.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
GOOD, TOXIC = SUBSETS, SUBSETS << 1
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Characters of filter D.
MARKS = b"#$%&*|"
#: Documents of a task that are held as one block of bitmaps (a byte each before packing).
BLOCK = 1 << 20

LEAST_WORDS = 200


def fails(text: str | None) -> int:
    """The flags of filters A to D for one text: few words, repeated words, capitals, marks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    few, repeated = n < LEAST_WORDS, 100 * len(set(words)) < 50 * n
    capitals = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * len(text or "")
    return few | repeated << 1 | capitals << 2 | (len(raw.translate(None, MARKS)) < len(raw)) << 3


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, part, flags, digest`` of each document: filters A to D and 128 bits that stand for the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            texts = batch.column(1).to_pylist()
            flags = pa.array([fails(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flags, digests], ["doc_id", "part", "flags", "digest"])

    ship(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return given.mapInArrow(rows, "doc_id long, part string, flags int, digest binary")


def block_counts(codes: np.ndarray, flags: np.ndarray, parts: int) -> np.ndarray:
    """``parts x SUBSETS x 3`` counts of the documents that survive each set of filters: all, good, toxic.

    A part's documents are neighbouring bits from a new 64-bit word on, so that one pass over the words counts all parts. ``codes``
    tell the part (from 0) of each document, ``flags`` its failed filters and labels.
    """
    order = np.argsort(codes, kind="stable")
    size = np.bincount(codes, minlength=parts)
    words = np.maximum(-(-size // 64), 1)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size) + 64 * np.repeat(first, size)

    def packed(bits: np.ndarray) -> np.ndarray:
        plain = np.zeros(64 * int(words.sum()), np.bool_)
        plain[place] = bits[order]
        return np.packbits(plain).view(np.uint64)

    there = packed(np.ones(len(codes), np.bool_))
    fail = [packed(flags >> i & 1 != 0) for i in range(len(FILTERS))]
    labels = [there, packed(flags & GOOD != 0), packed(flags & TOXIC != 0)]
    failed, out = [np.zeros_like(there)], np.empty((parts, SUBSETS, 3), np.int64)
    for subset in range(SUBSETS):
        if subset:
            low = (subset & -subset).bit_length() - 1
            failed.append(failed[subset & (subset - 1)] | fail[low])
        for k, label in enumerate(labels):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(label & ~failed[subset]).astype(np.int64), first)
    return out


def subset_counts(flagged: DataFrame) -> DataFrame:
    """``part, subset, kept, good, toxic``: documents that survive each set of filters, summed over the tasks' bitmaps."""
    names = ["part", "subset", "kept", "good", "toxic"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                coded = pa.chunked_array([p for p, _ in held]).combine_chunks().dictionary_encode()
                known = coded.dictionary.to_pylist()
                counts = block_counts(coded.indices.to_numpy(zero_copy_only=False), np.concatenate([f for _, f in held]), len(known))
                held.clear()
                for a in range(0, len(known), 1024):
                    some = counts[a : a + 1024]
                    subset = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(some)))
                    part = pa.array(known, pa.string()).take(pa.array(np.repeat(np.arange(a, a + len(some)), SUBSETS)))
                    yield pa.RecordBatch.from_arrays([part, subset, *[pa.array(some[:, :, k].ravel()) for k in range(3)]], names)

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)))
                rows += batch.num_rows
            if rows >= BLOCK:
                yield from flush()
                rows = 0
        yield from flush()

    found = flagged.select("part", "flags").mapInArrow(counted, "part string, subset int, kept long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _bits(letters: Column) -> Column:
    """The set of the filters that a text of letters names, as bits."""
    bit = lambda x: F.when(x == "", F.lit(0)).otherwise(F.pow(F.lit(2), F.instr(F.lit(FILTERS), x) - 1).cast("int"))
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, x: acc + bit(x))


def _shapley(kept: Column, bit: Column) -> Column:
    """The removals of one filter summed over all orders: a set of ``s`` filters comes before it in ``s! (4 - s)!`` of them."""
    n = len(FILTERS) - 1
    weights = F.array(*[F.lit(factorial(k := s.bit_count()) * factorial(max(n - k, 0))).cast("long") for s in range(SUBSETS)])
    gone = lambda s: F.get(weights, s) * (F.get(kept, s) - F.get(kept, s.bitwiseOR(bit)))  # noqa: E731  none where the filter is in the set
    return F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0).cast("long"), lambda acc, s: acc + gone(s))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters keeps, removes and costs, for every part (language) and each of the 120 orders.

    Tasks turn their documents into bitmaps, one bit a document, of the filters, labels and parts; the survivors of each of the 32 sets
    of filters are counted by AND-NOT and popcount, and only these counts are summed over tasks: 32 rows for each part of a task. All
    columns follow from them. Texts are told equal by 128 bits of BLAKE2b; copies meet in an aggregation of these digests with
    partial results, and a join that Spark splits where one text is on many rows.

    Cases: null and empty texts are the empty text (they fail A, and E if a smaller id has one too); rows without an id neither fail
    E nor make others fail, and have no labels; rows that repeat an id count one by one and don't fail E for one another; an id with several rows
    in ``labels`` has each label that one of them gives; a null ``lang`` is the part ``''``; no documents, no rows; other columns are not read.
    """
    seen = cut(features(docs), "filter-features")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = seen.join(marks.where("doc_id IS NOT NULL"), "doc_id", "left").join(first, "digest", "left")
    copy = (F.col("doc_id") > F.col("first_id")).cast("int")
    flags = F.col("flags") + F.coalesce(copy, F.lit(0)) * (SUBSETS >> 1) + F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("toxic", F.lit(0)) * TOXIC
    counts = subset_counts(rows.select("part", flags.alias("flags")))
    by_part = counts.groupBy("part").agg(*[F.array_sort(F.collect_list(F.struct("subset", c)))[c].alias(f"{c}_of") for c in ("kept", "good", "toxic")])  # 32 counts each
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    step = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    step = step.withColumns({"before": _bits(F.left("filter_order", F.col("step") - 1)), "after": _bits(F.left("filter_order", F.col("step")))})
    bit = (F.col("after") - F.col("before")).alias("bit")
    at = lambda c, s: F.get(f"{c}_of", s if isinstance(s, Column) else F.lit(s))
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    whole = SUBSETS - 1
    return step.select(
        "part", "filter_order", "step", at("kept", F.col("after")).alias("kept"), lost("kept").alias("removed"), (at("kept", 0) - at("kept", bit) - lost("kept")).alias("redundant"),
        (at("kept", F.lit(whole) - bit) - at("kept", whole)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), _shapley(F.col("kept_of"), bit).alias("shapley"),
    )


def oracle() -> str:
    """DuckDB SQL that applies the filters one after another to every document."""
    return r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS fail FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
t AS (SELECT filter_order, step, filter_order[step] AS c, string_split(filter_order[:step - 1], '') AS before, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: y <> filter_order[step]) AS others FROM s),
g AS (SELECT part, good, toxic, fail, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, fail[c] AS bad, len(list_filter(before, lambda y: y <> '' AND fail[y])) > 0 AS gone, len(list_filter(others, lambda y: fail[y])) > 0 AS other FROM g, t),
z AS (SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bad AND NOT other), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM z"""
