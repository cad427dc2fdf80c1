"""Document fingerprints: one-permutation MinHash in packed low-order bits, by built-in functions only.

The hashes of a text's five-word shingles are sorted once; their top eight bits deal them to 256 bins, and the
first of each bin is its smallest. An empty bin takes the value of the first filled bin in its own random order of
bins (optimal densification), the same order for every text. The fingerprint keeps the low eight bits of each bin.
Two different values agree in them by chance with probability 1/256, which the likeness corrects for.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import constants, let, range_bounds, range_of, split_words, word_shingles

BINS, BITS, WORDS = 256, 8, 5
#: Looks at drawn bins before an empty bin ranks all filled ones by the same kind of draw.
TRIES = 8
#: Rows of one range of ids, and ranges at most.
RANGE_ROWS, MOST_RANGES = 2000, 16_384


def _draws(seed: int = 5) -> list[list[int]]:
    rng = random.Random(seed)
    return [[rng.randrange(BINS) for _ in range(BINS)] for _ in range(TRIES)]


def _ints(values: list[int]) -> Column:
    """A constant array, folded by the planner."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def fingerprint(text: Column) -> Column:
    """The low bits of each bin (array of 256 tinyint); an empty array if there are no words."""
    draws = _draws()

    def binned(s: Column) -> Column:
        """Filled bins of sorted hashes as structs ``b`` (0 to 255) and ``v``."""
        b = lambda i: F.shiftright(F.get(s, i), 56) + 128
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (b(i) != b(i - 1)))
        return F.transform(starts, lambda i: F.struct(b(i).cast("int").alias("b"), (F.get(s, i).bitwiseAND(255) - 128).cast("tinyint").alias("v")))

    def spread(full: Column) -> Column:
        """One value or null for each bin, in order."""
        gap = lambda n: F.array_repeat(F.lit(None).cast("tinyint"), n)
        head = F.transform(full, lambda x, i: F.array_append(gap(x["b"] - F.when(i == 0, F.lit(0)).otherwise(F.get(full, i - 1)["b"] + 1)), x["v"]))
        return F.concat(F.flatten(head), gap(BINS - 1 - F.get(full, F.size(full) - 1)["b"]))

    def densify(full: Column) -> Column:
        ranked = lambda i: F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(i, x["b"]).alias("h"), x["v"].alias("v"))))["v"]
        fill = lambda all_: F.transform(all_, lambda v, i: F.coalesce(v, *[F.get(all_, F.get(_ints(d), i)) for d in draws], ranked(i)))
        return let(spread(full), fill)

    hashes = F.sort_array(word_shingles(split_words(text), WORDS))
    return let(hashes, lambda s: F.when(F.size(s) > 0, let(binned(s), densify)).otherwise(F.array().cast("array<tinyint>")))


def packed(bins: Column) -> Column:
    """A fingerprint as lower-case hexadecimal text, two digits a bin; empty for no words."""
    digits = F.split(F.lit(",".join(f"{i:02x}" for i in range(1 << BITS))), ",")
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their fingerprints, corrected for chance; 1 if neither has words."""
    chance = 1.0 / (1 << BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(BINS)
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (equal - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(fit)


def with_next(docs: DataFrame, carried: list[str], key: str = "doc_id") -> DataFrame:
    """Each row with the ``carried`` columns of the row that follows it in descending order of ``key``, as ``next_*``.

    After the last row comes the first. Rows are dealt to ranges of keys, whose bounds (16,384 at most) the driver gets; the
    first row of each range is copied behind the last one of the range before it, so that no task sees all rows. Rows of
    one key follow each other by the hash of their carried columns, null keys come last; if no row has a key, the
    last row's ``next_*`` are null.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, key, RANGE_ROWS, MOST_RANGES)
    dealt = docs.withColumn("_range", range_of(F.col(key), bounds))
    heads = sorted((r["_range"], r["m"]) for r in dealt.groupBy("_range").agg(F.max(key).alias("m")).collect() if r["m"] is not None)
    goes = [(m, heads[(i + 1) % len(heads)][0]) for i, (_, m) in enumerate(heads)]
    table = F.broadcast(constants(spark, _head=[m for m, _ in goes], _to=[r for _, r in goes]))
    copies = F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").cast("int").alias("r"), F.lit(True).alias("copy")))))
    rows = dealt.join(table, F.col(key) == F.col("_head"), "left").withColumn("_c", F.explode(copies)).drop("_head", "_to", "_range")
    order = Window.partitionBy("_c.r").orderBy(F.col("_c.copy"), F.col(key).desc_nulls_last(), F.xxhash64(*carried))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.where("NOT _c.copy").drop("_c")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and the likeness of both and of the next document.

    Columns: ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. In the edited text the
    last ``floor(n_chars / 3)`` code points give way to the first as many (or all) of the next document by descending
    id; after the last comes the first. One shuffle, by ranges of ids; a document's words never leave its row.

    Cases: null text is empty; texts without words have the empty fingerprint, like each other by 1 and others by 0; fewer
    than five words are one shingle; equal texts have equal fingerprints; a single document follows itself; for null
    and repeated ids see :func:`with_next`; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_next_of(base)
    cutoff = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substr(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cutoff)
    own = own.withColumn("edited", F.concat(kept, F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cutoff)))
    own = own.withColumn("edited_bins", fingerprint(F.col("edited")))
    return own.select(
        F.col("doc_id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.coalesce("next_bins", F.array().cast("array<tinyint>"))).alias("near_next"),
    )


def with_next_of(base: DataFrame) -> DataFrame:
    """Length and fingerprint of each row, and text and fingerprint of the next."""
    dealt = base.withColumns({"n_chars": F.length("text").cast("long"), "bins": fingerprint(F.col("text"))})
    return with_next(dealt, ["text", "bins"])
