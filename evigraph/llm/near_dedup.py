"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

Plan: texts -> shingle sets, sketched where they are read (only sketches are kept) -> one class for each distinct
set, so exact copies cost nothing more -> bands -> in each bucket a star from its most central member to the others,
not all pairs -> links confirmed on whole sets -> components. A star may miss a link between two members that both
differ from the centre; buckets that still hold more than one component therefore get a second star, and what
is open then is settled exactly by the members' rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import one_permutation, probe_table, shingle_set
from .tables import connected_components, cut, drop, rows_of, ship, slices

#: 128 bins in 32 bands of 4: a pair at similarity 0.85 misses every band with probability 5e-11, at 0.8 with 5e-8.
BINS, ROWS = 128, 4


def _sketches(batches: Iterator[pa.RecordBatch], k: int, bins: int, rows: int) -> Iterator[pa.RecordBatch]:
    probes = probe_table(bins)
    for batch in slices(batches):
        ids, n, key, bands = [], [], [], []
        for (text,) in rows_of(batch, "text"):
            s = shingle_set(text, k)
            n.append(len(s))
            raw = s.tobytes()
            key.append(xxhash.xxh3_128_digest(raw))
            if len(s):
                sig = one_permutation(s, bins, probes).reshape(-1, rows)
                bands.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(sig)])
            else:
                bands.append(None)
        ids = batch.column(batch.schema.get_field_index("fetch_id"))
        doc = batch.column(batch.schema.get_field_index("doc_id"))
        texts = batch.column(batch.schema.get_field_index("text_key"))
        yield pa.RecordBatch.from_arrays([doc, ids, texts, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "fetch_id", "text_key", "n_shingles", "set_key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [(cid, s) for cid, key, text in rows_of(batch, "cid", "set_key", "text") if xxhash.xxh3_128_digest((s := shingle_set(text, k)).tobytes()) == key]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["cid", "items"])


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``u, v`` those whose whole sets have ``den * |both| >= num * |either|``."""
    a = sets.select(F.col("cid").alias("u"), F.col("items").alias("a"))
    b = sets.select(F.col("cid").alias("v"), F.col("items").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumns({"na": F.size("a"), "nb": F.size("b")})
    both = both.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", "na", "nb", common.alias("common")).where((den + num) * F.col("common") >= num * (F.col("na") + F.col("nb"))).select("u", "v")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, bins: int = BINS, rows: int = ROWS, texts: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``; with ``texts`` also ``text_key``, a hash
    of the row's text, and ``group_id``, the same number for all rows of a component (null for empty sets).

    Two documents are linked if ``den * |A & B| >= num * |A | B|`` over their sets of distinct ``words``-word
    shingles (A-Z in lower case, words divided by ASCII white space). ``component_id`` is the smallest id
    that links reach, ``kept`` says whether that is the row itself.

    Cases: null, empty or blank text has an empty set and is linked with nothing; fewer words than ``words`` are one
    shingle; rows repeated under one id are vertices by their text and all of a text's rows share its component; a row
    without id joins its group but never names it, and is kept only if no member has an id. Other columns of ``docs``
    are not read.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("fetch_id", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("text_key", F.xxhash64("text"))
    sketch = cut(base.mapInArrow(lambda it: _sketches(it, words, bins, rows), "doc_id long, fetch_id long, text_key long, n_shingles long, set_key binary, bands array<long>"), "sketch")
    by_key = sketch.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("fetch_id").alias("fetch_id"), F.any_value("bands").alias("bands"))
    classes = cut(by_key.withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(members.join(shared, "bucket"), "buckets")
    central = buckets.groupBy("cid").agg(F.sum("size").alias("score"))
    scored = cut(buckets.select("bucket", "cid").join(central, "cid"), "buckets")
    drop(buckets)
    buckets = scored

    wanted = classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", "set_key", "fetch_id")
    fetched = base.select("fetch_id", "text").join(wanted, "fetch_id").select("cid", "set_key", "text")
    found = fetched.mapInArrow(lambda it: _sets(it, words), "cid long, items array<long>")
    sets = cut(found, "sets")
    if sketch.groupBy("fetch_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        sets = cut(sets.dropDuplicates(["cid"]), "sets")

    centre = buckets.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("cid")).alias("minus"))).alias("m")).select("bucket", (-F.col("m.minus")).alias("u"))
    pairs = buckets.join(centre, "bucket").where("cid <> u").select(F.least("u", "cid").alias("u"), F.greatest("u", "cid").alias("v"))
    links = cut(_confirmed(pairs.distinct(), sets, num, den), "links")
    labels = connected_components(links)
    for step in (_second_stars, _rare_shingle_pairs):
        open_ = _open_members(buckets, labels)
        if not open_.limit(1).count():
            break
        more = cut(_confirmed(step(open_, sets, num, den).distinct(), sets, num, den), "links")
        if more.limit(1).count():
            links = cut(links.unionByName(more), "links")
            drop(labels)
            labels = connected_components(links)
        drop(open_)
    drop(buckets, sets, links)

    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("set_key", "rep", F.coalesce("label", "cid").alias("label"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "label").select("set_key", "component_id", F.col("label").alias("group_id"))
    out = sketch.select("doc_id", "n_shingles", "set_key", "text_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    more = ["text_key", F.when(F.col("n_shingles") > 0, F.col("group_id")).alias("group_id")] if texts else []
    kept = F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept, *more)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay if one row of each group of near-duplicates does, whole, whatever their columns are called.

    Of a group the row with the smallest id stays, rows without id last, then by text; decided for rows, not ids: an id that
    stands on texts of two groups is judged in each. Rows without words stay, and rows equal in id and text become
    one. ``options`` are those of :func:`near_duplicates`.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = near_duplicates(docs, texts=True, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m")
    stay = found.where("group_id IS NOT NULL").groupBy("group_id").agg(first).select("m.doc_id", "m.text_key")
    stay = stay.unionByName(found.where("group_id IS NULL").select("doc_id", "text_key")).distinct()
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("text_key").alias("stay_text"))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_text"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_text") == F.col("stay_text")), "left_semi")
    return rows.dropDuplicates(["row_id", "row_text"]).select("row.*")


def _open_members(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component: ``bucket, cid, score, label``."""
    known = buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "score", F.coalesce("label", "cid").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return cut(known.join(mixed, "bucket", "left_semi"), "open")


def _second_stars(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """In each bucket, the most central member of another component against the members of all others."""
    order = F.struct(F.xxhash64("label").alias("h"), "score", F.col("cid").alias("c"), F.col("label").alias("l"))
    centre = members.groupBy("bucket").agg(F.max(order).alias("m")).select("bucket", F.col("m.c").alias("c"), F.col("m.l").alias("l"))
    return members.join(centre, "bucket").where("label <> l").select(F.least("c", "cid").alias("u"), F.greatest("c", "cid").alias("v"))


def _rare_shingle_pairs(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of members of different components that can be linked, found without listing the pairs of a bucket.

    A link shares at least ``num / den`` of either set, so in any common order of shingles the first
    ``n - ceil(n * num / den) + 1`` of both sets have one in common. The order used is rarest first: what sets a member
    apart stands at its front, and members that differ too much from all others meet nobody.
    If the first one shared has ``left`` and ``rest`` shingles from its place on, no more than the smaller of these can
    be common, so the join itself drops pairs for which that is not enough. Of each shingle's holders those outside its most common component are joined to the rest.
    Both joins by shingle are of written tables, plain shuffles on either side, so that Spark can split those of a hot shingle.
    """
    nodes = members.select("cid", "label").distinct()
    items = sets.join(nodes, "cid").select("cid", "label", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("often", "item"))
    front = items.join(often.where("often > 1"), "item", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("place", place)
    front = cut(front.where((F.col("place") - 1) * den <= (den - num) * F.col("n")).where("often > 1").select("cid", "label", "item", "n", (F.col("n") - F.col("place") + 1).alias("left")), "front")
    per = front.groupBy("item", "label").agg(F.count("*").alias("c"))
    main = per.groupBy("item").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("k")).where("k > 1").select("item", F.col("m.label").alias("main"))
    shared = cut(front.join(cut(main, "main"), "item"), "shared")
    few = shared.where("label <> main").select("item", F.col("cid").alias("c"), F.col("label").alias("l"), F.col("n").alias("m"), F.col("left").alias("rest"))
    enough = (den + num) * F.least("left", "rest") >= num * (F.col("n") + F.col("m"))
    pairs = shared.join(few, (shared.item == few.item) & (shared.label != few.l) & enough)
    return pairs.select(F.least("cid", "c").alias("u"), F.greatest("cid", "c").alias("v"))
