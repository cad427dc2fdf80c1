"""Ranked lexical search: postings in buckets of terms, integer scores, the best documents of each item."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, ship, slices

#: Runs of ASCII letters, digits and all other characters beyond ASCII; as a table of bytes, since UTF-8 has these above 127.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms are dealt to so many buckets, by which postings are sorted: a scan for few terms skips the others' row groups.
BUCKETS = 256
#: Up to so many pairs of item and term are sent to all tasks (some 64 bytes each); more are joined by shuffle.
BROADCAST_TERMS = 200_000


def terms(text: bytes | None) -> list[bytes]:
    """The terms of one text in UTF-8, in order, A-Z in lower case."""
    return text.translate(TERM_BYTES).split() if text else []


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``bucket, term, id, tf, n, head``: one row for each term of each row's text.

    ``tf`` are the term's occurrences, ``n`` the text's terms with repeats; ``head`` marks one posting of each text that has any.
    """
    names = ["bucket", "term", "id", "tf", "n", "head"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=256, most_bytes=4 << 20):
            counts = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(c) for c in counts], np.int64)
            if not sizes.sum():
                continue
            words = list(chain.from_iterable(counts))
            tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, len(words))
            head = np.zeros(len(words), np.bool_)
            head[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % BUCKETS
            n = np.repeat(np.array([c.total() for c in counts], np.int64), sizes)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(words, pa.string()), ids, pa.array(tf), pa.array(n), pa.array(head)], names)

    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return given.mapInArrow(rows, "bucket int, term string, id long, tf long, n long, head boolean")


def index(docs: DataFrame) -> DataFrame:
    """The postings of all documents with an id, written where all executors see them, each file in order of bucket."""
    return cut(postings(docs.where("doc_id IS NOT NULL")).sortWithinPartitions("bucket"), "postings", "zstd")


def search(stored: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, equal scores by ascending id.

    ``stored`` is an :func:`index`, ``items`` has ``item_id, text``. Item terms meet the postings in one join; the postings that they find are dealt by document, the only
    large shuffle, so that items' matches and their sums stay where they are; each task passes on its own ``k`` best of an item at most. Terms of weight 0 add nothing and are not joined.

    Cases: null and empty texts have no terms, an item without any has no rows; rows that repeat an id are texts of their own in all
    counts, and their scores add up (items: their terms do); documents without an id take no part; an item without an id is an item; no rows, no result;
    other columns are not read.
    """
    asked = cut(postings(items, "item_id").groupBy(F.col("id").alias("item_id"), "bucket", "term").agg(F.sum("tf").alias("times")), "item-terms")
    small = asked.count() <= BROADCAST_TERMS
    send = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # no more than there are
    found = stored.where(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else stored
    totals = stored.agg(F.count_if("head").alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("terms")).first()
    docs, length = totals["docs"], max(totals["terms"], 1)
    held = found.select("term").join(send(asked.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = cut(asked.join(held, "term").withColumn("w", weight * F.col("times")).where("w > 0").select("item_id", "term", "w"), "item-weights")
    m = F.lit(75).cast("long") + F.expr(f"(25 * n * {docs}L) div {length}L")
    part = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")
    hits = found.select("term", F.col("id").alias("doc_id"), "tf", "n").join(send(weighed.select("term").distinct()), "term").withColumn("m", m).select("doc_id", "term", part.alias("part"))
    scores = hits.repartition("doc_id").join(send(weighed), "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 20) -> str:
    """DuckDB SQL that scores every document for every item."""
    run = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {run} AS term FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
q AS (SELECT item_id, {run} AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score FROM q JOIN df USING (term) JOIN p USING (term) JOIN len USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
