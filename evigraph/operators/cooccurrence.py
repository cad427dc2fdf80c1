"""Sentence-level co-occurrence: counts and sampled evidence of entity pairs."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import ship

EVIDENCE = 5
#: Entities of a sentence that are paired in one piece; larger sentences are cut into blocks of so many.
BLOCK = 256
#: Pairs that a task counts when pairs of a least number of documents are looked for.
TASK_PAIRS = 4_000_000
#: Bytes of copies of sentences that are dealt to such tasks at once, or twice those of the sentences themselves; more are dealt in several rounds.
ROUND_BYTES = 1 << 30
#: Pairs of sentences that go to one task where they are made behind the shuffle, and those of them that it holds at once (more only if one entity has more).
DEALT_PAIRS, HELD_PAIRS = 16_000_000, 1_000_000
#: Characters of evidence, and rows, that leave such a task at once.
BATCH_CHARS, BATCH_ROWS = 8 << 20, 1 << 16
#: Rows of an entity up to which its documents go as a list beside the pairs that are looked at again.
LISTED = 256
KEYS = ["entity_a_id", "entity_b_id"]
#: Takes a table and gives it again, read from where it was written.
Keep = Callable[[DataFrame], DataFrame]


def _seq(mentions: DataFrame):
    return F.col("mention_seq") if "mention_seq" in mentions.columns else F.col("sentence_id").cast("long")


def sentences(mentions: DataFrame) -> DataFrame:
    """``doc_id, sentence_id, e, seq`` of the sentences of two entities or more, with their text where mentions have it: ``e`` is the sorted set of entities.

    All that pairs need of mentions, by one shuffle. Whoever needs it more than once (:func:`cooccurrences`) may keep it as a table.
    """
    seq = _seq(mentions)
    text = [F.min(F.struct(seq.alias("seq"), "sentence_text"))["sentence_text"].alias("sentence_text")] if "sentence_text" in mentions.columns else []
    return mentions.groupBy("doc_id", "sentence_id").agg(F.sort_array(F.collect_set("entity_id")).alias("e"), F.min(seq).alias("seq"), *text).where(F.size("e") > 1)


def contexts(mentions: DataFrame, block: int = BLOCK) -> DataFrame:
    """``entity_a_id, entity_b_id, doc_id, sentence_id, seq`` for each pair of entities in each sentence.

    A sentence's entities are gathered as a sorted set and paired within it: one shuffle, by sentence, and a pair
    stands in it once however often it is mentioned. The sentence's text stays behind. The pairs of a sentence of more than ``block``
    entities are made block by block of its set, and its pairs of blocks are dealt to all tasks.
    """
    return paired(sentences(mentions), block)


def paired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The :func:`contexts` of :func:`sentences`."""
    place = ["doc_id", "sentence_id", "seq"]
    small = rows.where(F.size("e") <= block).select(*place, F.posexplode("e").alias("i", "entity_a_id"), F.lit(True).alias("same"), F.col("e").alias("f"))
    of = lambda c: F.slice("e", F.col(c) * block + 1, block)
    left = rows.where(F.size("e") > block).select(*place, "e", F.explode(F.sequence(F.lit(0), F.ceil(F.size("e") / block).cast("int") - 1)).alias("x"))
    both = left.select(*place, "e", "x", F.explode(F.sequence(F.col("x"), F.ceil(F.size("e") / block).cast("int") - 1)).alias("y"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes become many pairs
    dealt = both.select(*place, "x", "y", of("x").alias("e"), of("y").alias("f")).repartition(tasks, *place[:2], "x", "y")
    large = dealt.select(*place, F.posexplode("e").alias("i", "entity_a_id"), (F.col("x") == F.col("y")).alias("same"), "f")
    rest = F.when(F.col("same"), F.slice("f", F.col("i") + 2, block)).otherwise(F.col("f"))
    return small.unionByName(large).select("entity_a_id", F.explode(rest).alias("entity_b_id"), "doc_id", "sentence_id", "seq")


def counts(ctx: DataFrame) -> DataFrame:
    """Sentences and distinct documents of each pair.

    Counted by document first: sums over documents then need no sets, and a pair that is everywhere is summed in parts.
    """
    per = ctx.groupBy("entity_a_id", "entity_b_id", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("entity_a_id", "entity_b_id").agg(F.sum("n").alias("sent_count"), F.count("*").alias("docs_count"))


def frequent(mentions: DataFrame, least: int, keep: Keep = lambda rows: rows) -> DataFrame:
    """The :func:`counts` of the pairs that ``least`` documents or more have, without a row for each other pair; ``keep`` is as in :func:`cooccurrences`.

    Small documents come first in one order of all. Of the documents that a pair has in common, the first ``some`` are not among the last ``least - some`` of either entity; so pairs are
    looked for in sentences without entities of which the document is among these, and what ``some`` documents have is counted exactly. In that search entities are 32-bit codes, of which equal ones add
    to a count and take nothing from it. Pairs are made behind the shuffle, in the task that counts them: a sentence goes there from the first code of the task's range on. With many tasks
    these copies grow with the pairs, so they are dealt by rounds of tasks, each of which reads the sentences again and has its shuffled files removed at its end.
    """
    if least < 4:
        return counts(contexts(mentions)).where(F.col("docs_count") >= least)
    some = least // 4
    ship(mentions.sparkSession)
    place = keep(mentions.select("doc_id", "sentence_id", "entity_id").where("entity_id IS NOT NULL").distinct())
    _released(mentions.sparkSession)
    sized = place.withColumn("size", F.count("*").over(Window.partitionBy("doc_id")))
    ranked = sized.withColumn("r", F.dense_rank().over(Window.partitionBy("entity_id").orderBy("size", "doc_id"))).withColumn("n", F.max("r").over(Window.partitionBy("entity_id")))
    early = keep(ranked.where((F.col("n") >= least) & (F.col("r") <= F.col("n") - (least - some))).select("doc_id", "sentence_id", "entity_id", F.hash("entity_id").alias("code")))
    sets = keep(early.groupBy("doc_id", "sentence_id").agg(F.sort_array(F.collect_list("code")).alias("e")).where(F.size("e") > 1).select("e"))
    del sized, ranked
    _released(mentions.sparkSession)
    n = F.size("e").cast("long")
    pairs = sets.agg(F.sum(n * (n - 1) / 2).alias("n")).first()["n"] or 0
    least_tasks = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least_tasks, int(pairs // TASK_PAIRS) + 1)
    size = sets.agg(F.sum(n * F.least(n, F.lit(tasks)) * 2).alias("copies"), F.sum(n * 4).alias("own")).first()
    rounds = max(1, min(-(-int(size["copies"] or 0) // max(ROUND_BYTES, 2 * int(size["own"] or 0))), tasks // least_tasks))
    part = lambda c: F.shiftright((c.cast("long") + F.lit(1 << 31)) * tasks, 32)
    codes = None
    for k in range(rounds):
        lo, hi = tasks * k // rounds, tasks * (k + 1) // rounds
        mine = lambda i: part(F.get("e", i)).between(lo, hi - 1) & ((i == 0) | (part(F.get("e", i)) != part(F.get("e", i - 1))))  # noqa: E731, B023  (called at once)
        each = sets.select("e", F.explode(F.filter(F.sequence(F.lit(0), F.size("e") - 2), mine)).alias("p"))
        dealt = each.select(part(F.get("e", "p")).cast("int").alias("x"), F.slice("e", F.col("p") + 1, F.size("e")).alias("e")).repartitionById(hi - lo, F.col("x") - lo)
        found = dealt.mapInArrow(_counted(tasks, some, TASK_PAIRS), "c int, d int, n long")
        if rounds > 1:
            found = keep(found)
            _released(mentions.sparkSession)
        codes = found if codes is None else codes.unionByName(found)
    named = early.select("entity_id", "code").distinct()
    found = codes.join(named.select(F.col("entity_id").alias("a"), F.col("code").alias("c")), "c").join(named.select(F.col("entity_id").alias("b"), F.col("code").alias("d")), "d").where("a <> b")
    found = keep(found.select(F.least("a", "b").alias("entity_a_id"), F.greatest("a", "b").alias("entity_b_id")).distinct())
    _released(mentions.sparkSession)
    found = keep(_may_share(found, keep(_lists(place)), least))
    _released(mentions.sparkSession)
    side = lambda c: place.withColumnRenamed("entity_id", c)
    return counts(found.join(side("entity_a_id"), "entity_a_id").join(side("entity_b_id"), ["entity_b_id", "doc_id", "sentence_id"])).where(F.col("docs_count") >= least)


def _lists(place: DataFrame) -> DataFrame:
    """``entity_id, h``: 32 bits of each document of entities of few rows, if they tell these apart."""
    few = place.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") <= LISTED).select("entity_id")
    docs = place.join(few, "entity_id").groupBy("entity_id").agg(F.collect_set("doc_id").alias("docs"))
    return docs.select("entity_id", F.transform("docs", lambda d: F.hash(d)).alias("h")).where(F.size("h") == F.size(F.array_distinct("h")))


def _may_share(found: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """The pairs without those that have too few documents in common by their lists, so that few take a row for each document; pairs without lists stay."""
    side = lambda c, h: lists.select(F.col("entity_id").alias(c), F.col("h").alias(h))
    both = found.join(side("entity_a_id", "h"), "entity_a_id", "left").join(side("entity_b_id", "g"), "entity_b_id", "left")
    return both.where(F.col("h").isNull() | F.col("g").isNull() | (F.size(F.array_intersect("h", "g")) >= least)).select(*KEYS)


def _released(spark: SparkSession) -> None:
    """Have the shuffled files of jobs that are over removed: Spark does so when it finds their plans to be garbage, which it else looks for twice an hour."""
    gc.collect()
    spark._jvm.System.gc()


def _counted(tasks: int, some: int, portion: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, from ``some`` on, of the pairs that begin in each row's range ``x``; rows come by ranges, and pairs are summed by portions."""

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        now, held, new, size = None, none, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(new), return_counts=True) if new else none
            return summed(np.concatenate([held[0], keys]), np.concatenate([held[1], n])) if len(held[0]) else (keys, n)

        def told() -> pa.RecordBatch:
            keys, n = merged()
            keys, n = keys[n >= some], n[n >= some]
            code = lambda c: pa.array((c.astype(np.int64) - (1 << 31)).astype(np.int32))
            return pa.RecordBatch.from_arrays([code(keys >> np.uint64(32)), code(keys & np.uint64(0xFFFFFFFF)), pa.array(n.astype(np.int64))], ["c", "d", "n"])

        for batch in batches:
            at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            for k, x in enumerate(batch.column(0).to_pylist()):
                if x != now:
                    if now is not None:
                        yield told()
                    now, held, new, size = x, none, [], 0
                e = (values[at[k] : at[k + 1]].astype(np.int64) + (1 << 31)).astype(np.uint64)
                mine = int(np.searchsorted((e * np.uint64(tasks)) >> np.uint64(32), x, side="right"))
                for i in range(min(mine, len(e) - 1)):
                    new.append((e[i] << np.uint64(32)) | e[i + 1 :])
                    size += len(e) - i - 1
                    if size > portion:
                        held, new, size = merged(), [], 0
        if now is not None:
            yield told()

    return rows


def _chosen(rows: DataFrame, most: int) -> DataFrame:
    within = Window.partitionBy("entity_a_id", "entity_b_id", "doc_id").orderBy("seq", "sentence_id")
    ranked = paired(rows).withColumn("turn", F.row_number().over(within)).where(F.col("turn") <= most)
    across = Window.partitionBy("entity_a_id", "entity_b_id").orderBy("turn", "doc_id")
    return ranked.withColumn("pos", F.row_number().over(across)).where(F.col("pos") <= most).join(rows.select("doc_id", "sentence_id", "sentence_text"), ["doc_id", "sentence_id"])


def evidence(mentions: DataFrame, most: int = EVIDENCE, keep: Keep = lambda rows: rows) -> DataFrame:
    """Sampled sentences of each pair, ``pos`` from 1: each document's first sentence by document id, then the second ones.

    Sentences are chosen by their numbers; texts are joined to the chosen ones alone.
    """
    return _chosen(keep(sentences(mentions)), most).select("entity_a_id", "entity_b_id", "pos", "doc_id", "sentence_text")


def partial(mentions: DataFrame, most: int = EVIDENCE, keep: Keep = lambda rows: rows) -> DataFrame:
    """What a batch of whole documents adds to each pair: ``entity_a_id, entity_b_id, sent_count, docs_count, evidence``.

    ``evidence`` has the batch's best ``most`` sentences as ``turn, doc_id, sentence_text``: turns within a document do not depend on
    others, so the best of all batches are among the best of each. ``keep`` is as in :func:`cooccurrences`.
    """
    rows = keep(sentences(mentions))
    lists = _chosen(rows, most).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("turn", "doc_id", "sentence_text"))).alias("evidence"))
    return counts(paired(rows)).join(lists, KEYS)


def merged(states: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The pairs of all batches from their :func:`partial` states, as :func:`cooccurrences` of all their mentions gives them."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("evidence"))), 1, most)  # a few sentences from each batch
    rows = states.groupBy("entity_a_id", "entity_b_id").agg(F.sum("sent_count").alias("sent_count"), F.sum("docs_count").alias("docs_count"), best.alias("e"))
    return rows.select("entity_a_id", "entity_b_id", "sent_count", "docs_count", F.col("e.doc_id").alias("doc_ids_sample"), F.col("e.sentence_text").alias("evidence_sentences"))


def cooccurrences(mentions: DataFrame, most: int = EVIDENCE, keep: Keep = lambda rows: rows) -> DataFrame:
    """Pairs with counts and parallel lists of evidence documents and sentences.

    Counts, choice and texts each need the :func:`sentences`; ``keep`` may write them to a table, so that mentions are read and shuffled once.
    """
    rows = keep(sentences(mentions))
    lists = _chosen(rows, most).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "sentence_text"))).alias("e"))
    return counts(paired(rows)).join(lists, KEYS).select(*KEYS, "sent_count", "docs_count", F.col("e.doc_id").alias("doc_ids_sample"), F.col("e.sentence_text").alias("evidence_sentences"))


def gathered(rows: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The :func:`cooccurrences` of kept :func:`sentences`, by their keys within each task.

    Pairs are made in the task that counts them: a sentence goes, with its text, to each task that has one of its entities. No row of a pair, and no copy of a text for a pair, is shuffled or sorted.
    """
    return _gathered(rows, most, False, 1, 1).select(*KEYS, "sent_count", "docs_count", F.col("docs").alias("doc_ids_sample"), F.col("texts").alias("evidence_sentences"))


def directed(rows: DataFrame, docs_min: int = 1, sents_min: int = 1, most: int = EVIDENCE) -> DataFrame:
    """The pairs of :func:`gathered` from both ends, those of the least counts alone: ``src, dst, docs_count, sent_count, sample_doc_ids, evidence_sentences``.

    All edges of a start are in one task, which has them by start and falling ``docs_count``.
    """
    names = {"entity_a_id": "src", "entity_b_id": "dst", "docs_count": "docs_count", "sent_count": "sent_count", "docs": "sample_doc_ids", "texts": "evidence_sentences"}
    return _gathered(rows, most, True, docs_min, sents_min).select(*[F.col(a).alias(b) for a, b in names.items()])


def _gathered(rows: DataFrame, most: int, both: bool, docs_min: int, sents_min: int) -> DataFrame:
    spark, n = rows.sparkSession, F.size("e").cast("long")
    ship(spark)
    pairs = rows.agg(F.sum(n * (n - 1) / (1 if both else 2)).alias("n")).first()["n"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs // DEALT_PAIRS) + 1)
    task = F.transform(F.col("e") if both else F.slice("e", F.lit(1), F.size("e") - 1), lambda c: F.pmod(F.hash(c), F.lit(tasks)))
    each = rows.withColumn("t", task).withColumn("x", F.explode(F.array_distinct("t")))
    each = each.withColumn("own", F.filter(F.transform("t", lambda t, i: F.when(t == F.col("x"), i)), lambda i: i.isNotNull()))
    each = each.withColumn("first", F.lit(0) if both else F.get("own", F.lit(0)))  # what stands before the first own entity has no pair here
    place = [F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 62))).alias(c) for c in ("seq", "sentence_id")]
    dealt = each.select("x", "doc_id", *place, "sentence_text", F.slice("e", F.col("first") + 1, F.size("e")).alias("e"), F.transform("own", lambda i: i - F.col("first")).alias("own"))
    schema = "entity_a_id string, entity_b_id string, sent_count long, docs_count long, docs array<string>, texts array<string>"
    return dealt.repartitionById(tasks, F.col("x")).drop("x").mapInArrow(_pairs(most, both, docs_min, sents_min, HELD_PAIRS, BATCH_CHARS, BATCH_ROWS), schema)


def _coded(parts: list[pa.DictionaryArray]) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, 0 for null, and the values by code."""
    one = pa.chunked_array(parts).unify_dictionaries()
    values = one.chunk(0).dictionary
    order = pc.array_sort_indices(values)
    rank = np.zeros(len(values) + 1, np.int64)
    rank[order.to_numpy()] = np.arange(1, len(values) + 1)
    codes = np.concatenate([c.indices.fill_null(len(values)).to_numpy() for c in one.chunks])
    return rank[codes], pa.concat_arrays([pa.nulls(1, values.type), values.take(order)])


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its number says, and which time it is."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _starts(same: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, as flags."""
    return np.r_[True, same[1:] != same[:-1]][: len(same)]


def _pairs(most: int, both: bool, docs_min: int, sents_min: int, portion: int, chars: int, batch_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of a task's sentences ``doc_id, seq, sentence_id, sentence_text, e, own``: of the entities at the places ``own`` with those behind them, or with all others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            if b.num_rows:
                doc, seq, number, text, e, own = b.columns
                size = lambda c: pc.list_value_length(c).to_numpy().astype(np.int64)
                parts.append((doc.dictionary_encode(), pc.list_flatten(e).dictionary_encode(), text.cast(pa.large_string()), seq.to_numpy(), number.to_numpy(), size(e), size(own), pc.list_flatten(own).to_numpy().astype(np.int64)))
        if not parts:
            return
        docs, entities, texts, *numbers = zip(*parts, strict=True)
        (doc, docs), (code, entities), texts = _coded(list(docs)), _coded(list(entities)), pa.chunked_array(texts).combine_chunks()
        seq, number, length, owned, p = map(np.concatenate, numbers)
        del parts, numbers
        size_of = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        turn = np.empty(len(doc), np.int64)  # the order of evidence: by document, then by place
        turn[np.lexsort((number, seq, doc))] = np.arange(len(doc))
        begin, row = np.cumsum(length) - length, np.repeat(np.arange(len(doc)), owned)
        a = code[begin[row] + p]
        order = np.lexsort((turn[row], a))
        a, row, p = a[order], row[order], p[order]
        n = length[row] - 1 if both else length[row] - 1 - p
        ends = np.append(np.flatnonzero(_starts(a))[1:], len(a))
        sums, lo = np.cumsum(n), 0
        while lo < len(a):
            before = sums[lo - 1] if lo else 0
            hi = int(ends[max(np.searchsorted(sums[ends - 1], before + portion, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
            yield from told(*counted(a[lo:hi], row[lo:hi], p[lo:hi], n[lo:hi], begin, code, doc, len(entities)), doc, docs, entities, texts, size_of)
            lo = hi

    def counted(a, row, p, n, begin, code, doc, entities):
        """Keys, counts and rows of evidence of the pairs of some entities."""
        k, w = _spread(n)
        r, p = row[k], p[k]
        key = a[k] * entities + code[begin[r] + (w + (w >= p) if both else p + 1 + w)]
        order = np.argsort(key, kind="stable")  # within a key by turn, as rows come
        key, r = key[order], r[order]
        new = _starts(key)
        run = np.flatnonzero(fresh := new | _starts(doc[r]))
        at, pair = np.flatnonzero(new), np.cumsum(new) - 1
        if not len(at):
            return key, at, at, at, at, r
        sents, of_docs = np.diff(np.append(at, len(key))), np.add.reduceat(fresh.astype(np.int64), at)
        good = (of_docs >= docs_min) & (sents >= sents_min)
        within = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
        c = np.flatnonzero((within < most) & good[pair])
        c = c[np.argsort(pair[c] * most + within[c], kind="stable")]
        many = np.bincount(pair[c], minlength=len(at))
        c = c[_spread(many)[1] < most]
        many = np.minimum(many, most)
        return key[at], sents, of_docs, np.cumsum(many) - many, many, r[c]

    def told(key, sents, of_docs, first, many, r, doc, docs, entities, texts, size_of):
        keep = np.flatnonzero(many)
        if both:
            keep = keep[np.lexsort((key[keep], -of_docs[keep], key[keep] // len(entities)))]
        size = np.append(0, np.cumsum(size_of[r]))
        filled = np.cumsum(size[(first + many)[keep]] - size[first[keep]])
        lo = 0
        while lo < len(keep):
            hi = min(max(int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + chars, side="right")), lo + 1), lo + batch_rows)
            now = keep[lo:hi]
            k, w = _spread(many[now])
            at = r[first[now][k] + w]
            offsets = pa.array(np.append(0, np.cumsum(many[now])), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, docs.take(pa.array(doc[at]))), pa.ListArray.from_arrays(offsets, texts.take(pa.array(at)).cast(pa.string()))]
            ends = [entities.take(pa.array(c)) for c in (key[now] // len(entities), key[now] % len(entities))]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(sents[now], pa.int64()), pa.array(of_docs[now], pa.int64()), *lists], ["entity_a_id", "entity_b_id", "sent_count", "docs_count", "docs", "texts"])
            lo = hi

    return rows
