"""Token-id files: canonical length-limited Huffman coding in independent blocks.

Three passes. Texts are tokenised where they are read and the ids written once; their counts, summed over the whole corpus,
give one code with code words of :data:`LIMIT` bits at most; documents are coded, dealt to ranges of ids, sorted and
packed into blocks. A file set is a folder with two Parquet tables:

* ``code``: one row for each id that occurs, with the length of its code word. Lengths alone determine the canonical code.
* ``blocks``: ``range, block`` (order), ``start`` (ids before the block within its range), ``doc_ids``, ``lengths``,
  ``bit_offsets`` (checkpoints: where each run of :data:`STEP` ids begins, documents starting on whole bytes) and
  ``payload``. A block needs nothing but the code to be read, and its checkpoints can all be read at once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Splitter
from .native import constants, range_bounds, range_of
from .tables import cut, drop, rows_of, ship, slices
from .word_ids import BLOCK, WordIds, pieces, plain

LIMIT, STEP = 20, 1024
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: Documents of one range of ids, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500, 16_384


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code-word lengths of at most ``limit`` bits for positive ``counts`` (package-merge).

    At each of ``limit`` levels the items are merged with the pairs of the level before. Of the cheapest ``2 n - 2`` of the
    last level, each item adds a bit to itself and each pair asks for two of the level before; as all lists are
    sorted, the items taken at a level are a prefix of the sorted items.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit code words of {limit} bits")
    order = np.argsort(counts, kind="stable")
    items = counts[order].astype(np.int64)
    pairs, levels = np.empty(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([items, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        even = len(both) // 2 * 2
        pairs = both[0:even:2] + both[1:even:2]
    taken, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_item in reversed(levels):
        k = int(is_item[:taken].sum())
        lengths[:k] += 1
        taken = 2 * (taken - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code words in order of length, then id; each is the one before plus one, drawn out to its length."""
    order = np.lexsort((ids, lengths))
    codes, code, last = np.zeros(len(ids), np.uint64), 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Code:
    """Coder and decoder of one canonical code."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits = int(lengths.max()) if len(ids) else 1
        self.word, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word[ids], self.length[ids] = canonical(ids, lengths), lengths
        self.table = np.zeros(1 << self.bits, np.int64)  # id * 64 + length, for all windows that begin with the word
        order = np.lexsort((ids, lengths))
        spans = 1 << (self.bits - lengths[order])
        filled = np.repeat(ids[order].astype(np.int64) * 64 + lengths[order], spans)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Coded documents, each on a whole byte: the bytes, where each document begins in them, bit offset of each id."""
        n = self.length[ids]
        ends = np.cumsum(n)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        before = np.concatenate([[0], ends])[first]
        bits = np.concatenate([[0], ends])[first + counts] - before
        begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
        at = ends - n - np.repeat(before - begin[:-1] * 8, counts)
        out = np.zeros(int(begin[-1]) // 4 + 3, np.uint64)
        if len(ids):
            word = at >> 5
            value = self.word[ids] << (np.uint64(64) - n.astype(np.uint64) - (at & 31).astype(np.uint64))
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[head]] += np.add.reduceat(value >> np.uint64(32), head)
            out[word[head] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), head)
        return out.astype(">u4").tobytes()[: int(begin[-1])], begin, at

    def decode(self, payload: bytes, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of all segments in order; the segments, at bit ``offsets`` with ``lengths`` ids, are read side by side."""
        raw = np.frombuffer(payload + bytes(8), np.uint8)
        total = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(int(total[-1]), np.int64)
        order = np.argsort(-lengths, kind="stable")
        at, to, left = offsets[order].astype(np.int64), total[:-1][order], lengths[order]
        alive = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(left) else []
        window = np.zeros(len(raw) - 3, np.uint32)  # 32 bits from each byte on
        for i in range(4):
            window |= raw[i : len(raw) - 3 + i].astype(np.uint32) << np.uint32(24 - 8 * i)
        down, mask = 32 - self.bits, (1 << self.bits) - 1
        for step, k in enumerate(alive):
            p = at[:k]
            entry = self.table[(window[p >> 3] >> (down - (p & 7)).astype(np.uint32)) & mask] if down >= 7 else self._slow(raw, p)
            out[to[:k] + step] = entry >> 6
            p += entry & 63
        return out

    def _slow(self, raw: np.ndarray, p: np.ndarray) -> np.ndarray:
        b = p >> 3
        value = sum(raw[b + i].astype(np.int64) << (32 - 8 * i) for i in range(5))
        return self.table[(value >> (40 - self.bits - (p & 7))) & ((1 << self.bits) - 1)]


class LibraryIds:
    """Ids of texts from the ``tokenizers`` library.

    Each text goes to the library as a whole, but for texts without special tokens that are Latin where the vocabulary file states
    the known splitter: of these the library encodes each distinct word once, for as long as :class:`WordIds` remembers it.
    """

    def __init__(self, spec: str, word_memo: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.split = Splitter(spec)
        self.words = WordIds(self._many, self.kind, word_memo)

    def _alone(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, self.kind).tobytes()

    def _many(self, words: list[str], at_once: int = 2000) -> list[bytes]:
        parts = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        found = self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        out = []
        for part, one in zip(parts, found, strict=True):
            ids = np.array(one.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, size = ids.tobytes(), self.kind.itemsize
                marks = [0, *(cuts * size).tolist()]
                out += [raw[a:b] for a, b in zip(marks, marks[1:], strict=False)]
            else:
                out += map(self._alone, part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes of :attr:`kind`."""
        out: list[list[bytes]] = [[] for _ in texts]
        block, owners, size = [], [], 0

        def flush():
            for i, ids in zip(owners, self.words.encode(block), strict=True):
                out[i].append(ids)
            block.clear()
            owners.clear()

        for i, text in enumerate(texts):
            low = plain(text or "") if self.split.known and not self.split.has_special(text or "") else None
            if low is None:
                out[i].append(self._alone(text or ""))
                continue
            for piece in pieces(low):
                block.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]


@lru_cache(2)
def library(spec: str) -> LibraryIds:
    return LibraryIds(spec)


@lru_cache(4)
def _code(ids: bytes, lengths: bytes) -> Code:
    return Code(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64))


def _tokenised(batches: Iterator[pa.RecordBatch], spec: str, end_id: int) -> Iterator[pa.RecordBatch]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    lib = library(spec)
    end = np.array([end_id], lib.kind).tobytes()
    for batch in slices(batches):
        ids = [x + end for x in lib.encode(batch.column(batch.schema.get_field_index("text")).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // lib.kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "range", "n", "ids"])


def _counted(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in slices(batches, 2048):
        c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
        if len(c) > len(total):
            c[: len(total)] += total
            total = c
        else:
            total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])


def _coded(batches: Iterator[pa.RecordBatch], kind: str, ids: bytes, lengths: bytes) -> Iterator[pa.RecordBatch]:
    code = _code(ids, lengths)
    for batch in slices(batches):
        if not batch.num_rows:
            continue
        n = batch.column(2).to_numpy()
        payload, begin, at = code.encode(np.frombuffer(b"".join(batch.column(3).to_pylist()), kind).astype(np.int64), n)
        first = np.concatenate([[0], np.cumsum(n)])
        marks = [(at[a:b:STEP] - 8 * begin[i]).astype("<i8").tobytes() for i, (a, b) in enumerate(zip(first, first[1:], strict=False))]
        coded = [payload[a:b] for a, b in zip(begin, begin[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(marks, pa.binary()), pa.array(coded, pa.binary())], ["doc_id", "range", "n", "marks", "coded"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted by range and id."""
    names = ["range", "block", "start", "doc_ids", "lengths", "bit_offsets", "payload"]

    def closed():
        offsets = np.concatenate([np.frombuffer(m, "<i8") + 8 * b for m, b in zip(marks, begins, strict=True)])
        return pa.RecordBatch.from_arrays([
            pa.array([now], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(coded)], pa.binary())], names)

    now, block, start, size = None, 0, 0, 0
    docs, lengths, marks, begins, coded = [], [], [], [], []
    for batch in batches:
        for doc, at, n, mark, part in rows_of(batch, "doc_id", "range", "n", "marks", "coded"):
            if docs and (at != now or size >= BLOCK_BYTES or len(docs) >= BLOCK_DOCS):
                yield closed()
                block, start, size = block + 1, start + sum(lengths), 0
                docs, lengths, marks, begins, coded = [], [], [], [], []
            if at != now:
                now, block, start = at, 0, 0
            docs.append(doc)
            lengths.append(n)
            marks.append(mark)
            begins.append(size)
            coded.append(part)
            size += len(part)
    if docs:
        yield closed()


def _read(batches: Iterator[pa.RecordBatch], ids: bytes, lengths: bytes, digests: bool) -> Iterator[pa.RecordBatch]:
    code = _code(ids, lengths)
    for batch in slices(batches, 1):
        for start, docs, n, offsets, payload in rows_of(batch, "start", "doc_ids", "lengths", "bit_offsets", "payload"):
            n = np.array(n, np.int64)
            runs = (n + STEP - 1) // STEP
            size = np.full(int(runs.sum()), STEP, np.int64)
            size[np.cumsum(runs) - 1] = n - (runs - 1) * STEP
            found = code.decode(payload, np.array(offsets, np.int64), size).astype("<u4")
            first = np.concatenate([[0], np.cumsum(n)])
            spans = list(zip(first.tolist(), first[1:].tolist(), strict=False))
            out = pa.array([zlib.crc32(found[a:b].tobytes()) for a, b in spans], pa.int64()) if digests else pa.array([found[a:b] for a, b in spans], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + first[:-1], pa.int64()), pa.array(n, pa.int64()), out], ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])


def write_ids(docs: DataFrame, path: str, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Write the ids of all whole texts, each with ``end_id`` behind them, in ascending order of id, to the folder ``path``.

    Only the counts of the vocabulary's ids and the bounds of ranges (16,384 at most) reach the driver. Coded documents, not
    ids, are shuffled, by ranges of ids, so that no task sees them all.

    Cases: null or empty text is the end id alone; null ids come first; rows repeated under one id are ordered by what they
    are coded to; no rows give tables without rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = range_bounds(base, "doc_id", RANGE_ROWS, MOST_RANGES)
    base = base.select("doc_id", range_of(F.col("doc_id"), bounds).cast("int").alias("range"), "text")
    kind = library(spec).kind.str
    ids = cut(base.mapInArrow(lambda it: _tokenised(it, spec, end_id), "doc_id long, range int, n long, ids binary"), "ids", compression="zstd")
    counts = ids.select("ids").mapInArrow(lambda it: _counted(it, kind), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).orderBy("id").toPandas()
    lengths = code_lengths(counts["count"].to_numpy(np.int64))
    a, b = counts["id"].to_numpy(np.int64).tobytes(), lengths.astype(np.int64).tobytes()
    spark.createDataFrame(list(zip(counts["id"].tolist(), lengths.tolist(), strict=True)), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    coded = ids.mapInArrow(lambda it: _coded(it, kind, a, b), "doc_id long, range int, n long, marks binary, coded binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = coded.repartition(parts, "range").sortWithinPartitions("range", "doc_id", "n", "coded")
    placed.mapInArrow(_blocks, "range int, block int, start long, doc_ids array<bigint>, lengths array<bigint>, bit_offsets array<bigint>, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop(ids)


def read_ids(spark: SparkSession, path: str, *, digests: bool = False) -> DataFrame:
    """The documents of a file set: ``doc_id, start, n_tokens, ids``, with ``digests`` ``ids_crc32`` instead of ids.

    ``start`` is the number of ids of all documents before. ``ids_crc32`` is over unsigned little-endian 32-bit ids. The code and one
    sum for each range reach the driver; a task holds one block.

    Cases: repeated and null ids come back as they were written; a file set without documents gives no rows; a folder that is no
    file set raises.
    """
    ship(spark)
    code = spark.read.parquet(f"{path}/code").orderBy("id").toPandas()
    a, b = code["id"].to_numpy(np.int64).tobytes(), code["length"].to_numpy(np.int64).tobytes()
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = blocks.select("range", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n).alias("n")).groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    before, total = [], 0
    for r in sums:
        before.append(total)
        total += r["n"]
    offsets = F.broadcast(constants(spark, range=[r["range"] for r in sums], before=before))  # as many rows as ranges
    placed = blocks.join(offsets, "range").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "bit_offsets", "payload")
    out = "ids_crc32 long" if digests else "ids array<bigint>"
    return placed.mapInArrow(lambda it: _read(it, a, b, digests), f"doc_id long, start long, n_tokens long, {out}")
