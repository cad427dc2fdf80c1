"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Within a shard, vectors join the graph in growing batches. A greedy search from the entry point proposes neighbours
for each new vector; relaxed distance pruning keeps the nearest and then only those that no kept neighbour is nearer to
by the factor ``ALPHA``; the reverse arcs are added and pruned alike. Queries run a beam search in every shard, and
the shards' nearest are merged. Searches of a batch run side by side in numpy.

How wide a beam must be depends on the vectors. So each graph is tried, before the last vectors of its shard join it, with
these as queries against a scan, and the beam widened by half until the recall is ``RECALL``. A shard of which the beam
would have to hold a quarter is scanned.

Nearness is the inner product. The graph uses Euclidean distance in one more dimension, ``sqrt(m^2 - |x|^2)`` with the
shard's largest norm ``m``, in which the order of distances to a query is the order of inner products.
Equal vectors are one node: copies can neither crowd out other neighbours nor cut the graph apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, drop, ship

#: Arcs of a node, width of the searches that build the graph, and how much nearer a kept neighbour must be to cover another.
DEGREE, WIDTH, ALPHA = 32, 64, 1.2
#: The least beam, vectors of a shard, the mean recall that a shard's last vectors must reach and how many these are.
BEAM, SHARD_ROWS, RECALL, TRIED = 64, 10_000, 0.99, 100
#: Queries searched side by side, and nodes of each that one step opens.
BLOCK, STEP = 256, 16


def beam_search(vectors: np.ndarray, arcs: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of each query's ``width`` nearest nodes that a greedy search meets, nearest first.

    Each step opens the :data:`STEP` nearest nodes of a query's beam that are still closed. ``arcs`` has -1 for absent arcs. Missing
    results are -1 at infinity.
    """
    q, n = len(queries), len(vectors)
    nodes = np.full((q, width), -1, np.int32)
    dist = np.full((q, width), np.inf, np.float32)
    left = dist.copy()  # the distances of closed nodes
    nodes[:, 0] = entry
    squares, own = (vectors**2).sum(1), (queries**2).sum(1)
    dist[:, 0] = left[:, 0] = ((queries - vectors[entry]) ** 2).sum(1)
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    stamp = np.empty((q, n), np.int16)
    rows, step = np.arange(q), min(STEP, width)
    while len(rows):
        at = rows[:, None]
        first = np.argpartition(left[rows], step - 1, 1)[:, :step] if step < width else np.broadcast_to(np.arange(width), (len(rows), width))
        opened = np.isfinite(left[at, first])
        left[at, first] = np.inf
        near = np.where(opened[:, :, None], arcs[nodes[at, first]], -1).reshape(len(rows), -1)
        r, c = np.nonzero((near >= 0) & ~seen[at, near])
        v, of = near[r, c], rows[r]
        stamp[of, v] = c  # of a node met twice in one step one place counts
        once = stamp[of, v] == c
        r, c, v, of = r[once], c[once], v[once], of[once]
        seen[of, v] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = squares[v] + own[of] - 2 * np.einsum("nd,nd->n", queries[of], vectors[v])
        both = np.concatenate([dist[rows], d], 1)
        keep = np.argpartition(both, width - 1, 1)[:, :width]
        dist[rows] = np.take_along_axis(both, keep, 1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], near.astype(np.int32)], 1), keep, 1)
        left[rows] = np.take_along_axis(np.concatenate([left[rows], d], 1), keep, 1)
        rows = rows[np.isfinite(left[rows]).any(1)]
    order = np.argsort(dist, 1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isinf(dist), -1, np.take_along_axis(nodes, order, 1)).astype(np.int64), dist


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``nodes`` up to ``degree`` of its candidates ``found`` (-1: none), by relaxed distance pruning."""
    found = np.where(found == nodes[:, None], -1, found)
    order = np.argsort(found, 1)
    s = np.take_along_axis(found, order, 1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = -1  # repeated candidates
    v = vectors[s]
    d = ((v - vectors[nodes][:, None]) ** 2).sum(2)
    d = np.where(s < 0, np.inf, d)
    cross = v @ v.transpose(0, 2, 1)
    sq = (v**2).sum(2)
    cross = sq[:, :, None] + sq[:, None, :] - 2 * cross
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    left = d.copy()
    for k in range(degree):
        best = left.argmin(1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        out[:, k] = np.where(ok, s[rows, best], -1)
        covered = alpha * alpha * cross[rows, best] <= d
        left = np.where(covered & ok[:, None], np.inf, left)
        left[rows, best] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = WIDTH, alpha: float = ALPHA, seed: int = 3, late: int = 0, pause: Callable[[np.ndarray, int, np.ndarray], None] | None = None) -> tuple[np.ndarray, int]:
    """Arcs (-1: absent) and the entry point, the vector nearest to the mean.

    ``pause`` is called with arcs, entry point and the last ``late`` vectors before these join the graph.
    """
    n = len(vectors)
    arcs = np.full((n, degree), -1, np.int64)
    entry = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    rest = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    rest = rest[rest != entry]
    at, batch, stop = 0, 1, max(0, len(rest) - late) if pause else -1
    while at < len(rest):
        if at == stop:
            pause(arcs, entry, rest[at:])
        new = rest[at : min(at + batch, stop) if at < stop else at + batch]
        found, _ = beam_search(vectors, arcs, entry, vectors[new], width)
        if batch > 1:  # vectors of one batch do not see each other in the graph yet
            d = ((vectors[new] ** 2).sum(1)[None, :] - 2 * vectors[new] @ vectors[new].T).astype(np.float32)
            np.fill_diagonal(d, np.inf)
            k = min(degree // 2, len(new) - 1)
            found = np.concatenate([found, new[np.argpartition(d, k - 1, 1)[:, :k]]], 1)
        arcs[new] = robust_prune(vectors, new, found, degree, alpha)
        source, target = np.repeat(new, degree), arcs[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, size = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, size)
        for low in range(0, len(heads), 512):
            part = heads[low : low + 512]
            inside = (target >= part[0]) & (target <= part[-1])
            extra = np.full((len(part), int(size[low : low + 512].max())), -1, np.int64)
            extra[np.searchsorted(part, target[inside]), place[inside]] = source[inside]
            arcs[part] = robust_prune(vectors, part, np.concatenate([arcs[part], extra], 1), degree, alpha)
        at += len(new)
        batch = min(256, 2 * batch, max(1, at // 4 + 1))
    return arcs, entry


def raised(vectors: np.ndarray) -> np.ndarray:
    """The vectors with the dimension that turns inner products into distances."""
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1).astype(np.float32)


def ranked(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``scores`` the places of its ``k`` largest, ties by the smaller name, and whether there is one."""
    if scores.shape[1] > 4 * k:  # what is below the k-th largest cannot matter
        least = -np.partition(-scores, k - 1, 1)[:, k - 1 : k]
        wide = int((scores >= least).sum(1).max())
        part = np.argpartition(-np.where(scores >= least, scores, -np.inf), min(wide, scores.shape[1] - 1), 1)[:, :wide]
    else:
        part = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    s, n = np.take_along_axis(scores, part, 1), np.take_along_axis(names, part, 1)
    order = np.lexsort((n, -s), axis=1)[:, :k]
    return np.take_along_axis(part, order, 1), np.isfinite(np.take_along_axis(s, order, 1))


class Shard:
    """A shard's vectors and graph, to be searched."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray, arcs: np.ndarray, entry: int):
        self.vectors, self.names, self.arcs, self.entry = vectors, names, arcs, entry
        self.exact = vectors.astype(np.float64)
        self.high = raised(vectors)

    def search(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the ``k`` nearest of each query, their inner products in double precision and whether there is one.

        ``beam`` 0 scans the shard.
        """
        if not beam:
            scores = queries.astype(np.float64) @ self.exact.T
            top, ok = ranked(scores, np.broadcast_to(self.names, scores.shape), k)
            found = top
        else:
            q = np.concatenate([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)], 1)
            found, _ = beam_search(self.high, self.arcs, self.entry, q, max(beam, 2 * k))
            scores = np.einsum("qd,qwd->qw", queries.astype(np.float64), self.exact[found])
            scores = np.where(found < 0, -np.inf, scores)
            top, ok = ranked(scores, self.names[found], k)
            found = np.take_along_axis(found, top, 1)
        if beam:
            return found, np.take_along_axis(scores, top, 1), ok
        exact = np.einsum("qd,qkd->qk", queries.astype(np.float64), self.exact[found])  # the same sums as of a beam's
        return found, exact, ok

    def beam_for(self, late: np.ndarray, k: int, least: int) -> int:
        """The least beam, widened by half from ``least``, by which vectors that are not in the graph yet find what a scan finds; 0: scan."""
        n = len(self.vectors) - len(late)
        queries = self.vectors[late]
        scores = queries.astype(np.float64) @ self.exact.T
        scores[:, late] = -np.inf
        want, _ = ranked(scores, np.broadcast_to(self.names, scores.shape), min(k, n))
        beam = max(least, 2 * k)
        while 4 * beam < n:
            got, _, ok = self.search(queries, min(k, n), beam)
            if np.mean([len(np.intersect1d(w, g[o])) / len(w) for w, g, o in zip(want, got, ok, strict=True)]) >= RECALL:
                return beam
            beam += beam // 2
        return 0


def indexed(vectors: np.ndarray, names: np.ndarray, k: int, least: int) -> tuple[Shard, int]:
    """The shard of ``vectors`` with its graph, and its beam (0: scan)."""
    high, beam = raised(vectors), 0

    def measure(arcs: np.ndarray, entry: int, late: np.ndarray) -> None:
        nonlocal beam
        beam = Shard(vectors, names, arcs, entry).beam_for(late, k, least)

    arcs, entry = build(high, late=min(TRIED, len(vectors) // 10), pause=measure if least >= 0 else None)
    return Shard(vectors, names, arcs, entry), beam


def _built(pdf: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    n, names = len(pdf), pdf["node"].to_numpy()
    shard, width = indexed(np.array(pdf["embedding"].tolist()), names, k, beam)
    return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "kind": np.zeros(n, np.int32), "place": np.arange(n), "id": names, "entry": np.arange(n) == shard.entry, "beam": np.full(n, width, np.int32), "embedding": pdf["embedding"].to_numpy(), "arcs": [a[a >= 0] for a in shard.arcs]})


def _lists(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers to queries that come behind the nodes of their shard; one shard and one batch are held at a time."""
    names = ["query_id", "node", "score"]
    nodes: list[pa.RecordBatch] = []
    shard: Shard | None = None
    now = beam = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
        for low, high in zip(edges, edges[1:], strict=False):
            part, of, kind = batch.slice(low, high - low), mark[low] // 2, mark[low] % 2
            if of != now:
                now, shard, nodes = of, None, []
            if kind == 0:
                nodes.append(part)
                continue
            if shard is None:
                if not nodes:
                    continue  # a shard without vectors
                t = pa.Table.from_batches(nodes).combine_chunks()
                lists = t["arcs"].chunk(0)
                size = lists.value_lengths().to_numpy()
                arcs = np.full((len(t), max(1, int(size.max()))), -1, np.int64)
                arcs[np.repeat(np.arange(len(t)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
                shard = Shard(_lists(t["embedding"].chunk(0)), t["id"].to_numpy(), arcs, int(np.flatnonzero(t["entry"].to_numpy())[0]))
                beam, nodes = t["beam"][0].as_py(), []
            ids, queries = part.column(3).to_numpy(), _lists(part.column(6))
            for at in range(0, len(ids), BLOCK):
                found, score, ok = shard.search(queries[at : at + BLOCK], k + 1, beam)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + BLOCK], ok.sum(1)), pa.int64()), pa.array(shard.names[found[ok]], pa.int64()), pa.array(score[ok], pa.float64())], names)


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS, exact: bool = False) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows of ``vectors`` by inner product: ``query_id, rank, vec_id, score``.

    The query's own id is no candidate. Ranks start at 1, ties go to the smaller id, scores are computed in double
    precision from the original vectors. All vectors are indexed, dealt by their own values to shards of about ``shard_rows``. One
    task builds a shard, one task reads it once and answers its queries as they stream by; every shard gets every query. Of
    equal vectors the ``k + 1`` smallest ids suffice. ``beam`` is the least width of a beam, ``exact`` scans all shards.

    Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers take no part,
    as query or candidate, nor do null ids; rows repeated under one id and vector count once; fewer candidates than
    ``k`` give fewer rows; no rows, no result; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{number}>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)

    base, asked = usable(vectors), usable(queries)
    sizes = base.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, asked = (df.where(F.size("embedding") == sizes["d"]) for df in (base, asked.dropDuplicates(["vec_id", "embedding"])))
    same = Window.partitionBy("embedding").orderBy("vec_id")
    members = base.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    members = members.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    members = cut(members.select(F.get("ids", F.lit(0)).alias("node"), "ids", "embedding"), "members")
    shards = max(1, -(-members.count() // shard_rows))
    nodes = members.select("node", "embedding", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"))
    least = -1 if exact else beam
    row = f"shard int, kind int, place long, id long, entry boolean, beam int, embedding array<{number}>, arcs array<int>"
    graph = cut(nodes.repartitionById(shards, "shard").groupBy("shard").applyInPandas(lambda pdf: _built(pdf, k, least), row), "graph")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    lines = asked.select(each, F.lit(1).alias("kind"), F.col("vec_id").alias("place"), F.col("vec_id").alias("id"), F.lit(False).alias("entry"), F.lit(0).alias("beam"), "embedding", F.array().cast("array<int>").alias("arcs"))
    stream = graph.unionByName(lines).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "place")
    found = cut(stream.mapInArrow(lambda it: _answers(it, k), "query_id long, node long, score double"), "found")
    drop(graph)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    named = found.join(members.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
