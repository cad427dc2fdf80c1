"""The property graph as two tables, and the questions asked of it.

Edges are stored in both directions. Every question starts from few seeds and returns few rows: as long as there are no more than ``FEW`` of them their keys
go to the scan of the edges as literals, which then skips all others; more seeds are joined. The best rows leave through a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FilterConfig
from . import filtering
from .names import holding

#: Seeds and results of a question that may be with the driver.
FEW = 1000
DOC_IDS, EVIDENCE = 5, 5
SHARED_DOC_IDS, SHARED_EVIDENCE = 3, 2


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    stats: DataFrame
    #: Posting lists of the vertices' names (:mod:`operators.names`), if they are stored.
    names: DataFrame | None = None


def _taken(df: DataFrame) -> tuple[DataFrame, list | None]:
    """A table of few rows as a constant, with its rows; a larger one as it is."""
    rows = df.limit(FEW + 1).collect()
    return (df, None) if len(rows) > FEW else (F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows)


def _list(c: str, df: DataFrame) -> Column:
    """A list column, null lists as empty; JSON text is read, bad JSON as empty."""
    col = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}) if dict(df.dtypes)[c] == "string" else F.col(c)
    return F.coalesce(col, F.array().cast("array<string>"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Edges in both directions: ``src, dst, docs_count, sent_count, sample_doc_ids, evidence_sentences``."""
    rest = ["docs_count", "sent_count"]
    lists = [_list(a, pairs).alias(b) for a, b in (("doc_ids_sample", "sample_doc_ids"), ("evidence_sentences", "evidence_sentences")) if a in pairs.columns]
    one = pairs.select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst"), *rest, *lists)
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *one.columns[2:]))


def build(entities: DataFrame, pairs: DataFrame, config: FilterConfig = FilterConfig()) -> Graph:
    """All entities, orphans too, the pairs that pass the filters, and how many of each."""
    rows = filtering.named(pairs, entities)
    kept = filtering.filter_rows(rows, config)
    made = rows.agg(F.count_if(filtering.keeps(config)).alias("relationships_created"), F.count("*").alias("n"))
    stats = entities.agg(F.count("*").alias("entities_created")).crossJoin(made)  # two tables of one row
    stats = stats.select("entities_created", "relationships_created", F.lit(0).cast("long").alias("entities_filtered"), (F.col("n") - F.col("relationships_created")).alias("relationships_filtered"))
    return Graph(entities, symmetric(kept), stats)


def kept_edges(edges: DataFrame, entities: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Edges that have both directions already, as :func:`build` keeps them; all stay where they are if the entities are sent to all tasks."""
    pairs = edges.withColumnsRenamed({"src": "entity_a_id", "dst": "entity_b_id"})
    return filtering.filter_rows(filtering.named(pairs, entities), config).select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst"), *edges.columns[2:])


def duplicate_ids(entities: DataFrame) -> DataFrame:
    """Ids that stand more than once; empty for a sound graph."""
    return entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def matches(name: Column, cui: Column, term: str, cuis: list[str] | None) -> Column:
    """By concept if the term is linked to one, else by part of the name, whatever its case."""
    return cui.isin(cuis) if cuis else F.contains(F.lower(name), F.lit(term.lower()))


def seeds(g: Graph, term: str, cuis: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """``src, source_name`` of the vertices that a term stands for: by posting lists where the graph has them and the term is long enough, else by a scan."""
    v = g.vertices
    ids = holding(g.names, term) if g.names is not None and not cuis else None
    if ids is not None:
        ids, rows = _taken(ids)
        v = v.where(F.col("id").isin([r["id"] for r in rows])) if rows is not None else v.join(ids, "id", "left_semi")
    v = v.where(matches(F.col("name"), F.col("umls_cui"), term, cuis))
    return (v.where(F.col("entity_type") == kind) if kind else v).select(F.col("id").alias("src"), F.col("name").alias("source_name"))


LISTS = ("evidence_sentences", "sample_doc_ids")


def _from(edges: DataFrame, rows: list | None, *columns: str) -> DataFrame:
    """The edges that start at one of the rows' keys, by literals; all edges if the rows are not known."""
    return edges if rows is None else edges.where(F.col("src").isin(sorted({r[c] for r in rows for c in columns})))


def _seed_edges(g: Graph, term: str, cuis: list[str] | None, kind: str | None = None, least: int = 0) -> DataFrame:
    """Edges of the matched vertices without their lists, which a scan then does not read; keys and the least number of documents are pushed down."""
    start, rows = _taken(seeds(g, term, cuis, kind))
    return _from(g.edges.where(F.col("docs_count") >= least).drop(*LISTS), rows, "src").join(start, "src")


def _with_lists(g: Graph, rows: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """The lists of the few edges ``(src, dst, prefix of the lists' names)`` of ``rows``, which a question returns."""
    few, known = _taken(rows)
    for src, dst, prefix in pairs:
        lists = _from(g.edges, known, src).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), *[F.col(c).alias(f"{prefix}{c}") for c in LISTS])
        few = lists.join(F.broadcast(few), (F.col("_s") == F.col(src)) & (F.col("_d") == F.col(dst)), "right").drop("_s", "_d") if known is not None else few.join(lists, (F.col("_s") == F.col(src)) & (F.col("_d") == F.col(dst)), "left").drop("_s", "_d")
    return few


def neighbors(g: Graph, term: str, *, cuis: list[str] | None = None, seed_type: str | None = None, neighbor_type: str | None = None, min_evidence: int = 3, limit: int = 20) -> DataFrame:
    """Neighbours of the matched entities, each by its best edge, by documents; names and ids break ties."""
    v = g.vertices.select(F.col("id").alias("dst"), F.col("name").alias("neighbor_name"), F.col("entity_type").alias("neighbor_type"))
    v = v.where(F.col("neighbor_type") == neighbor_type) if neighbor_type else v
    hits = _seed_edges(g, term, cuis, seed_type, min_evidence)
    best = Window.partitionBy("dst").orderBy(F.desc("docs_count"), F.desc("sent_count"), "src")
    top = hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(v, "dst")
    order = [F.desc("docs_count"), "neighbor_name", "neighbor_id"]
    few = top.withColumn("neighbor_id", F.col("dst")).orderBy(*order).limit(limit)
    return _with_lists(g, few, ("src", "dst", "")).select("source_name", "neighbor_name", "neighbor_type", "neighbor_id", "docs_count", "sent_count", "evidence_sentences", F.slice("sample_doc_ids", 1, DOC_IDS).alias("sample_doc_ids")).orderBy(*order)


def disease_genes(g: Graph, disease: str, *, cuis: list[str] | None = None, min_evidence: int = 5, limit: int = 20) -> DataFrame:
    return neighbors(g, disease, cuis=cuis, seed_type="disease", neighbor_type="gene", min_evidence=min_evidence, limit=limit).withColumnRenamed("source_name", "disease_name").drop("neighbor_type")


def gene_diseases(g: Graph, gene: str, *, cuis: list[str] | None = None, min_evidence: int = 5, limit: int = 20) -> DataFrame:
    return neighbors(g, gene, cuis=cuis, seed_type="gene", neighbor_type="disease", min_evidence=min_evidence, limit=limit).withColumnRenamed("source_name", "gene_name").drop("neighbor_type")


def explain(g: Graph, a: str, b: str, *, cuis_a: list[str] | None = None, cuis_b: list[str] | None = None) -> DataFrame:
    """The best edge between two match sets; one row in any case, ``found`` false with counts 0 if there is none."""
    ends = seeds(g, b, cuis_b).select(F.col("src").alias("dst"), F.col("source_name").alias("entity_b_name"))
    types = lambda s: g.vertices.select(F.col("id").alias(s), F.col("entity_type").alias(f"entity_{'a' if s == 'src' else 'b'}_type"))
    hits = _seed_edges(g, a, cuis_a).withColumnRenamed("source_name", "entity_a_name").join(ends, "dst")
    best = _with_lists(g, hits.orderBy(F.desc("docs_count"), F.desc("sent_count"), "src", "dst").limit(1), ("src", "dst", "")).join(types("src"), "src").join(types("dst"), "dst").withColumn("found", F.lit(True))
    empty = F.array().cast("array<string>")
    row = g.vertices.sparkSession.range(1).join(best, F.lit(True), "left")
    return row.select(
        F.coalesce("entity_a_name", F.lit(a)).alias("entity_a_name"), F.coalesce("entity_b_name", F.lit(b)).alias("entity_b_name"), "entity_a_type", "entity_b_type", F.coalesce("docs_count", F.lit(0)).alias("docs_count"),
        F.coalesce("sent_count", F.lit(0)).alias("sent_count"), F.coalesce(F.slice("evidence_sentences", 1, EVIDENCE), empty).alias("evidence_sentences"), F.coalesce(F.slice("sample_doc_ids", 1, DOC_IDS), empty).alias("sample_doc_ids"), F.coalesce("found", F.lit(False)).alias("found"),
    )


def shared_neighbors(g: Graph, a: str, b: str, *, cuis_a: list[str] | None = None, cuis_b: list[str] | None = None, neighbor_type: str | None = None, min_evidence: int = 3, limit: int = 20) -> DataFrame:
    """Entities linked to a match of both terms, by the best pair of edges from two different matches.

    Of each side the two best edges of an entity suffice: if the best ones of both sides start at one match, the best
    allowed pair has the second one of a side. So no product of all matches is ever made.
    """

    def side(term: str, cuis: list[str] | None, s: str) -> DataFrame:
        order = Window.partitionBy("dst").orderBy(F.desc("docs_count"), "src")
        hits = _seed_edges(g, term, cuis, least=min_evidence).withColumn("_r", F.row_number().over(order)).where("_r <= 2")
        return hits.select("dst", *[F.col(c).alias(f"{s}_{c}") for c in ("src", "source_name", "docs_count", "sent_count")])

    both = side(a, cuis_a, "a").join(side(b, cuis_b, "b"), "dst").where("a_src <> b_src").withColumn("docs_count", F.col("a_docs_count") + F.col("b_docs_count"))
    best = Window.partitionBy("dst").orderBy(F.desc("docs_count"), "a_src", "b_src")
    v = g.vertices.select(F.col("id").alias("dst"), F.col("name").alias("neighbor_name"), F.col("entity_type").alias("neighbor_type"))
    v = v.where(F.col("neighbor_type") == neighbor_type) if neighbor_type else v
    lists = lambda c, n: F.concat(F.slice(f"a_{c}", 1, n), F.slice(f"b_{c}", 1, n)).alias(c)
    order = [F.desc("docs_count"), "neighbor_name", "neighbor_id"]
    top = both.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(v, "dst").withColumn("neighbor_id", F.col("dst")).orderBy(*order).limit(limit)
    top = _with_lists(g, top, ("a_src", "dst", "a_"), ("b_src", "dst", "b_"))
    out = top.select("neighbor_name", "neighbor_type", "neighbor_id", F.col("a_source_name").alias("entity_a_name"), F.col("b_source_name").alias("entity_b_name"), "docs_count", (F.col("a_sent_count") + F.col("b_sent_count")).alias("sent_count"), lists("evidence_sentences", SHARED_EVIDENCE), lists("sample_doc_ids", SHARED_DOC_IDS))
    return out.orderBy(*order)


def between_types(g: Graph, kind_a: str, kind_b: str, *, min_evidence: int = 5, limit: int = 20) -> DataFrame:
    """The best-supported pairs of two entity types, each pair once."""
    side = lambda s, kind: g.vertices.where(F.col("entity_type") == kind).select(F.col("id").alias(s), F.col("name").alias("entity_a_name" if s == "src" else "entity_b_name"))
    rows = g.edges.where(F.col("docs_count") >= min_evidence).drop(*LISTS).join(side("src", kind_a), "src").join(side("dst", kind_b), "dst")
    rows = rows.where("src < dst") if kind_a == kind_b else rows
    return rows.select("entity_a_name", "entity_b_name", F.col("src").alias("entity_a_id"), F.col("dst").alias("entity_b_id"), "docs_count", "sent_count").orderBy(F.desc("docs_count"), F.desc("sent_count"), "entity_a_id", "entity_b_id").limit(limit)


def named_pair(g: Graph, a: str, b: str) -> DataFrame:
    """The edges between entities of exactly these names, whatever their case, strongest first."""
    side = lambda s, name: g.vertices.where(F.lower("name") == name.lower()).select(F.col("id").alias(s))
    rows = g.edges.join(side("src", a), "src").join(side("dst", b), "dst")
    return rows.orderBy(F.desc("docs_count"), F.desc("sent_count"), "src", "dst")