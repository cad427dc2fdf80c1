"""Documents: conversion from articles, storage form, upsert and resume."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

PROMOTED = ("journal", "authors", "document_type", "doi", "keywords", "mesh_terms")


def _extras(names: tuple[str, ...]) -> Column:
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def _internal(df: DataFrame, source: str, names: tuple[str, ...]) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(F.col("pmid").alias("id"), text("title").alias("title"), text("abstract").alias("text"), F.lit(source).alias("source"), F.col("year").cast("int").alias("pub_year"), _extras(names).alias("extras"))


def from_abstracts(articles: DataFrame) -> DataFrame:
    """Abstract records as documents; metadata that is not empty goes to ``extras``."""
    return _internal(articles, "pubmed", ("journal", "authors", "mesh_terms", "doi", "keywords", "document_type"))


def from_full_texts(articles: DataFrame) -> DataFrame:
    """Full-text records as documents."""
    return _internal(articles, "pmc", ("journal", "authors", "mesh_terms", "doi", "pmc_id"))


def processed(docs: DataFrame, mentions: DataFrame, config_json: str) -> DataFrame:
    """Storage form: six metadata fields as columns, the other extras as JSON or null, and the number of entities."""
    counts = mentions.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("entity_count"))
    rest = F.map_filter("extras", lambda k, _: ~k.isin(*PROMOTED))
    promoted = [F.try_element_at("extras", F.lit(c)).alias(c) for c in PROMOTED]
    rows = docs.select("id", "title", "text", "source", "pub_year", *promoted, F.when(F.size(rest) > 0, F.to_json(rest)).alias("extras_json"), F.lit(config_json).alias("config_json"), F.current_timestamp().alias("processed_at"))
    return rows.join(counts, "id", "left").withColumn("entity_count", F.coalesce("entity_count", F.lit(0)).cast("long"))


def restored(stored: DataFrame) -> DataFrame:
    """Documents again from their storage form, promoted fields included."""
    promoted = F.map_filter(F.create_map(*[x for c in PROMOTED for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    extras = F.map_concat(promoted, F.coalesce(F.from_json("extras_json", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return stored.select("id", "title", "text", "source", "pub_year", extras.alias("extras"))


def with_entities(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents with their mentions as the list ``entities`` in order of ``mention_seq``, empty where a document has none."""
    fields = [c for c in mentions.columns if c not in ("doc_id", "mention_seq")]
    lists = mentions.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("mention_seq", F.struct(*fields).alias("e")))).alias("l"))
    joined = docs.join(lists.select("id", F.col("l.e").alias("entities")), "id", "left")
    kind = joined.schema["entities"].dataType.simpleString()
    return joined.withColumn("entities", F.coalesce("entities", F.array().cast(kind)))


def in_order(rows: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """For each of ``asked (pos, key)`` its row, in order of ``pos``; ids that were not found have nulls."""
    return asked.select("pos", key).join(rows, key, "left").orderBy("pos")


def grouped_by_type(mentions: DataFrame) -> DataFrame:
    """Each document's mention texts by entity type: ``doc_id, entities (map of lists)``, in order of mention."""
    lists = mentions.groupBy("doc_id", "entity_type").agg(F.sort_array(F.collect_list(F.struct("mention_seq", "text"))).alias("l"))
    return lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", F.col("l.text").alias("texts")))).alias("entities"))


def source_metadata(docs: DataFrame) -> DataFrame:
    """Extras of each document beside its source and year, as one map."""
    own = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("pub_year"), F.col("pub_year").cast("string")), lambda _, v: v.isNotNull())
    return docs.select("id", F.map_concat(F.map_filter("extras", lambda k, _: ~k.isin("source", "pub_year")), own).alias("metadata"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of or beside its own; of several new rows of a key the last by ``order``."""
    if order:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", order)
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def unprocessed(docs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Documents not yet stored."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def check_config(stored: DataFrame, config_json: str) -> None:
    """Raises if stored documents were made with other settings."""
    if stored.where(F.col("config_json") != config_json).limit(1).count():
        raise ValueError("the store was made with other settings; use a new one")


def info(stored: DataFrame) -> dict | None:
    """Document and entity counts, settings and first time of a store; None if it is empty or its settings differ between rows."""
    r = stored.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entity_count"), F.count_distinct("config_json").alias("k"), F.min("config_json").alias("config_json"), *([F.min("processed_at").alias("processed_at")] if "processed_at" in stored.columns else [])).first()
    if r["k"] > 1:
        log.error("the store holds documents of %d settings", r["k"])
    return None if r["k"] != 1 else {k: v for k, v in r.asDict().items() if k not in ("k", "processed_at")} | ({"processed_at": r["processed_at"]} if "processed_at" in r else {})


def by_type(mentions: DataFrame) -> DataFrame:
    """Entities of each document by type."""
    return mentions.groupBy("doc_id", "entity_type").agg(F.count("*").alias("entities"), F.count_distinct("text").alias("texts"))


def type_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("document_type").agg(F.count("*").alias("documents"))


def missing_ids(asked: DataFrame, found: DataFrame, key: str = "pmid") -> DataFrame:
    """Ids that were asked for and not found."""
    return asked.select(key).distinct().join(found.select(key), key, "left_anti")


def shown(ids: DataFrame, part: str = "") -> DataFrame:
    """Of cited ids ``(pos, id)``, each once at its first place, those that hold ``part``; without one the first alone."""
    first = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    if part.strip():
        return first.where(F.contains("id", F.lit(part.strip()))).orderBy("pos")
    return first.orderBy("pos").limit(1)
