"""Coverage and evidence metrics of a store or graph."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _linked() -> Column:
    return F.nullif(F.col("umls_cui"), F.lit("")).isNotNull()


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent, 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def top_entities(entities: DataFrame, mentions: DataFrame, limit: int = 10, by: str = "mentions") -> DataFrame:
    """Entities with most mentions (or documents). Counted before they are named."""
    per = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))
    rows = per.join(entities.select(F.col("id").alias("entity_id"), "name", "entity_type", "umls_preferred_name"), "entity_id")
    return rows.select("entity_id", "name", "entity_type", F.coalesce("umls_preferred_name", "name").alias("label"), "mentions", "documents").orderBy(F.desc(by), "entity_id").limit(limit)


def preview_label() -> Column:
    """``name (preferred name)``, or the name."""
    preferred = F.nullif(F.col("umls_preferred_name"), F.lit(""))
    return F.when(preferred.isNotNull(), F.concat("name", F.lit(" ("), preferred, F.lit(")"))).otherwise(F.col("name"))


def type_distribution(entities: DataFrame) -> DataFrame:
    n, linked = F.count("*"), F.count_distinct(F.when(_linked(), F.col("id")))
    return entities.groupBy("entity_type").agg(n.alias("entities"), linked.alias("linked"), rate(linked, n).alias("linked_rate"))


def strongest(named: DataFrame, limit: int = 10) -> DataFrame:
    rows = named.select("entity_a_name", "entity_b_name", "entity_a_id", "entity_b_id", "docs_count", "sent_count")
    return rows.orderBy(F.desc("docs_count"), F.desc("sent_count"), "entity_a_id", "entity_b_id").limit(limit)


def link_coverage(found: DataFrame) -> DataFrame:
    """One row: linked mentions and linked distinct texts, with rates, concepts, and texts per concept."""
    linked = _linked()
    a = found.agg(
        F.count("*").alias("mentions"), F.count_if(linked).alias("linked_mentions"), F.count_distinct("text").alias("texts"), F.count_distinct(F.when(linked, F.col("text"))).alias("linked_texts"), F.count_distinct(F.when(linked, F.col("umls_cui"))).alias("concepts"),
    )
    ratio = F.when(F.col("concepts") > 0, F.round(F.col("linked_texts") / F.col("concepts"), 2)).otherwise(F.lit(0.0))
    return a.select("*", rate(F.col("linked_mentions"), F.col("mentions")).alias("mention_rate"), rate(F.col("linked_texts"), F.col("texts")).alias("text_rate"), ratio.alias("texts_per_concept"))


def variants(found: DataFrame) -> DataFrame:
    """Distinct texts of each concept and one preferred name."""
    return found.where(_linked()).groupBy("umls_cui").agg(F.count_distinct("text").alias("variants"), F.min("umls_preferred_name").alias("preferred_name"))


def variant_summary(per: DataFrame) -> DataFrame:
    return per.agg(F.round(F.avg("variants"), 2).alias("mean"), F.median("variants").alias("median"), F.max("variants").alias("most"))


def variant_histogram(per: DataFrame) -> DataFrame:
    return per.groupBy("variants").agg(F.count("*").alias("concepts"))


def top_unlinked(found: DataFrame, limit: int = 20) -> DataFrame:
    rows = found.where(~_linked()).groupBy("text", "entity_type").agg(F.count("*").alias("mentions"))
    return rows.orderBy(F.desc("mentions"), "text", "entity_type").limit(limit)


def evidence_tiers(pairs: DataFrame) -> DataFrame:
    d = F.col("docs_count")
    tier = F.when(d >= 10, "10+").when(d >= 5, "5-9").when(d >= 3, "3-4").when(d == 2, "2").otherwise("1")
    return pairs.groupBy(tier.alias("tier")).agg(F.count("*").alias("pairs"), F.min("docs_count").alias("least")).orderBy(F.desc("least"))


def relationship_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg("docs_count"), 4).alias("mean_docs"), F.max("docs_count").alias("most_docs"), F.round(F.avg("sent_count"), 4).alias("mean_sentences"), F.max("sent_count").alias("most_sentences"))


def totals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents, entities, linked entities and their rate (0 without entities)."""
    e = found.agg(F.count("*").alias("entity_count"), F.count_if(_linked()).alias("umls_linked"))
    return docs.agg(F.count("*").alias("doc_count")).crossJoin(e).withColumn("umls_rate", rate(F.col("umls_linked"), F.col("entity_count")))  # one row each


def label_overlap(found: DataFrame) -> DataFrame:
    """Labels that more than one model gives."""
    per = found.groupBy("source_label").agg(F.sort_array(F.collect_set("source_model")).alias("models"))
    return per.where(F.size("models") > 1).select("source_label", F.array_join("models", ",").alias("models"))


def label_examples(found: DataFrame, most: int = 3) -> DataFrame:
    """The first texts, in order, of each model's labels."""
    texts = found.select("source_model", "source_label", "text").distinct()
    return texts.groupBy("source_model", "source_label").agg(F.array_join(F.slice(F.sort_array(F.collect_list("text")), 1, most), ",").alias("examples"))


def annotator_rates(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions per document and distinct labels of each model."""
    n = docs.agg(F.count("*").alias("documents"))
    per = found.groupBy("source_model").agg(F.count("*").alias("mentions"), F.count_distinct("source_label").alias("labels"))
    return per.crossJoin(n).select("source_model", "mentions", "labels", F.round(F.col("mentions") / F.greatest(F.col("documents"), F.lit(1)), 4).alias("per_document"))  # n is one row


def evaluation(runs: DataFrame) -> DataFrame:
    """Of agent runs ``(tool, expected_tool, shown, selected, error)``: routing, selection and error rates."""
    return runs.agg(F.count("*").alias("questions"), rate(F.count_if(F.col("tool") == F.col("expected_tool")), F.count("*")).alias("routing_rate"), rate(F.sum("selected"), F.sum("shown")).alias("selection_rate"), rate(F.count_if("error"), F.count("*")).alias("error_rate"))


def benchmark(load: Callable[[], DataFrame], run: Callable[[DataFrame], DataFrame], docs: DataFrame) -> dict:
    """How an annotator does on ``docs``: seconds to load and to run, mentions and mentions a document, labels."""
    began = time.perf_counter()
    terms = load()
    terms.count()
    ready = time.perf_counter()
    r = run(terms).agg(F.count("*").alias("mentions"), F.sort_array(F.collect_set("source_label")).alias("labels")).first()
    took = time.perf_counter() - ready
    n = docs.count()
    return {"load_seconds": ready - began, "run_seconds": took, "documents": n, "mentions": r["mentions"], "per_document": r["mentions"] / max(n, 1), "labels": r["labels"]}


def by_length(rows: DataFrame, text: str = "text", limit: int = 10) -> DataFrame:
    """Distinct texts, the longest first."""
    return rows.select(text, F.length(text).alias("length")).distinct().orderBy(F.desc("length"), text).limit(limit)
