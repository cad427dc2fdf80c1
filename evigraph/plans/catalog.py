"""The registered queries and, for each that SQL can express, the DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FilterConfig, LinkerConfig, NerConfig
from ..functions import text
from ..operators import cooccurrence, documents, filtering, graph, ids, linking, mentions, metrics
from ..schemas import LABEL_TYPES
from ..sources import articles, store
from ..streaming import resume
from . import agent, bindings, pipeline
from .bindings import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# ---- SQL of the bound inputs -------------------------------------------------------------------------------------------------
ENTITY = """
ent AS (SELECT coalesce(cui, 'CUSTOM:' || p_name) AS id, p_name AS name, CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'gene' WHEN 'bolt' THEN 'disease' WHEN 'gear' THEN 'chemical' WHEN 'gizmo' THEN 'biological_process'
    WHEN 'plate' THEN 'cell_type' WHEN 'ring' THEN 'anatomy' WHEN 'rod' THEN 'organism' WHEN 'widget' THEN 'cellular_component' ELSE 'unknown' END AS entity_type, cui AS umls_cui,
    CASE WHEN cui IS NOT NULL THEN upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] END AS umls_preferred_name
  FROM (SELECT p_name, CASE WHEN min(p_partkey) % 3 <> 0 THEN 'C' || lpad(min(p_partkey)::VARCHAR, 7, '0') END AS cui FROM part GROUP BY p_name)),
men AS (SELECT l_orderkey::VARCHAR AS doc_id, e.id AS entity_id, p_name AS text, l_linenumber::INT AS sentence_id, 'order ' || l_orderkey || ' line ' || l_linenumber AS sentence_text FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ent e ON e.name = p_name)"""
CONTEXT = """
sent AS (SELECT doc_id, sentence_id, entity_id, min(sentence_text) AS st FROM men GROUP BY ALL),
ctx AS (SELECT a.entity_id AS ea, b.entity_id AS eb, a.doc_id, a.sentence_id, a.st FROM sent a JOIN sent b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id AND a.entity_id < b.entity_id),
co AS (SELECT ea, eb, count(*) AS sent_count, count(DISTINCT doc_id) AS docs_count FROM ctx GROUP BY ea, eb)"""
EVIDENCE = """
rk AS (SELECT ea, eb, doc_id, st, row_number() OVER (PARTITION BY ea, eb, doc_id ORDER BY sentence_id) AS r FROM ctx),
ev AS (SELECT ea, eb, doc_id, st, row_number() OVER (PARTITION BY ea, eb ORDER BY r, doc_id) AS pos FROM rk QUALIFY pos <= 5)"""
NAMED = """
named AS (SELECT co.*, a.name AS na, b.name AS nb, a.entity_type AS ta, b.entity_type AS tb FROM co JOIN ent a ON a.id = ea JOIN ent b ON b.id = eb)"""
EDGE = """
edge AS (SELECT ea AS src, eb AS dst, docs_count, sent_count FROM co UNION ALL SELECT eb, ea, docs_count, sent_count FROM co)"""
FOUND = """
found AS (SELECT doc_id, CASE WHEN sentence_id % 2 = 0 THEN upper(m.text) ELSE m.text END AS text, sentence_id * 3 AS start_pos, ['bionlp', 'craft', 'bc5cdr'][sentence_id % 3 + 1] AS source_model, entity_type, b.source_label, sentence_id, sentence_text,
    CASE WHEN umls_cui IS NOT NULL THEN 0.9::DOUBLE END AS linking_confidence, umls_cui, umls_preferred_name
  FROM men m JOIN ent e ON e.id = m.entity_id JOIN (SELECT p_name AS text, min(p_brand) AS source_label FROM part GROUP BY 1) b ON b.text = m.text)"""
LINKS = f"""WITH {ENTITY}, {FOUND}, texts AS (SELECT DISTINCT text FROM found), al AS (SELECT name AS alias, umls_cui, CASE WHEN length(name) % 2 = 0 THEN 0.95::DOUBLE ELSE 0.45::DOUBLE END AS confidence, CASE WHEN length(name) > 9 THEN umls_preferred_name ELSE upper(name) END AS preferred FROM ent WHERE umls_cui IS NOT NULL),
links AS (SELECT text, CASE WHEN confidence >= 0.7 THEN umls_cui END AS umls_cui, confidence AS linking_confidence, CASE WHEN confidence >= 0.7 THEN preferred END AS umls_preferred_name FROM texts LEFT JOIN al ON alias = lower(trim(text)))"""
KG = f"WITH {ENTITY}, {CONTEXT}"
STORE = f"WITH {ENTITY}, {FOUND}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bindings.knowledge_graph(spark, sf_dir)
    return _plain(graph.neighbors(g, "blue", min_evidence=2))


def _plain(df: DataFrame) -> DataFrame:
    """Rows without list columns."""
    return df.drop("evidence_sentences", "sample_doc_ids")


# ---- documents ---------------------------------------------------------------------------------------------------------------
@query("""SELECT doc_id::VARCHAR AS id, 'Document ' || doc_id AS title, coalesce(text, '') AS text, 'pubmed' AS source, (2000 + doc_id % 20)::INT AS pub_year, source AS journal, CASE WHEN doc_id % 2 = 0 THEN 'Doe Jane' END AS authors, (CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END)::INT AS extras FROM documents""")
def documents_to_internal(spark, sf):
    d = documents.from_abstracts(bindings.articles(spark, sf))
    return d.select("id", "title", "text", "source", "pub_year", F.try_element_at("extras", F.lit("journal")).alias("journal"), F.try_element_at("extras", F.lit("authors")).alias("authors"), F.size("extras").alias("extras"))


@query("""SELECT d.doc_id::VARCHAR AS id, source AS journal, lang AS keywords, NULL::VARCHAR AS extras_json, count(l.l_orderkey) AS entity_count FROM documents d LEFT JOIN lineitem l ON l.l_orderkey = d.doc_id GROUP BY ALL""")
def processed_documents(spark, sf):
    d = documents.from_abstracts(bindings.articles(spark, sf))
    return documents.processed(d, bindings.mentions(spark, sf), NerConfig().to_json()).select("id", "journal", "keywords", "extras_json", "entity_count")


@query("""SELECT DISTINCT (2 * doc_id)::VARCHAR AS pmid, 'new' AS version FROM documents UNION ALL SELECT doc_id::VARCHAR, 'old' FROM documents WHERE doc_id NOT IN (SELECT 2 * doc_id FROM documents)""")
def upsert_documents(spark, sf):
    """All documents are the old side; the new side has every id doubled, so it replaces some rows and adds others."""
    d = table(spark, sf, "documents")
    old = d.select(F.col("doc_id").cast("string").alias("pmid"), F.lit("old").alias("version"))
    return documents.upsert(old, d.select((2 * F.col("doc_id")).cast("string").alias("pmid"), F.lit("new").alias("version")), "pmid")


@query("""SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_unprocessed_anti(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return documents.unprocessed(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")), done)


@query("""SELECT lang AS document_type, count(*) AS documents FROM documents GROUP BY 1""")
def document_type_counts(spark, sf):
    return documents.type_counts(table(spark, sf, "documents").withColumnRenamed("lang", "document_type"))


@query("""SELECT doc_id * 2 AS pmid FROM labels EXCEPT SELECT doc_id FROM documents""")
def missing_ids(spark, sf):
    """Twice the ids of all labels, of which part are no documents' ids."""
    return documents.missing_ids(table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("pmid")), table(spark, sf, "documents").withColumnRenamed("doc_id", "pmid"))


@query("""SELECT doc_id::VARCHAR AS pmid, 'Document ' || doc_id AS title, ltrim(rtrim(text)) AS abstract, source AS journal, lang AS keywords, 'Article' AS document_type FROM documents WHERE doc_id % 50 <> 49""")
def xml_article_parse(spark, sf):
    return articles.articles(bindings.article_xml(spark, sf)).select("pmid", "title", "abstract", "journal", "keywords", "document_type")


@query("""SELECT doc_id::VARCHAR AS pmid, 'Chapter ' || doc_id AS title, ltrim(rtrim(coalesce(text, ''))) AS abstract, 'Book of ' || source AS journal, 'BookChapter' AS document_type, CASE WHEN doc_id % 2 = 0 THEN 'Ann Ed' ELSE 'Bo Au, Lee' END AS authors, (2000 + doc_id % 20)::INT AS year FROM documents
UNION ALL SELECT 'A' || doc_id, 'Part one', 'x y', source, 'Article', NULL, NULL FROM documents""")
def xml_chapter_parse(spark, sf):
    """A set of one article and one book chapter for each document; chapter authors come before those of the book."""
    return articles.articles(bindings.chapter_xml(spark, sf)).select("pmid", "title", "abstract", "journal", "document_type", "authors", "year")


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'PMC' || doc_id END AS pmid, CASE WHEN doc_id % 2 = 1 THEN 'PMC' || doc_id END AS pmc_id, CASE WHEN doc_id % 5 = 0 THEN 'No title' ELSE 'Title ' || doc_id END AS title, 'Sum up' || chr(10) || chr(10) || 'Body of ' || doc_id AS abstract,
coalesce(source, 'Unknown journal') AS journal, CASE WHEN doc_id % 3 > 0 THEN (1990 + doc_id % 3)::INT END AS year, CASE WHEN doc_id % 2 = 0 THEN 'Jo Doe' END AS authors FROM documents""")
def xml_full_text_parse(spark, sf):
    return articles.articles(bindings.full_text_xml(spark, sf), full=True).select("pmid", "pmc_id", "title", "abstract", "journal", "year", "authors")


@query("""SELECT p_partkey, umls_cui, linking_confidence, types FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'C' || p_size END AS umls_cui, CASE WHEN p_partkey % 3 <> 0 THEN 0.8::DOUBLE END AS linking_confidence, CASE WHEN p_partkey % 3 = 1 THEN 'T' || p_size ELSE 'own' END AS types FROM part)""")
def apply_mappings_kept_types(spark, sf):
    """Links of which some have no semantic types: these leave a mention's own."""
    p = table(spark, sf, "part")
    found = p.select("p_partkey", F.col("p_partkey").cast("string").alias("text"), F.lit("gene").alias("entity_type"), F.lit("old").alias("umls_cui"), F.lit(0.1).alias("linking_confidence"), F.lit("n").alias("umls_preferred_name"), F.array(F.lit("own")).alias("umls_semantic_types"))
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    links = p.where(k % 3 != 0).select(k.cast("string").alias("text"), F.concat(F.lit("C"), size).alias("umls_cui"), F.lit(0.8).alias("linking_confidence"), F.lit("n").alias("umls_preferred_name"), F.when(k % 3 == 1, F.array(F.concat(F.lit("T"), size))).otherwise(F.array().cast("array<string>")).alias("umls_semantic_types"))
    return linking.apply_links(found, links, keep_types=True).select("p_partkey", "umls_cui", "linking_confidence", F.array_join("umls_semantic_types", ",").alias("types"))


@query(f"""{STORE}, e AS (SELECT doc_id, string_agg(text, ',' ORDER BY sentence_id, text) AS texts, count(*) AS n FROM found GROUP BY 1)
SELECT d.doc_id::VARCHAR AS id, source, coalesce(n, 0) AS entities, coalesce(texts, '') AS texts FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id::VARCHAR""")
def documents_with_entities(spark, sf):
    d = documents.from_abstracts(bindings.articles(spark, sf)).select("id", F.try_element_at("extras", F.lit("journal")).alias("source"))
    rows = documents.with_entities(d, bindings.found(spark, sf).select("doc_id", "text", "mention_seq"))
    return rows.select("id", "source", F.size("entities").cast("long").alias("entities"), F.array_join("entities.text", ",").alias("texts"))


@query("""SELECT row_number() OVER (ORDER BY conv_id DESC, turn) AS pos, conv_id::VARCHAR AS id, c.text IS NOT NULL AS asked, d.source FROM conversations c LEFT JOIN documents d ON d.doc_id = conv_id""")
def results_in_request_order(spark, sf):
    """The documents of all conversations, the last first, in the order in which they were asked for."""
    out = f"{store.work_folder(spark)}/asked-{uuid.uuid4().hex}"
    store.forget_later(spark, out)
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").isNotNull().alias("asked"))
    asked = store.numbered(c, out, F.desc_nulls_last("conv_id"), F.asc_nulls_last("turn")).select("pos", F.col("conv_id").cast("string").alias("id"), "asked")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    return documents.in_order(rows, asked.select("pos", "id")).join(asked.select("pos", "asked"), "pos").select("pos", "id", "asked", "source")


@query("""SELECT text, length(text) AS length FROM (SELECT DISTINCT text FROM conversations) ORDER BY length DESC, text LIMIT 10""")
def longest_texts(spark, sf):
    return metrics.by_length(table(spark, sf, "conversations")).select("text", F.col("length").cast("long").alias("length"))


@query("""SELECT id, min(pos) AS pos FROM (SELECT l_partkey::VARCHAR AS id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) WHERE contains(id, '7') GROUP BY 1""")
def cited_documents_filter(spark, sf):
    ids_ = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").cast("string").alias("id"))
    return documents.shown(ids_, "7").select("id", "pos")


@query("""SELECT doc_id::VARCHAR AS id, (CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END + 2)::INT AS entries, source AS journal, 'pubmed' AS source, (2000 + doc_id % 20)::VARCHAR AS pub_year FROM documents""")
def document_metadata(spark, sf):
    m = documents.source_metadata(documents.from_abstracts(bindings.articles(spark, sf)))
    at = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return m.select("id", F.size("metadata").alias("entries"), at("journal"), at("source"), at("pub_year"))


@query(f"""{STORE} SELECT doc_id, entity_type, count(*) AS entities, count(DISTINCT text) AS texts FROM found GROUP BY ALL""")
def entities_by_type(spark, sf):
    return documents.by_type(bindings.found(spark, sf))


@query(f"""{LINKS}, known AS (SELECT text, max(umls_cui) AS umls_cui, max(linking_confidence) AS linking_confidence FROM found WHERE sentence_id % 2 = 0 AND linking_confidence IS NOT NULL GROUP BY text)
SELECT text, umls_cui, linking_confidence FROM known UNION ALL SELECT text, umls_cui, linking_confidence FROM links WHERE text NOT IN (SELECT text FROM known)""")
def link_with_cache(spark, sf):
    return linking.link_with_cache(_texts(spark, sf), _store(spark, sf), _aliases(spark, sf)).select("text", "umls_cui", "linking_confidence")


# ---- annotation --------------------------------------------------------------------------------------------------------------
@query("""SELECT doc_id::VARCHAR AS doc_id, (i - 1)::INT AS sentence_id, s[i] AS sentence_text FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)""")
def sentence_split(spark, sf):
    return mentions.sentence_rows(table(spark, sf, "documents"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
t AS (SELECT term, ['bionlp', 'bc5cdr', 'craft'][length(term) % 3 + 1] AS source_model, ['gene', 'disease', 'chemical'][length(term) % 3 + 1] AS entity_type FROM w WHERE length(term) >= 4 GROUP BY term HAVING count(*) >= 20),
s AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+') AS c FROM documents),
p AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM s),
e AS (SELECT doc_id, regexp_extract(c, '[\\p{L}\\p{N}]+$') AS text, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) AS end_pos FROM p)
SELECT doc_id::VARCHAR AS doc_id, text, (end_pos - length(text))::INT AS start_pos, end_pos::INT AS end_pos, source_model, entity_type FROM e JOIN t ON t.term = lower(e.text)""")
def gazetteer_mentions(spark, sf):
    found = mentions.annotate(table(spark, sf, "documents"), bindings.dictionary(spark, sf))
    return found.select("doc_id", "text", "start_pos", "end_pos", "source_model", "entity_type")


@query(f"""{STORE} SELECT doc_id, lower(text) AS name, start_pos // 5 AS bucket, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text), start_pos // 5 ORDER BY CASE source_model WHEN 'bionlp' THEN 3 WHEN 'craft' THEN 2 ELSE 1 END DESC, sentence_id) AS r FROM found) WHERE r = 1 GROUP BY ALL""")
def mention_dedup_priority(spark, sf):
    kept = mentions.deduplicate(bindings.found(spark, sf), NerConfig().model_priorities)
    return kept.groupBy("doc_id", F.lower("text").alias("name"), F.floor(F.col("start_pos") / 5).cast("int").alias("bucket")).agg(F.count("*").alias("kept"))


LABELS = [*LABEL_TYPES, "no such label"]


@query(f"""SELECT p_partkey, {LABELS!r}[p_partkey % {len(LABELS)} + 1] AS label, {[*LABEL_TYPES.values(), "unknown"]!r}[p_partkey % {len(LABELS)} + 1] AS entity_type FROM part""")
def label_type_mapping(spark, sf):
    """Every label that an annotator may give, and one that none gives."""
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % len(LABELS) + 1).cast("int")).alias("label")
    return table(spark, sf, "part").select("p_partkey", label).select("p_partkey", "label", text.type_of_label(F.col("label")).alias("entity_type"))


@query("""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' inhibitors' WHEN 1 THEN ' Antibody' WHEN 2 THEN ' syndrome' WHEN 3 THEN ' inhibition pathway' ELSE '' END AS text, ['gene', 'chemical', 'disease', 'amino_acid'][p_partkey % 4 + 1] AS kind FROM part)
SELECT p_partkey, text, CASE WHEN regexp_matches(text, '(?i)\\b(inhibitors?|inhibition)\\b') THEN CASE WHEN kind IN ('gene', 'disease') AND NOT regexp_matches(text, '(?i)\\b(activity|pathway|process)\\b') THEN 'chemical' ELSE kind END
  WHEN regexp_matches(text, '(?i)\\bantibod(y|ies)\\b') THEN CASE WHEN kind = 'gene' THEN 'chemical' ELSE kind END WHEN regexp_matches(text, '(?i)\\bsyndrome\\b') THEN CASE WHEN kind IN ('gene', 'chemical') THEN 'disease' ELSE kind END ELSE kind END AS entity_type FROM t""")
def pattern_type_correction(spark, sf):
    k = F.col("p_partkey")
    ends = F.element_at(F.array(*[F.lit(x) for x in (" inhibitors", " Antibody", " syndrome", " inhibition pathway", "")]), (k % 5 + 1).cast("int"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("gene", "chemical", "disease", "amino_acid")]), (k % 4 + 1).cast("int"))
    d = table(spark, sf, "part").select("p_partkey", F.concat("p_name", ends).alias("text"), kinds.alias("kind"))
    return d.select("p_partkey", "text", text.corrected_type(F.col("text"), F.col("kind")).alias("entity_type"))


# ---- linking -----------------------------------------------------------------------------------------------------------------
def _texts(spark, sf):
    return bindings.found(spark, sf).select("text")


def _aliases(spark, sf):
    e = bindings.entities(spark, sf).where("umls_cui IS NOT NULL")
    conf = F.when(F.length("name") % 2 == 0, F.lit(0.95)).otherwise(F.lit(0.45))
    return e.select(F.col("name").alias("alias"), "umls_cui", conf.alias("confidence"), F.when(F.length("name") > 9, F.col("umls_preferred_name")).alias("canonical_name"), F.upper("name").alias("first_alias"), F.array(F.lit("T001")).alias("umls_semantic_types"))


@query(f"{LINKS} SELECT * FROM links")
def link_threshold(spark, sf):
    return linking.link(_texts(spark, sf), _aliases(spark, sf), LinkerConfig()).drop("umls_semantic_types")


def _store(spark, sf):
    return bindings.found(spark, sf).where("sentence_id % 2 = 0").withColumn("umls_semantic_types", F.array().cast("array<string>"))


@query(f"{STORE} SELECT text, any_value(umls_cui) AS umls_cui, max(linking_confidence) AS linking_confidence FROM found WHERE sentence_id % 2 = 0 AND linking_confidence IS NOT NULL GROUP BY text")
def link_cache_hits(spark, sf):
    return linking.cached(_texts(spark, sf), _store(spark, sf)).select("text", "umls_cui", "linking_confidence")


@query(f"{STORE} SELECT DISTINCT text FROM found WHERE text NOT IN (SELECT text FROM found WHERE sentence_id % 2 = 0 AND linking_confidence IS NOT NULL)")
def link_cache_misses_anti(spark, sf):
    return linking.not_cached(_texts(spark, sf), linking.cached(_texts(spark, sf), _store(spark, sf)))


@query(f"{LINKS} SELECT f.doc_id, f.text, l.umls_cui, l.linking_confidence, f.entity_type, count(*) AS mentions FROM found f JOIN links l USING (text) GROUP BY ALL")
def apply_links(spark, sf):
    links = linking.link(_texts(spark, sf), _aliases(spark, sf))
    rows = linking.apply_links(bindings.found(spark, sf), links)
    rows = rows.repartition("doc_id")  # nearly each row is a group: counted behind the shuffle alone, in parts of a bounded size
    return rows.groupBy("doc_id", "text", "umls_cui", "linking_confidence", "entity_type").agg(F.count("*").alias("mentions"))


# ---- entities and mentions ---------------------------------------------------------------------------------------------------
@query(f"""{STORE} SELECT id, name, entity_type, umls_cui FROM (SELECT coalesce(umls_cui, 'CUSTOM:' || lower(text)) AS id, lower(text) AS name, entity_type, umls_cui, row_number() OVER (PARTITION BY coalesce(umls_cui, 'CUSTOM:' || lower(text)) ORDER BY doc_id, sentence_id, text) AS r FROM found) WHERE r = 1""")
def entity_first_occurrence(spark, sf):
    return mentions.entities(bindings.found(spark, sf)).select("id", "name", "entity_type", "umls_cui")


@query(f"{STORE} SELECT coalesce(umls_cui, 'CUSTOM:' || lower(text)) AS entity_id, text, count(*) AS mentions FROM found GROUP BY ALL")
def mention_projection(spark, sf):
    return mentions.mentions(bindings.found(spark, sf)).groupBy("entity_id", "text").agg(F.count("*").alias("mentions"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'C' || p_partkey WHEN p_partkey % 4 = 1 THEN 'CHEBI:' || p_partkey WHEN p_partkey % 4 = 2 THEN 'D' || p_partkey ELSE 'CUSTOM:' || lower(p_name) END AS id FROM part""")
def resolve_entity_id(spark, sf):
    k = F.col("p_partkey")
    of = lambda r, prefix: F.when(k % 4 == r, F.concat(F.lit(prefix), k.cast("string"))).otherwise(F.lit(""))
    name = F.concat(F.lit("\t "), F.upper("p_name"), F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", text.entity_id(of(0, "C"), of(1, "CHEBI:"), F.lit(None).cast("string"), of(2, "D"), name).alias("id"))


@query("""SELECT w AS text, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE length(w) > 2 GROUP BY 1""")
def short_mention_filter(spark, sf):
    return _usable_words(table(spark, sf, "documents"))


def _usable_words(docs):
    w = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("text"))
    none = {c: F.lit(None).cast("string") for c in ("umls_cui", "chebi_id", "go_id", "mesh_id")}
    return mentions.identified(w.withColumns(none)).groupBy("text").agg(F.count("*").alias("mentions"))


# ---- co-occurrence -----------------------------------------------------------------------------------------------------------
@query(f"{KG} SELECT ea AS entity_a_id, eb AS entity_b_id, sent_count, docs_count FROM co")
def cooccurrence_counts(spark, sf):
    return cooccurrence.counts(cooccurrence.contexts(bindings.mentions(spark, sf)))


@query(f"{KG}, {EVIDENCE} SELECT ea AS entity_a_id, eb AS entity_b_id, pos::INT AS pos, doc_id, st AS sentence_text FROM ev")
def cooccurrence_evidence_top5(spark, sf):
    return cooccurrence.evidence(bindings.mentions(spark, sf), keep=store.cut)


def _named(spark, sf):
    """Pairs with their counts alone: the filters do not look at evidence."""
    return filtering.named(cooccurrence.counts(cooccurrence.contexts(bindings.mentions(spark, sf))), bindings.entities(spark, sf))


FILTERED = f"{KG}, {NAMED} SELECT ea AS entity_a_id, eb AS entity_b_id, na AS entity_a_name, nb AS entity_b_name, ta AS entity_a_type, tb AS entity_b_type, sent_count, docs_count"
WORDS = FilterConfig(docs_count_min=5, sent_count_min=6, stopwords=frozenset(("Blue ring", "red bolt", "green gear")), allowed_entity_type_pairs=(("gene", "chemical"), ("disease", "gene")))
STOPPED = "(na IN ('blue ring', 'red bolt', 'green gear') OR nb IN ('blue ring', 'red bolt', 'green gear'))"
FOCUS = "(least(ta, tb), greatest(ta, tb)) IN (('chemical', 'gene'), ('disease', 'gene'))"


@query(f"{FILTERED} FROM named WHERE docs_count >= 5 AND sent_count >= 6")
def filter_thresholds(spark, sf):
    return filtering.filter_rows(_named(spark, sf), FilterConfig(5, 6, stopwords_enabled=False))


@query(f"{FILTERED} FROM named WHERE NOT {STOPPED}")
def filter_stopwords(spark, sf):
    return filtering.filter_rows(_named(spark, sf), FilterConfig(1, 1, stopwords=WORDS.stopwords))


@query(f"{FILTERED} FROM named WHERE {FOCUS}")
def filter_type_pairs(spark, sf):
    return filtering.filter_rows(_named(spark, sf), FilterConfig(1, 1, False, WORDS.allowed_entity_type_pairs))


@query(f"""{KG}, {NAMED} SELECT ea AS entity_a_id, eb AS entity_b_id, concat_ws(',', CASE WHEN docs_count < 5 THEN 'docs_count' END, CASE WHEN sent_count < 6 THEN 'sent_count' END, CASE WHEN {STOPPED} THEN 'stopword' END, CASE WHEN NOT {FOCUS} THEN 'entity_type_focus' END) AS reasons FROM named""")
def filter_removal_reasons(spark, sf):
    return filtering.with_reasons(_named(spark, sf), WORDS).select("entity_a_id", "entity_b_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"{KG}, {NAMED} SELECT ea AS entity_a_id, eb AS entity_b_id, docs_count >= 5 AND sent_count >= 6 AND NOT {STOPPED} AND {FOCUS} AS kept FROM named")
def filter_kept_removed_split(spark, sf):
    kept, removed = filtering.split(_named(spark, sf), WORDS)
    return kept.select("entity_a_id", "entity_b_id", F.lit(True).alias("kept")).unionByName(removed.select("entity_a_id", "entity_b_id", F.lit(False).alias("kept")))


@query(f"{FILTERED} FROM named ORDER BY md5('42:' || ea || ':' || eb), ea, eb LIMIT 100")
def relationship_sample(spark, sf):
    return filtering.sample_rows(_named(spark, sf), 100, 42)


# ---- graph -------------------------------------------------------------------------------------------------------------------
@query(f"{KG}, {EDGE} SELECT * FROM edge")
def symmetric_edges(spark, sf):
    return _plain(graph.symmetric(bindings.pairs(spark, sf)))


@query(f"""{KG}, {NAMED} SELECT (SELECT count(*) FROM ent) AS entities_created, count(*) FILTER (docs_count >= 5 AND sent_count >= 6 AND NOT {STOPPED} AND {FOCUS}) AS relationships_created, 0::BIGINT AS entities_filtered,
count(*) FILTER (NOT (docs_count >= 5 AND sent_count >= 6 AND NOT {STOPPED} AND {FOCUS})) AS relationships_filtered FROM named""")
def graph_stats(spark, sf):
    return graph.build(bindings.entities(spark, sf), bindings.pairs(spark, sf), WORDS).stats


def _neighbor_sql(where: str, columns: str, least: int) -> str:
    return f"""{KG}, {EDGE}, hit AS (SELECT s.name AS source_name, n.name AS neighbor_name, n.entity_type AS neighbor_type, n.id AS neighbor_id, g.docs_count, g.sent_count, row_number() OVER (PARTITION BY n.id ORDER BY g.docs_count DESC, g.sent_count DESC, s.id) AS r
FROM ent s JOIN edge g ON g.src = s.id JOIN ent n ON n.id = g.dst WHERE g.docs_count >= {least} AND {where})
SELECT {columns}, neighbor_id, docs_count, sent_count FROM hit WHERE r = 1 ORDER BY docs_count DESC, neighbor_name, neighbor_id LIMIT 20"""


@query(_neighbor_sql("contains(lower(s.name), 'blue') AND s.entity_type = 'disease' AND n.entity_type = 'gene'", "source_name AS disease_name, neighbor_name", 5))
def disease_genes(spark, sf):
    return _plain(graph.disease_genes(bindings.knowledge_graph(spark, sf), "Blue"))


@query(_neighbor_sql("contains(lower(s.name), 'red') AND s.entity_type = 'gene' AND n.entity_type = 'disease'", "source_name AS gene_name, neighbor_name", 5))
def gene_diseases(spark, sf):
    return _plain(graph.gene_diseases(bindings.knowledge_graph(spark, sf), "red"))


@query(_neighbor_sql("contains(lower(s.name), 'blue')", "source_name, neighbor_name, neighbor_type", 5))
def entity_neighbors(spark, sf):
    return _plain(graph.neighbors(bindings.knowledge_graph(spark, sf), "blue", min_evidence=5))


@query(_neighbor_sql("contains(lower(s.name), 'r') AND n.entity_type = 'chemical'", "source_name, neighbor_name, neighbor_type", 3))
def entity_neighbors_typed(spark, sf):
    return _plain(graph.neighbors(bindings.knowledge_graph(spark, sf), "r", neighbor_type="chemical"))


@query(_neighbor_sql("s.umls_cui IN ('C0000001', 'C0000002', 'C0000004')", "source_name, neighbor_name, neighbor_type", 3))
def entity_neighbors_by_cui(spark, sf):
    return _plain(graph.neighbors(bindings.knowledge_graph(spark, sf), "not a name", cuis=["C0000001", "C0000002", "C0000004"]))


def _explain_sql(a: str, b: str) -> str:
    return f"""{KG}, {EDGE}, best AS (SELECT x.name AS an, y.name AS bn, x.entity_type AS ta, y.entity_type AS tb, docs_count, sent_count FROM ent x JOIN edge g ON g.src = x.id JOIN ent y ON y.id = g.dst WHERE contains(lower(x.name), '{a}') AND contains(lower(y.name), '{b}') ORDER BY docs_count DESC, sent_count DESC, src, dst LIMIT 1)
SELECT coalesce(an, '{a}') AS entity_a_name, coalesce(bn, '{b}') AS entity_b_name, ta AS entity_a_type, tb AS entity_b_type, coalesce(docs_count, 0) AS docs_count, coalesce(sent_count, 0) AS sent_count, an IS NOT NULL AS found FROM (SELECT 1) LEFT JOIN best ON true"""


@query(_explain_sql("blue", "ring"))
def explain_relationship(spark, sf):
    return _plain(graph.explain(bindings.knowledge_graph(spark, sf), "blue", "ring"))


@query(_explain_sql("blue", "no such name"))
def explain_relationship_missing(spark, sf):
    return _plain(graph.explain(bindings.knowledge_graph(spark, sf), "blue", "no such name"))


@query(f"""{KG}, {EDGE}, hit AS (SELECT n.id AS neighbor_id, n.name AS neighbor_name, n.entity_type AS neighbor_type, a.name AS entity_a_name, b.name AS entity_b_name, g.docs_count + h.docs_count AS docs_count, g.sent_count + h.sent_count AS sent_count,
row_number() OVER (PARTITION BY n.id ORDER BY g.docs_count + h.docs_count DESC, a.id, b.id) AS r FROM ent a JOIN edge g ON g.src = a.id JOIN ent n ON n.id = g.dst JOIN edge h ON h.dst = n.id JOIN ent b ON b.id = h.src
WHERE contains(lower(a.name), 'blue') AND contains(lower(b.name), 'ring') AND a.id <> b.id AND g.docs_count >= 3 AND h.docs_count >= 3)
SELECT neighbor_name, neighbor_type, neighbor_id, entity_a_name, entity_b_name, docs_count, sent_count FROM hit WHERE r = 1 ORDER BY docs_count DESC, neighbor_name, neighbor_id LIMIT 20""")
def shared_neighbors(spark, sf):
    return _plain(graph.shared_neighbors(bindings.knowledge_graph(spark, sf), "blue", "ring"))


# ---- metrics -----------------------------------------------------------------------------------------------------------------
def _top_sql(by: str) -> str:
    return f"WITH {ENTITY} SELECT entity_id, name, entity_type, coalesce(umls_preferred_name, name) AS label, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM men JOIN ent ON id = entity_id GROUP BY ALL ORDER BY {by} DESC, entity_id LIMIT 10"


@query(_top_sql("mentions"))
def top_entities_by_mentions(spark, sf):
    return metrics.top_entities(bindings.entities(spark, sf), bindings.mentions(spark, sf))


@query(_top_sql("documents"))
def top_entities_by_docs(spark, sf):
    return metrics.top_entities(bindings.entities(spark, sf), bindings.mentions(spark, sf), by="documents")


@query(f"WITH {ENTITY} SELECT entity_type, count(*) AS entities, count(umls_cui) AS linked, round(100.0::DOUBLE * count(umls_cui) / count(*), 1) AS linked_rate FROM ent GROUP BY 1")
def entity_type_distribution(spark, sf):
    return metrics.type_distribution(bindings.entities(spark, sf))


@query(f"{KG}, {NAMED} SELECT na AS entity_a_name, nb AS entity_b_name, ea AS entity_a_id, eb AS entity_b_id, docs_count, sent_count FROM named ORDER BY docs_count DESC, sent_count DESC, ea, eb LIMIT 10")
def strongest_relationships(spark, sf):
    return metrics.strongest(_named(spark, sf))


@query(f"""{STORE}, a AS (SELECT count(*) AS mentions, count(umls_cui) AS linked_mentions, count(DISTINCT text) AS texts, count(DISTINCT text) FILTER (umls_cui IS NOT NULL) AS linked_texts, count(DISTINCT umls_cui) AS concepts FROM found)
SELECT *, round(100.0::DOUBLE * linked_mentions / mentions, 1) AS mention_rate, round(100.0::DOUBLE * linked_texts / texts, 1) AS text_rate, round(linked_texts / concepts, 2) AS texts_per_concept FROM a""")
def link_coverage(spark, sf):
    return metrics.link_coverage(bindings.found(spark, sf))


VARIANTS = f"{STORE}, v AS (SELECT umls_cui, count(DISTINCT text) AS variants, min(umls_preferred_name) AS preferred_name FROM found WHERE umls_cui IS NOT NULL GROUP BY 1)"


@query(f"{VARIANTS} SELECT * FROM v")
def variants_per_concept(spark, sf):
    return metrics.variants(bindings.found(spark, sf))


@query(f"{VARIANTS} SELECT variants, count(*) AS concepts FROM v GROUP BY 1")
def variant_histogram(spark, sf):
    return metrics.variant_histogram(metrics.variants(bindings.found(spark, sf)))


@query(f"{VARIANTS} SELECT round(avg(variants), 2) AS mean, median(variants)::DOUBLE AS median, max(variants) AS most FROM v")
def variant_summary(spark, sf):
    return metrics.variant_summary(metrics.variants(bindings.found(spark, sf)))


@query(f"{STORE} SELECT text, entity_type, count(*) AS mentions FROM found WHERE umls_cui IS NULL GROUP BY ALL ORDER BY mentions DESC, text, entity_type LIMIT 20")
def top_unlinked_texts(spark, sf):
    return metrics.top_unlinked(bindings.found(spark, sf))


@query(f"{KG} SELECT CASE WHEN docs_count >= 10 THEN '10+' WHEN docs_count >= 5 THEN '5-9' WHEN docs_count >= 3 THEN '3-4' WHEN docs_count = 2 THEN '2' ELSE '1' END AS tier, count(*) AS pairs, min(docs_count) AS least FROM co GROUP BY 1")
def evidence_tiers(spark, sf):
    return metrics.evidence_tiers(cooccurrence.counts(cooccurrence.contexts(bindings.mentions(spark, sf))))


@query(f"{KG} SELECT count(*) AS pairs, round(avg(docs_count), 4) AS mean_docs, max(docs_count) AS most_docs, round(avg(sent_count), 4) AS mean_sentences, max(sent_count) AS most_sentences FROM co")
def relationship_summary(spark, sf):
    return metrics.relationship_summary(cooccurrence.counts(cooccurrence.contexts(bindings.mentions(spark, sf))))


@query(f"{STORE} SELECT (SELECT count(*) FROM orders) AS doc_count, count(*) AS entity_count, count(umls_cui) AS umls_linked, round(100.0::DOUBLE * count(umls_cui) / count(*), 1) AS umls_rate FROM found")
def pipeline_totals(spark, sf):
    return metrics.totals(table(spark, sf, "orders"), bindings.found(spark, sf))


@query(f"{STORE} SELECT source_label, string_agg(DISTINCT source_model, ',' ORDER BY source_model) AS models FROM found GROUP BY 1 HAVING count(DISTINCT source_model) > 1")
def model_label_overlap(spark, sf):
    return metrics.label_overlap(bindings.found(spark, sf))


@query(f"{STORE} SELECT source_model, source_label, array_to_string(list_sort(list(DISTINCT text))[1:3], ',') AS examples FROM found GROUP BY ALL")
def model_label_examples(spark, sf):
    return metrics.label_examples(bindings.found(spark, sf))


@query(f"{STORE} SELECT source_model, count(*) AS mentions, count(DISTINCT source_label) AS labels, round(count(*) / (SELECT count(*) FROM orders), 4) AS per_document FROM found GROUP BY 1")
def annotator_rates(spark, sf):
    return metrics.annotator_rates(bindings.found(spark, sf), table(spark, sf, "orders"))


@query("""SELECT count(*) AS questions, round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 1) AS routing_rate, round(100.0::DOUBLE * sum(quality) / sum(quality + toxic + 1), 1) AS selection_rate, round(100.0::DOUBLE * count(*) FILTER (toxic = 1) / count(*), 1) AS error_rate FROM labels""")
def agent_evaluation(spark, sf):
    runs = table(spark, sf, "labels").select(F.col("quality").alias("tool"), F.lit(1).alias("expected_tool"), F.col("quality").alias("selected"), (F.col("quality") + F.col("toxic") + 1).alias("shown"), (F.col("toxic") == 1).alias("error"))
    return metrics.evaluation(runs)


# ---- planning, chat, citations -----------------------------------------------------------------------------------------------
@query("""WITH raw AS (SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1) SELECT id, pos FROM raw WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10) ORDER BY pos LIMIT greatest(0, (SELECT 900 - count(*) FROM part WHERE p_size <= 10))""")
def dedup_limit_ids(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    seen = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))
    return ids.deduplicate_and_limit(raw, seen, 900)


@query("""WITH d AS (SELECT o_orderdate::DATE AS day FROM orders), c AS (SELECT year(day) AS y, month(day) AS m, (day(day) - 1) // 7 AS w, count(*) OVER (PARTITION BY year(day)) AS iy, count(*) OVER (PARTITION BY year(day), month(day)) AS im FROM d),
k AS (SELECT *, CASE WHEN iy <= 150 THEN 'year' WHEN im <= 150 THEN 'month' ELSE 'week' END AS kind FROM c)
SELECT y::INT AS year, CASE WHEN kind <> 'year' THEN m END::INT AS month, CASE WHEN kind = 'week' THEN w END::INT AS week, kind, count(*) AS ids FROM k GROUP BY ALL""")
def date_window_plan(spark, sf):
    return ids.window_table(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), 150)


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 3""")
def chat_history_last_n(spark, sf):
    return agent.last_messages(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role", "text")


@query("""WITH c AS (SELECT conv_id, turn, text, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]{7}'))) AS ids FROM conversations), k AS (SELECT *, list_filter(ids, lambda d: regexp_matches(text, '\\b' || d || '\\b')) AS hit FROM c)
SELECT conv_id, turn, array_to_string(CASE WHEN len(hit) > 0 THEN hit ELSE ids END, ',') AS cited FROM k""")
def cited_id_filter(spark, sf):
    found = F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7}"), F.lit(0))))
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", found.alias("ids"))
    ascii_only = F.translate("text", "àáâäçèéêëìíîïñòóôöùúûüßÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ", "." * 46)
    return c.withColumn("text", ascii_only).select("conv_id", "turn", F.array_join(text.cited_ids(F.col("ids"), F.col("text")), ",").alias("cited"))


@query("""SELECT doc_id, 'see [' || doc_id || '](https://pubmed.ncbi.nlm.nih.gov/' || doc_id || ') and [' || (doc_id + 1) || '](https://pubmed.ncbi.nlm.nih.gov/' || (doc_id + 1) || ').' AS linked FROM documents""")
def citation_links(spark, sf):
    return _cited(table(spark, sf, "documents"))


def _cited(d):
    a, b = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    return d.select("doc_id", text.linkify(F.concat(F.lit("see "), a, F.lit(" and "), b, F.lit(".")), F.array(a, b)).alias("linked"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(relationship|explain)') THEN 'relationship' WHEN regexp_matches(text, '(?i)gene') THEN 'gene' WHEN regexp_matches(text, '(?i)(drug|chemical)') THEN 'chemical' WHEN regexp_matches(text, '(?i)disease') THEN 'disease' ELSE 'general' END AS kind FROM conversations""")
def question_kinds(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.query_kind(F.col("text")).alias("kind"))


BLOCK = """repeat('━', 52) || chr(10) || 'RESULT ' || pos || ' (ISOLATED - DO NOT MIX WITH OTHER RESULTS)' || chr(10) || repeat('━', 52) || chr(10) || chr(10) || 'ENTITY NAME (use this exact name): ' || neighbor_name || chr(10) || chr(10) || 'Documents: ' || docs_count || chr(10) || 'Sentences: ' || sent_count
|| chr(10) || 'Document IDs: [' || ids || ']' || chr(10) || chr(10) || 'Evidence (' || shown || ' samples from ' || sent_count || ' co-occurring sentences - describe ONLY what these say):' || chr(10) || quoted || chr(10) || chr(10) || 'END RESULT ' || pos || chr(10)"""


@query(f"""{KG}, {EVIDENCE}, {EDGE}, hit AS (SELECT s.id AS sid, n.name AS neighbor_name, n.id AS neighbor_id, g.docs_count, g.sent_count, row_number() OVER (PARTITION BY n.id ORDER BY g.docs_count DESC, g.sent_count DESC, s.id) AS r
FROM ent s JOIN edge g ON g.src = s.id JOIN ent n ON n.id = g.dst WHERE g.docs_count >= 5 AND contains(lower(s.name), 'blue')),
top AS (SELECT *, row_number() OVER (ORDER BY docs_count DESC, neighbor_name, neighbor_id) AS pos FROM hit WHERE r = 1 ORDER BY pos LIMIT 20),
told AS (SELECT top.pos, string_agg(ev.doc_id, ', ' ORDER BY ev.pos) AS ids, count(*) AS shown, string_agg('  ' || ev.pos || '. "' || st || '"', chr(10) ORDER BY ev.pos) AS quoted FROM top JOIN ev ON ea = least(sid, neighbor_id) AND eb = greatest(sid, neighbor_id) GROUP BY 1)
SELECT pos::INT AS pos, {BLOCK} AS block FROM top JOIN told USING (pos)""")
def tool_result_blocks(spark, sf):
    rows = graph.neighbors(bindings.knowledge_graph(spark, sf), "blue", min_evidence=5)
    return agent.blocks(rows, [F.desc("docs_count"), "neighbor_name", "neighbor_id"])


@query(f"""{KG}, {NAMED} SELECT CASE WHEN ta = 'gene' THEN na ELSE nb END AS entity_a_name, CASE WHEN ta = 'gene' THEN nb ELSE na END AS entity_b_name, CASE WHEN ta = 'gene' THEN ea ELSE eb END AS entity_a_id, CASE WHEN ta = 'gene' THEN eb ELSE ea END AS entity_b_id, docs_count, sent_count
FROM named WHERE docs_count >= 5 AND ((ta = 'gene' AND tb = 'disease') OR (ta = 'disease' AND tb = 'gene')) ORDER BY docs_count DESC, sent_count DESC, 3, 4 LIMIT 20""")
def pairs_of_two_types(spark, sf):
    return graph.between_types(bindings.knowledge_graph(spark, sf), "gene", "disease")


@query("""SELECT event_type, count(*) AS events FROM events GROUP BY 1""")
def incremental_stream_counts(spark, sf):
    """A stream reads the events table to its end; its counts are those of a batch."""
    name = f"stream_{uuid.uuid4().hex}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf, "events").schema)
    return resume.counts_by_type(spark, f"{sf}/events.parquet", schema, name, f"{store.work_folder(spark)}/{name}")


@query("""SELECT doc_id::VARCHAR AS id, length(coalesce(text, '')) AS size FROM documents""")
def incremental_documents(spark, sf):
    """New documents as micro-batches, twice: what the second run finds again is not added again."""
    out = f"{store.work_folder(spark)}/new-{uuid.uuid4().hex}"
    store.forget_later(spark, out)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    work = lambda df: df.select("id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    for part in (1, 2):
        store.append(docs.where(F.crc32("id") % 2 < part), f"{out}/in")  # the second run's files repeat the first one's rows
        resume.process_new(spark, f"{out}/in", "id string, text string", f"{out}/done", f"{out}/mark", work)
    return spark.read.parquet(f"{out}/done").select("id", F.col("size").cast("long").alias("size"))


GAZETTEER = """w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), t AS (SELECT term FROM w WHERE length(term) >= 4 GROUP BY term HAVING count(*) >= 20)"""


@query(f"""WITH {GAZETTEER}, a AS (SELECT doc_id, ltrim(rtrim(text)) AS text FROM documents WHERE doc_id % 50 <> 49),
s AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS c FROM a), p AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM s),
e AS (SELECT doc_id, regexp_extract(c, '[\\p{{L}}\\p{{N}}]+$') AS text, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) AS end_pos FROM p), hits AS (SELECT doc_id, lower(text) AS name, (end_pos - length(text)) // 5 AS bucket FROM e JOIN t ON t.term = lower(e.text))
SELECT 'documents' AS what, count(*) AS n FROM a UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT * FROM hits) UNION ALL SELECT 'entities', count(DISTINCT name) FROM hits UNION ALL SELECT 'vertices', count(DISTINCT name) FROM hits""")
def whole_run(spark, sf):
    """All steps of a run over a literature store of the documents: search, parse, annotate, link, tables and graph; then a run with nothing left."""
    out = f"{store.work_folder(spark)}/run-{uuid.uuid4().hex}"
    store.forget_later(spark, out)
    day = F.concat((F.lit(2000) + F.col("doc_id") % 20).cast("string"), F.lit("-01-01"))
    store.write(bindings.article_xml(spark, sf).select(F.col("doc_id").cast("string").alias("pmid"), day.alias("day"), "xml"), f"{out}/literature")
    aliases = spark.createDataFrame([], "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>")
    store.write(bindings.dictionary(spark, sf), f"{out}/terms")
    terms = spark.read.parquet(f"{out}/terms")
    pipeline.run(spark, f"{out}/literature", "pubmedarticle", 1 << 60, terms, aliases, out)
    pipeline.resume(spark, terms, aliases, out)
    counts = {"documents": "nlp/documents", "mentions": "kg/mention", "entities": "kg/entity", "vertices": "graph/vertices"}
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/{t}").agg(F.lit(k).alias("what"), F.count("*").alias("n")).select("what", "n") for k, t in counts.items()])
