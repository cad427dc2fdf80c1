"""The driver's tables as inputs of the engine: inputs are bound, operators never change."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence, graph, names
from ..operators.graph import Graph
from ..sources import store

#: Entity types of the part names' nouns.
NOUN_TYPES = {"anvil": "gene", "bolt": "disease", "gear": "chemical", "gizmo": "biological_process", "plate": "cell_type", "ring": "anatomy", "rod": "organism", "widget": "cellular_component"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cui(k: Column) -> Column:
    return F.when(k % 3 != 0, F.concat(F.lit("C"), F.lpad(k.cast("string"), 7, "0")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity for each part name."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    noun = F.create_map(*[F.lit(x) for kv in NOUN_TYPES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(noun, F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("unknown"))
    cui = _cui(F.col("k"))
    none = [F.lit(None).cast("string").alias(c) for c in ("chebi_id", "go_id", "mesh_id")]
    return names.select(F.coalesce(cui, F.concat(F.lit("CUSTOM:"), "p_name")).alias("id"), F.col("p_name").alias("name"), kind.alias("entity_type"), cui.alias("umls_cui"), *none, F.when(cui.isNotNull(), F.initcap("p_name")).alias("umls_preferred_name"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention for each order line: the order is the document, the line number the sentence."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    named = lines.join(parts.join(entities(spark, sf_dir).select(F.col("id").alias("entity_id"), "name"), "name"), "l_partkey")
    text = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"))
    return named.select(F.col("l_orderkey").cast("string").alias("doc_id"), "entity_id", F.col("name").alias("text"), F.col("l_linenumber").cast("int").alias("sentence_id"), text.alias("sentence_text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.cooccurrences(mentions(spark, sf_dir), keep=store.cut)


def build_knowledge_graph(spark: SparkSession, sf_dir: str, out: str) -> None:
    """The graph of all pairs, unfiltered, as tables: the questions have thresholds of their own.

    Edges are dealt and sorted by their start, so that a scan for few starts skips most of a file.
    """
    store.write(entities(spark, sf_dir), f"{out}/vertices")
    store.write(names.postings(spark.read.parquet(f"{out}/vertices")), f"{out}/names")
    store.write(graph.symmetric(pairs(spark, sf_dir)).repartition("src").sortWithinPartitions("src", F.desc("docs_count")), f"{out}/edges")


#: Stored graphs of this application, by folder of tables.
_STORED: dict[tuple[str, str], str] = {}


def knowledge_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The stored graph of a folder's tables; built when an application first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not store.complete(spark, f"{_STORED[key]}/edges"):
        out = f"{store.work_folder(spark)}/graph-{uuid.uuid4().hex}"
        build_knowledge_graph(spark, sf_dir, out)
        store.forget_later(spark, out)
        _STORED[key] = out
    v = spark.read.parquet(f"{_STORED[key]}/vertices")
    return Graph(v, spark.read.parquet(f"{_STORED[key]}/edges"), v.limit(0), spark.read.parquet(f"{_STORED[key]}/names"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the order lines: each part name as a model writes it, with its concept where it has one."""
    m = mentions(spark, sf_dir)
    e = entities(spark, sf_dir).select(F.col("id").alias("entity_id"), "entity_type", "umls_cui", "umls_preferred_name")
    brand = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_brand").alias("source_label"))
    rows = m.join(e, "entity_id").join(brand, "text")
    shout = F.when(F.col("sentence_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    return rows.select(
        "doc_id", shout.alias("text"), (F.col("sentence_id") * 3).alias("start_pos"), (F.col("sentence_id") * 3 + F.length("text")).alias("end_pos"), F.element_at(F.array(F.lit("bionlp"), F.lit("craft"), F.lit("bc5cdr")), F.col("sentence_id") % 3 + 1).alias("source_model"),
        "entity_type", "source_label", "sentence_id", "sentence_text", F.when(F.col("umls_cui").isNotNull(), F.lit(0.9)).alias("linking_confidence"), "umls_cui", "umls_preferred_name", F.lit(None).cast("string").alias("chebi_id"), F.lit(None).cast("string").alias("go_id"), F.lit(None).cast("string").alias("mesh_id"),
        F.col("sentence_id").cast("long").alias("mention_seq"),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents: words of four letters or more that 20 documents have, however many more do, each with a model and label."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term")).where(F.length("term") >= 4)
    terms = words.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")
    kind = F.length("term") % 3
    label = F.element_at(F.array(F.lit("GGP"), F.lit("DISEASE"), F.lit("CHEBI")), kind + 1)
    return terms.select("term", F.element_at(F.array(F.lit("bionlp"), F.lit("bc5cdr"), F.lit("craft")), kind + 1).alias("source_model"), label.alias("source_label"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of one to three words: the words of :func:`dictionary`, and runs of two that 12 documents have or of three that six have."""
    runs = lambda n: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?=((?<![\p{L}\p{N}])[\p{L}\p{N}]+" + r"[ ][\p{L}\p{N}]+" * (n - 1) + r"(?![\p{L}\p{N}])))"), F.lit(1)))).alias("term")
    docs, kind = table(spark, sf_dir, "documents"), F.length("term") % 3
    many = lambda n, least: docs.select("doc_id", runs(n)).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("term")
    terms = many(1, 20).where(F.length("term") >= 4).unionByName(many(2, 12)).unionByName(many(3, 6))
    return terms.select("term", F.element_at(F.array(F.lit("bionlp"), F.lit("bc5cdr"), F.lit("craft")), kind + 1).alias("source_model"), F.element_at(F.array(F.lit("GGP"), F.lit("DISEASE"), F.lit("CHEBI")), kind + 1).alias("source_label"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article records."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("pmid"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("abstract"), F.lit("Article").alias("document_type"), F.col("source").alias("journal"), (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("year"), F.when(F.col("doc_id") % 2 == 0, F.lit("Doe Jane")).otherwise(F.lit("")).alias("authors"), F.lit(None).cast("string").alias("mesh_terms"), F.lit(None).cast("string").alias("doi"), F.col("lang").alias("keywords"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, *parts: Column | str, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"</{name}>"))


def chapter_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of an article and a book chapter for each document; every other chapter has only the book's editors."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id").cast("string")
    person = lambda fore, last: _tag("Author", _tag("LastName", last), *([_tag("ForeName", fore)] if fore else []))
    own = F.when(F.col("doc_id") % 2 == 1, _tag("AuthorList", person("Bo", "Au"), person("", "Lee"))).otherwise(F.lit(""))
    book = _tag("Book", _tag("BookTitle", "Book of ", _escaped(F.col("source"))), _tag("PubDate", _tag("Year", (F.lit(2000) + F.col("doc_id") % 20).cast("string"))), _tag("AuthorList", person("Ann", "Ed"), attributes=' Type="editors"'))
    chapter = _tag("PubmedBookArticle", _tag("BookDocument", _tag("PMID", k), _tag("ArticleTitle", "Chapter ", k), book, own, _tag("Abstract", _tag("AbstractText", _escaped(F.coalesce("text", F.lit("")))))))
    article = _tag("PubmedArticle", _tag("PMID", "A", k), _tag("Journal", _tag("Title", _escaped(F.col("source")))), _tag("ArticleTitle", "Part one", "<i>two</i>"), _tag("OtherAbstract", _tag("AbstractText", "no interests"), attributes=' Type="COI"'), _tag("Abstract", _tag("AbstractText", "x"), _tag("AbstractText", "y")))
    return d.select(_tag("PubmedArticleSet", chapter, article, "<Other><PMID>0</PMID></Other>").alias("xml"))


def full_text_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full text for each document; ids, titles, journals, years and authors are missing in turn."""
    d = table(spark, sf_dir, "documents")
    k, n = F.col("doc_id").cast("string"), F.col("doc_id")
    pmid = F.when(n % 2 == 0, _tag("article-id", k, attributes=' pub-id-type="pmid"')).otherwise(F.lit(""))
    title = F.when(n % 5 == 0, F.lit("")).otherwise(_tag("title-group", _tag("article-title", "Title ", k)))
    journal = F.when(F.col("source").isNull(), F.lit("")).otherwise(_tag("journal-meta", _tag("journal-title", _escaped(F.col("source")))))
    year = F.when(n % 3 == 0, F.lit("unknown")).otherwise((F.lit(1990) + n % 3).cast("string"))
    author = F.when(n % 2 == 0, _tag("contrib", _tag("name", _tag("surname", "Doe"), _tag("given-names", "Jo")), attributes=' contrib-type="author"')).otherwise(_tag("contrib", _tag("name", _tag("surname", "Only")), attributes=' contrib-type="author"'))
    meta = _tag("article-meta", _tag("article-id", "PMC", k, attributes=' pub-id-type="pmc"'), pmid, title, author, _tag("pub-date", _tag("year", year)), _tag("abstract", _tag("p", "Sum ", "<i>up</i>")))
    return d.select(_tag("article", _tag("front", journal, meta), _tag("body", _tag("p", "Body of ", k))).alias("xml"))


def article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML text for each document; every 50th is cut off and so no XML."""
    d = table(spark, sf_dir, "documents")
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    body = F.concat(part("PMID", F.col("doc_id").cast("string")), part("Journal", part("Title", F.col("source"))), part("ArticleTitle", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))), part("Abstract", part("AbstractText", escape(F.col("text")))), part("KeywordList", part("Keyword", F.col("lang"))))
    whole = part("PubmedArticleSet", part("PubmedArticle", body))
    return d.select("doc_id", F.when(F.col("doc_id") % 50 == 49, F.substring(whole, 1, 40)).otherwise(whole).alias("xml"))
