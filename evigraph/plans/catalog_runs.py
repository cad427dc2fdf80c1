"""Further registered queries: near-miss linking, phrases, tables that grow by batches, searches that lose nothing."""

from __future__ import annotations

import uuid
from dataclasses import astuple
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FilterConfig, LinkerConfig, NerConfig
from ..operators import candidates, cooccurrence, documents, graph, ids, linking, mentions, metrics, names
from ..sources import articles, batches, literature, store
from . import bindings, pipeline
from .bindings import table
from .catalog import CONTEXT, EDGE, ENTITY, EVIDENCE, GAZETTEER, KG, ORACLE, _aliases, query

# ---- near-miss linking ---------------------------------------------------------------------------------------------------------
#: The trigrams of a name in DuckDB.
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: ('  ' || {0} || ' ')[i:i + 2]))"
OVERLAP = "o AS (SELECT text, alias, count(*) AS n FROM (SELECT text, unnest(x) AS gram FROM g) JOIN (SELECT alias, unnest(y) AS gram FROM h) USING (gram) GROUP BY ALL), s AS (SELECT text, alias, n / sqrt((len(x) * len(y))::DOUBLE) AS similarity FROM o JOIN g USING (text) JOIN h USING (alias))"


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS alias FROM documents), al AS (SELECT alias FROM w WHERE length(alias) >= 4 GROUP BY 1 HAVING count(*) >= 20),
tx AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS text FROM conversations), g AS (SELECT text, {GRAMS.format("text")} AS x FROM tx), h AS (SELECT alias, {GRAMS.format("alias")} AS y FROM al), {OVERLAP},
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, alias)::INT AS rank FROM s WHERE similarity >= 0.7) SELECT text, rank, alias, round(similarity, 6) AS similarity FROM r WHERE rank <= 3""")
def near_candidates(spark, sf):
    """The three dictionary terms most like each word of the conversations."""
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("text"))
    return candidates.candidates(words, bindings.dictionary(spark, sf).withColumnRenamed("term", "alias"), k=3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {ENTITY}, tx AS (SELECT DISTINCT p_name[:p_partkey % length(p_name)] || p_name[p_partkey % length(p_name) + 2:] AS text FROM part), al AS (SELECT name AS alias, umls_cui, CASE WHEN length(name) % 2 = 0 THEN 0.95 ELSE 0.45 END::DOUBLE AS confidence FROM ent WHERE umls_cui IS NOT NULL),
t2 AS (SELECT text, lower(trim(text)) AS name FROM tx), g AS (SELECT name AS text, {GRAMS.format("name")} AS x FROM (SELECT DISTINCT name FROM t2)), h AS (SELECT alias, {GRAMS.format("alias")} AS y FROM al), {OVERLAP},
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, alias) AS k FROM s WHERE similarity >= 0.6)
SELECT t2.text, round(coalesce(e.confidence, similarity), 6) AS linking_confidence, CASE WHEN coalesce(e.confidence, similarity) >= 0.7 THEN coalesce(e.umls_cui, a.umls_cui) END AS umls_cui
FROM t2 LEFT JOIN al e ON e.alias = t2.name LEFT JOIN r ON r.text = t2.name AND k = 1 LEFT JOIN al a ON a.alias = r.alias""")
def near_miss_links(spark, sf):
    """Part names that lack one letter, linked to the concept of the name most like them; under the threshold the similarity stays."""
    at = (F.col("p_partkey") % F.length("p_name")).cast("int")
    texts = table(spark, sf, "part").select(F.concat(F.left("p_name", at), F.expr("substring(p_name, cast(p_partkey % length(p_name) as int) + 2)")).alias("text"))
    return linking.link(texts, _aliases(spark, sf), LinkerConfig(least_similarity=0.6)).select("text", F.round("linking_confidence", 6).alias("linking_confidence"), "umls_cui")


# ---- phrases -------------------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+') AS c FROM documents), p AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM s),
e AS (SELECT doc_id, i, regexp_extract(c, '[\\p{L}\\p{N}]+$') AS w, regexp_extract(c, '^[^\\p{L}\\p{N}]*') AS gap, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p),
n AS (SELECT *, lead(w) OVER q AS w2, lead(gap) OVER q AS g2, lead(e) OVER q AS e2, lead(w, 2) OVER q AS w3, lead(gap, 2) OVER q AS g3, lead(e, 2) OVER q AS e3 FROM e WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, lower(w) AS term, e - length(w) AS a, e AS b, 1 AS k FROM n UNION ALL SELECT doc_id, lower(w || ' ' || w2), e - length(w), e2, 2 FROM n WHERE g2 = ' ' UNION ALL SELECT doc_id, lower(w || ' ' || w2 || ' ' || w3), e - length(w), e3, 3 FROM n WHERE g2 = ' ' AND g3 = ' '),
t AS (SELECT term, length(term) % 3 AS m FROM r GROUP BY term, k HAVING count(DISTINCT doc_id) >= CASE k WHEN 1 THEN 20 WHEN 2 THEN 12 ELSE 6 END AND (k > 1 OR length(term) >= 4)),
h AS (SELECT doc_id, a, b, m FROM r JOIN t USING (term)), o AS (SELECT *, max(b) OVER (PARTITION BY doc_id, m ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS outer_end FROM h)
SELECT doc_id::VARCHAR AS doc_id, a::INT AS start_pos, b::INT AS end_pos, ['bionlp', 'bc5cdr', 'craft'][m + 1] AS source_model FROM o WHERE outer_end IS NULL OR outer_end < b""")
def phrase_mentions(spark, sf):
    """Mentions of terms of one, two and three words in all documents; of one model's mentions within each other the longest."""
    return mentions.annotate(table(spark, sf, "documents"), store.cut(bindings.phrases(spark, sf), "terms")).select("doc_id", "start_pos", "end_pos", "source_model")


# ---- tables that grow by batches -----------------------------------------------------------------------------------------------
def _folder(spark, name):
    out = f"{store.work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store.forget_later(spark, out)
    return out


def _three_batches(spark, sf):
    """The annotations of the orders as they come in three batches, each added to the tables of the graph; the tables' folder."""
    out = _folder(spark, "grown")
    found = store.cut(bindings.found(spark, sf).withColumn("part", F.crc32("doc_id") % 3), "found")
    for i in range(3):
        mine = found.where(F.col("part") == i).drop("part")
        batches.write(mine, f"{out}/nlp/entities", batches.numbered(i))
        batches.write(mine.select(F.col("doc_id").alias("id")).distinct(), f"{out}/nlp/documents", batches.numbered(i))
        pipeline.extend_kg(spark, f"{out}/nlp", f"{out}/kg")
    return f"{out}/kg"


@query(f"""WITH {ENTITY}, {CONTEXT}, {EVIDENCE} SELECT ea AS entity_a_id, eb AS entity_b_id, sent_count, docs_count, string_agg(doc_id, ',' ORDER BY pos) AS docs, string_agg(st, '|' ORDER BY pos) AS sentences FROM co JOIN ev USING (ea, eb) GROUP BY ALL""")
def pairs_of_three_batches(spark, sf):
    """Counts and evidence of all pairs, kept up to date over three batches without a second look at earlier mentions."""
    rows = spark.read.parquet(f"{_three_batches(spark, sf)}/cooccurrence")
    return rows.select("entity_a_id", "entity_b_id", "sent_count", "docs_count", F.array_join("doc_ids_sample", ",").alias("docs"), F.array_join("evidence_sentences", "|").alias("sentences"))


@query(f"""WITH {ENTITY}, {CONTEXT}, f AS (SELECT entity_id AS id, min(row(doc_id, sentence_id)) AS first_at FROM men GROUP BY 1) SELECT ent.id, name, ent.entity_type, umls_cui FROM ent JOIN f USING (id)""")
def entities_of_three_batches(spark, sf):
    """Entities by their first mention, over three batches."""
    return spark.read.parquet(f"{_three_batches(spark, sf)}/entity").select("id", "name", "entity_type", "umls_cui")


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey::VARCHAR AS p FROM lineitem) SELECT a.p AS entity_a_id, b.p AS entity_b_id, count(*) AS sentences FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.p < b.p GROUP BY ALL HAVING count(*) >= 18""")
def pairs_in_large_sentences(spark, sf):
    """Parts that 18 suppliers or more have in common: a supplier's hundreds of parts are one sentence, paired in the tasks that count."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("sentence_id"), F.col("l_partkey").cast("string").alias("entity_id"))
    return cooccurrence.frequent(lines, 18, keep=store.cut).select("entity_a_id", "entity_b_id", F.col("sent_count").alias("sentences"))


# ---- searches ------------------------------------------------------------------------------------------------------------------
DAYS = """d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN '2019-06-15' WHEN doc_id % 11 = 0 THEN '2019-06-' || lpad((1 + doc_id % 9)::VARCHAR, 2, '0') ELSE (2000 + doc_id % 20) || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') END AS day FROM documents)"""
CAP = 50


def _literature(spark, sf):
    """The documents as a literature store: a seventh without a day, a third of the others on one day."""
    out, n = _folder(spark, "literature"), F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    plain = F.concat((F.lit(2000) + n % 20).cast("string"), F.lit("-"), two(1 + n % 12), F.lit("-"), two(1 + n % 28))
    day = F.when(n % 7 == 3, F.lit(None)).when(n % 3 == 0, F.lit("2019-06-15")).when(n % 11 == 0, F.concat(F.lit("2019-06-"), two(1 + n % 9))).otherwise(plain)
    store.write(bindings.article_xml(spark, sf).select(n.cast("string").alias("pmid"), day.alias("day"), "xml"), out)
    return out


@query(f"WITH {DAYS} SELECT doc_id::VARCHAR AS pmid, day FROM d")
def search_for_everything(spark, sf):
    """All records of a term that all have, dated or not, where a request may return 50 and one day has a third."""
    return literature.search(spark, _literature(spark, sf), "PubMedArticle", 1 << 60, cap=CAP, year=2025).select("pmid", "day")


@query(f"WITH {DAYS} SELECT doc_id::VARCHAR AS pmid, day FROM d ORDER BY day DESC NULLS LAST, pmid OFFSET 30 LIMIT 400")
def search_for_the_newest(spark, sf):
    """The records from the 31st to the 430th, newest first; the day that has a third of them is cut by pages."""
    return literature.search(spark, _literature(spark, sf), "PubMedArticle", 400, cap=CAP, year=2025, start=30).select("pmid", "day")


@query(f"""WITH {DAYS}, n AS (SELECT day, day[:4] AS y, day[:7] AS m, (day[9:10]::INT - 1) // 7 AS w, count(*) AS n FROM d WHERE day IS NOT NULL GROUP BY 1),
t AS (SELECT *, sum(n) OVER (PARTITION BY y) AS in_y, sum(n) OVER (PARTITION BY m) AS in_m, sum(n) OVER (PARTITION BY m, w) AS in_w FROM n),
s AS (SELECT CASE WHEN in_y <= {CAP} THEN y || '-01-01' WHEN in_m <= {CAP} THEN m || '-01' WHEN in_w <= {CAP} THEN m || '-' || lpad((w * 7 + 1)::VARCHAR, 2, '0') ELSE day END AS first_day, sum(n) AS n FROM t GROUP BY 1)
SELECT first_day, k::BIGINT AS first_hit, least({CAP}, n - k)::BIGINT AS hits FROM s, LATERAL (SELECT unnest(range(0, n::BIGINT, {CAP})) AS k)""")
def search_windows(spark, sf):
    """The windows by which the whole store can be fetched: years, months, weeks, days and pages of days, none over 50."""
    per_day = {d: n for d, n in literature._per_day(spark.read.parquet(_literature(spark, sf)), "pubmedarticle").items() if d is not None}
    found = ids.windows(lambda a, b: sum(n for d, n in per_day.items() if a <= d <= b), 1 << 60, 2025, CAP)
    return spark.createDataFrame([astuple(w) for w in found], "first_day string, last_day string, hits long, first_hit long").select("first_day", "first_hit", "hits")


# ---- questions with their evidence ---------------------------------------------------------------------------------------------
TOLD = "told AS (SELECT ea, eb, list(doc_id ORDER BY pos) AS docs, list(st ORDER BY pos) AS said FROM ev GROUP BY ALL)"


@query(f"""{KG}, {EVIDENCE}, {EDGE}, {TOLD}, hit AS (SELECT s.id AS src, n.id AS neighbor_id, n.name AS neighbor_name, g.docs_count, row_number() OVER (PARTITION BY n.id ORDER BY g.docs_count DESC, g.sent_count DESC, s.id) AS r
FROM ent s JOIN edge g ON g.src = s.id JOIN ent n ON n.id = g.dst WHERE g.docs_count >= 2 AND contains(lower(s.name), 'lue r')), top AS (SELECT * FROM hit WHERE r = 1 ORDER BY docs_count DESC, neighbor_name, neighbor_id LIMIT 20)
SELECT neighbor_id, array_to_string(docs[:5], ',') AS docs, array_to_string(said, '|') AS sentences FROM top JOIN told ON ea = least(src, neighbor_id) AND eb = greatest(src, neighbor_id)""")
def neighbors_with_evidence(spark, sf):
    """The neighbours of the names that hold *lue r*, found by posting lists, with the lists of their edges."""
    rows = graph.neighbors(bindings.knowledge_graph(spark, sf), "lue r", min_evidence=2)
    return rows.select("neighbor_id", F.array_join("sample_doc_ids", ",").alias("docs"), F.array_join("evidence_sentences", "|").alias("sentences"))


@query(f"""{KG}, {EVIDENCE}, {EDGE}, {TOLD}, hit AS (SELECT n.id AS neighbor_id, n.name AS neighbor_name, a.id AS a, b.id AS b, g.docs_count + h.docs_count AS docs_count, row_number() OVER (PARTITION BY n.id ORDER BY g.docs_count + h.docs_count DESC, a.id, b.id) AS r
FROM ent a JOIN edge g ON g.src = a.id JOIN ent n ON n.id = g.dst JOIN edge h ON h.dst = n.id JOIN ent b ON b.id = h.src WHERE contains(lower(a.name), 'blue') AND contains(lower(b.name), 'ring') AND a.id <> b.id AND g.docs_count >= 3 AND h.docs_count >= 3),
top AS (SELECT * FROM hit WHERE r = 1 ORDER BY docs_count DESC, neighbor_name, neighbor_id LIMIT 20)
SELECT neighbor_id, array_to_string(list_concat(x.docs[:3], y.docs[:3]), ',') AS docs, array_to_string(list_concat(x.said[:2], y.said[:2]), '|') AS sentences
FROM top JOIN told x ON x.ea = least(a, neighbor_id) AND x.eb = greatest(a, neighbor_id) JOIN told y ON y.ea = least(b, neighbor_id) AND y.eb = greatest(b, neighbor_id)""")
def shared_neighbors_with_evidence(spark, sf):
    """Shared neighbours with the lists of both edges."""
    rows = graph.shared_neighbors(bindings.knowledge_graph(spark, sf), "blue", "ring")
    return rows.select("neighbor_id", F.array_join("sample_doc_ids", ",").alias("docs"), F.array_join("evidence_sentences", "|").alias("sentences"))


@query(f"""{KG}, {EVIDENCE}, {EDGE}, {TOLD}, best AS (SELECT src, dst, docs_count FROM ent x JOIN edge g ON g.src = x.id JOIN ent y ON y.id = g.dst WHERE contains(lower(x.name), 'blue') AND contains(lower(y.name), 'ring') ORDER BY docs_count DESC, sent_count DESC, src, dst LIMIT 1)
SELECT docs_count, array_to_string(docs[:5], ',') AS docs, array_to_string(said[:5], '|') AS sentences FROM best JOIN told ON ea = least(src, dst) AND eb = greatest(src, dst)""")
def explain_with_evidence(spark, sf):
    """The best edge between two names with its lists."""
    rows = graph.explain(bindings.knowledge_graph(spark, sf), "blue", "ring")
    return rows.select("docs_count", F.array_join("sample_doc_ids", ",").alias("docs"), F.array_join("evidence_sentences", "|").alias("sentences"))


TERMS = ("Mer#0000001", "#00000", "99", "0012", "no such")


@query(f"""SELECT t AS term, c_custkey::VARCHAR AS id FROM customer, (SELECT unnest({list(TERMS)!r}) AS t) WHERE contains(lower(c_name), lower(t))""")
def names_that_hold(spark, sf):
    """Customers by part of the name, over posting lists; a term shorter than a trigram takes the scan."""
    v = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("x").alias("entity_type"), F.lit(None).cast("string").alias("umls_cui"))
    out = _folder(spark, "names")
    store.write(names.postings(v), out)
    g = graph.Graph(v, v.limit(0), v.limit(0), spark.read.parquet(out))
    found = [graph.seeds(g, t).select(F.lit(t).alias("term"), F.col("src").alias("id")) for t in TERMS]
    return reduce(DataFrame.unionByName, found)


# ---- stored runs ---------------------------------------------------------------------------------------------------------------
HITS = f"""WITH {GAZETTEER}, s AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS c FROM documents), p AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM s),
e AS (SELECT doc_id, regexp_extract(c, '[\\p{{L}}\\p{{N}}]+$') AS text, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) AS end_pos FROM p),
h AS (SELECT doc_id::VARCHAR AS doc_id, text, (end_pos - length(text))::INT AS start_pos, CASE WHEN length(text) % 2 = 0 THEN 'C' || length(text) END AS umls_cui FROM e JOIN t ON t.term = lower(e.text) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text), (end_pos - length(text)) // 5 ORDER BY end_pos) = 1)"""
_RUNS: dict[tuple[str, str], str] = {}


def _annotated(spark, sf):
    """The folder of a run over all documents, annotated with the dictionary and linked where a term has an even number of letters; made once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS or not store.complete(spark, f"{_RUNS[key]}/documents"):
        out, terms = _folder(spark, "annotated"), store.cut(bindings.dictionary(spark, sf), "terms")
        n = F.length("term")
        aliases = terms.where(n % 2 == 0).select(F.col("term").alias("alias"), F.concat(F.lit("C"), n.cast("string")).alias("umls_cui"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("canonical_name"), F.upper("term").alias("first_alias"), F.lit(None).cast("array<string>").alias("umls_semantic_types"))
        pipeline.annotate_and_link(spark, documents.from_abstracts(bindings.articles(spark, sf)), terms, aliases, out, NerConfig(linker=LinkerConfig()))
        _RUNS[key] = out
    return _RUNS[key]


@query(f"{HITS} SELECT doc_id, text, start_pos, umls_cui FROM h")
def annotated_run(spark, sf):
    """All mentions of a run's store, one of each text within five characters, with their concepts."""
    return batches.read(spark, f"{_annotated(spark, sf)}/entities").select("doc_id", "text", "start_pos", "umls_cui")


@query(f"{HITS}, n AS (SELECT doc_id, count(*) AS n, string_agg(text, ' ' ORDER BY start_pos, length(text)) AS texts FROM h GROUP BY 1) SELECT d.doc_id::VARCHAR AS id, source AS journal, coalesce(n, 0) AS entities, coalesce(texts, '') AS texts FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id::VARCHAR")
def loaded_run(spark, sf):
    """The documents of a run's store with their metadata and entities."""
    rows = pipeline.load_processed(spark, _annotated(spark, sf), ("text",))
    return rows.select("id", F.try_element_at("extras", F.lit("journal")).alias("journal"), F.size("entities").cast("long").alias("entities"), F.array_join("entities.text", " ").alias("texts"))


@query(f"{HITS} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS mentions, count(umls_cui) AS linked FROM h")
def run_info(spark, sf):
    """What the store tells of itself, beside its linked mentions."""
    told = documents.info(batches.read(spark, f"{_annotated(spark, sf)}/documents"))
    linked = batches.read(spark, f"{_annotated(spark, sf)}/entities").agg(F.count("umls_cui").alias("linked"))
    return linked.select(F.lit(told["doc_count"]).cast("long").alias("documents"), F.lit(told["entity_count"]).cast("long").alias("mentions"), "linked")


@query(ORACLE["whole_run"])
def continued_run(spark, sf):
    """A run that stopped behind its corpus, continued to the end: its tables have the rows of a whole run."""
    out = _folder(spark, "continued")
    day = F.concat((F.lit(2000) + F.col("doc_id") % 20).cast("string"), F.lit("-01-01"))
    store.write(bindings.article_xml(spark, sf).select(F.col("doc_id").cast("string").alias("pmid"), day.alias("day"), "xml"), f"{out}/literature")
    aliases = spark.createDataFrame([], "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>")
    terms = store.cut(bindings.dictionary(spark, sf), "terms")
    pipeline.run(spark, f"{out}/literature", "pubmedarticle", 1 << 60, terms, aliases, out, steps=["corpus"])
    pipeline.resume(spark, terms, aliases, out)
    counts = {"documents": "nlp/documents", "mentions": "kg/mention", "entities": "kg/entity", "vertices": "graph/vertices"}
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/{t}").agg(F.lit(k).alias("what"), F.count("*").alias("n")).select("what", "n") for k, t in counts.items()])


# ---- merges, records, requests -------------------------------------------------------------------------------------------------
@query(f"""{KG} SELECT id, CASE WHEN length(name) % 2 = 0 THEN upper(name) ELSE name END AS name, entity_type FROM ent""")
def merged_vertices(spark, sf):
    """A graph to which the entities of even names are merged again under new names."""
    out, e = _folder(spark, "merged"), bindings.entities(spark, sf)
    store.write(bindings.pairs(spark, sf), f"{out}/kg/cooccurrence")
    store.write(e, f"{out}/kg/entity")
    pipeline.merge_graph(spark, f"{out}/kg", f"{out}/graph", FilterConfig(stopwords_enabled=False))
    store.replace(spark.read.parquet(f"{out}/kg/entity").where("length(name) % 2 = 0").withColumn("name", F.upper("name")), f"{out}/kg/entity")
    pipeline.merge_graph(spark, f"{out}/kg", f"{out}/graph", FilterConfig(stopwords_enabled=False))
    return pipeline.load_graph(spark, f"{out}/graph").vertices.select("id", "name", "entity_type")


@query(f"""{KG}, {EVIDENCE}, {EDGE}, {TOLD} SELECT src, dst, CASE WHEN docs_count % 3 = 0 THEN '' ELSE array_to_string(docs, ',') END AS docs FROM edge JOIN told ON ea = least(src, dst) AND eb = greatest(src, dst)""")
def edges_from_json(spark, sf):
    """Edges of pairs whose lists are JSON texts, a third of them none that can be read."""
    good = F.to_json("doc_ids_sample")
    rows = bindings.pairs(spark, sf).withColumn("doc_ids_sample", F.when(F.col("docs_count") % 6 == 0, F.lit(None)).when(F.col("docs_count") % 3 == 0, F.concat(F.lit("no list: "), good)).otherwise(good))
    return graph.symmetric(rows).select("src", "dst", F.array_join("sample_doc_ids", ",").alias("docs"))


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'PMC' || doc_id END AS id, CASE WHEN doc_id % 5 = 0 THEN 'No title' ELSE 'Title ' || doc_id END AS title, 'Sum up' || chr(10) || chr(10) || 'Body of ' || doc_id AS text, 'pmc' AS source,
CASE WHEN doc_id % 3 > 0 THEN (1990 + doc_id % 3)::INT END AS pub_year, nullif(coalesce(source, 'Unknown journal'), '') AS journal, CASE WHEN doc_id % 2 = 0 THEN 'Jo Doe' END AS authors FROM documents""")
def full_text_documents(spark, sf):
    """Full texts as documents; metadata that is not empty is among the extras."""
    rows = documents.from_full_texts(articles.articles(bindings.full_text_xml(spark, sf), full=True))
    return rows.select("id", "title", "text", "source", "pub_year", *[F.try_element_at("extras", F.lit(c)).alias(c) for c in ("journal", "authors")])


@query(f"""WITH {ENTITY} SELECT id, name || coalesce(' (' || umls_preferred_name || ')', '') AS label FROM ent""")
def preview_labels(spark, sf):
    return bindings.entities(spark, sf).select("id", metrics.preview_label().alias("label"))


@query("""SELECT doc_id::VARCHAR AS pmid, 'Title ' || doc_id AS title FROM documents""")
def requested_in_batches(spark, sf):
    """An article for each document's id, asked of a service in batches of 50 of which each fails once."""
    tried = set()

    def service(ids):
        if ids[0] not in tried:
            tried.add(ids[0])
            if len(tried) % 2:
                raise OSError("no connection")
            return "<ERROR>too busy</ERROR>"
        return "<PubmedArticleSet>" + "".join(f"<PubmedArticle><PMID>{i}</PMID><ArticleTitle>Title {i}</ArticleTitle></PubmedArticle>" for i in ids) + "</PubmedArticleSet>"

    wanted = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"))
    return articles.articles(literature.request_all(wanted, service, size=50, wait=0, pause=0)).select("pmid", "title")


@query(f"""WITH {ENTITY}, a AS (SELECT name, umls_cui, length(name) % 2 = 0 AS sure FROM ent WHERE umls_cui IS NOT NULL ORDER BY name LIMIT 4) SELECT name AS term, CASE WHEN sure THEN umls_cui END AS cui FROM a UNION ALL SELECT 'nothing like it', NULL""")
def concepts_of_terms(spark, sf):
    """The concept of a question's term: of four names, and of one that no name is like."""
    aliases = _aliases(spark, sf)
    terms = [r["alias"] for r in aliases.select("alias").orderBy("alias").limit(4).collect()] + ["nothing like it"]
    return spark.createDataFrame([(t, (linking.concepts(t, aliases) or [None])[0]) for t in terms], "term string, cui string")
