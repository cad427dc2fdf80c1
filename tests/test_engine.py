"""Behaviour of the engine's operators on small hand-written rows."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evigraph.config import FilterConfig, LinkerConfig, NerConfig, load_ner_config
from evigraph.functions import text
from evigraph.operators import cooccurrence, documents, filtering, graph, ids, linking, mentions, metrics
from evigraph.operators.graph import Graph
from evigraph.schemas import ARTICLE, ENTITY, EXTRACTED, LABEL_TYPES, LINK, MENTION, PAIR, STOPWORDS
from evigraph.sources import articles, store


def values(spark, *strings, fn):
    return [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string").orderBy("i").select(fn(F.col("s"))).collect()]


def found(spark, rows):
    """Extracted entities from (doc, text, start, model, type, sentence, cui)."""
    full = [(d, t, s, s + len(t), m, k, None, n, f"{d} sentence {n}", None, None, c, None, None, None, None, None, None, i) for i, (d, t, s, m, k, n, c) in enumerate(rows)]
    return spark.createDataFrame(full, EXTRACTED)


def test_names(spark):
    assert values(spark, "Glucose", "ASPIRIN", " p53 ", "", "  ", "COX-2", "TNF-α", " x\t", fn=text.normalize_name) == ["glucose", "aspirin", "p53", "", "", "cox-2", "tnf-α", "x"]


def test_entity_ids(spark):
    rows = [("C1", "X:1", None, None, "a"), ("", "X:1", "G", None, "a"), (None, "", "G", "M", "a"), (None, None, None, "M", "a"), (None, "", None, None, " Ab ")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, t string")
    assert [r[0] for r in df.select(text.entity_id(*(F.col(c) for c in "abcdt"))).collect()] == ["C1", "X:1", "G", "M", "CUSTOM:ab"]


def test_labels(spark):
    assert values(spark, "CHEBI", "GGP", "MULTI_TISSUE_STRUCTURE", "MULTI-TISSUE_STRUCTURE", None, fn=text.type_of_label) == ["chemical", "gene", "anatomy", "unknown", "unknown"]
    assert len(LABEL_TYPES) == 24 and len(set(LABEL_TYPES.values())) == 12 and len(STOPWORDS) == 75


@pytest.mark.parametrize(("name", "kind", "want"), [
    ("CDK4/6 Inhibition", "gene", "chemical"), ("Tumor Antigen-specific Antibody", "gene", "chemical"), ("Hamartoma Syndrome, Multiple", "gene", "disease"), ("ATPase inhibitor activity", "gene", "gene"), ("ALK Inhibitor", "gene", "chemical"),
    ("BRCA1 gene", "gene", "gene"), ("Immune Checkpoint Inhibitors", "cell_type", "chemical"), ("inhibitor syndrome", "chemical", "chemical"), ("antibody", "disease", "disease"), ("uninhibited", "gene", "gene"), ("antibodies", "gene", "chemical"),
])
def test_type_correction(spark, name, kind, want):
    df = spark.createDataFrame([(name, kind)], "t string, k string")
    assert df.select(text.corrected_type(F.col("t"), F.col("k"))).first()[0] == want


def test_citations(spark):
    def run(ids_, answer):
        return spark.createDataFrame([(ids_, answer)], "ids array<string>, a string").select(text.cited_ids(F.col("ids"), F.col("a")), text.linkify(F.col("a"), F.col("ids"))).first()

    assert run(["1", "22", "3"], "see 3 and 22")[0] == ["22", "3"]
    assert run(["1", "2"], "nothing")[0] == ["1", "2"]
    assert run(["1234567"], "in 12345678")[0] == ["1234567"]
    assert run(["12"], "at 12.")[1] == "at [12](https://pubmed.ncbi.nlm.nih.gov/12)."
    assert run([], "text 1")[1] == "text 1"
    assert run(["a.b"], "axb")[1] == "axb"


def test_mention_duplicates(spark):
    rows = [("d", "glucose", 0, "bc5cdr", "x", 0, None), ("d", "glucose", 0, "bionlp", "x", 0, None), ("d", "Glucose ", 10, "craft", "x", 0, None), ("d", " glucose", 9, "bc5cdr", "x", 0, None), ("d", "aspirin", 20, "bc5cdr", "x", 0, None), ("d", "cancer", 30, "bionlp", "x", 0, None)]
    kept = mentions.deduplicate(found(spark, rows), {"bc5cdr": 3, "bionlp": 2, "craft": 1}).collect()
    assert sorted((r["text"], r["start_pos"], r["source_model"]) for r in kept) == [(" glucose", 9, "bc5cdr"), ("Glucose ", 10, "craft"), ("aspirin", 20, "bc5cdr"), ("cancer", 30, "bionlp"), ("glucose", 0, "bc5cdr")]


def test_entities_and_mentions(spark):
    rows = [("d1", "TP53", 0, "m", "gene", 0, "C7"), ("d1", "p53", 0, "m", "disease", 1, "C7"), ("d2", "Glucose ", 0, "m", "chemical", 0, None), ("d2", "ab", 0, "m", "gene", 1, "C9")]
    e = {r["id"]: r for r in mentions.entities(found(spark, rows)).collect()}
    assert {k: (r["name"], r["entity_type"]) for k, r in e.items()} == {"C7": ("tp53", "gene"), "CUSTOM:glucose": ("glucose", "chemical")}
    assert sorted(r["text"] for r in mentions.mentions(found(spark, rows)).collect()) == ["Glucose ", "TP53", "p53"]
    assert mentions.entities(found(spark, [])).count() == 0


def _mentions(spark, rows):
    return spark.createDataFrame([(d, e, e, s, f"{d}/{s}", 0, 0, None, i) for i, (d, s, e) in enumerate(rows)], MENTION)


def test_pairs(spark):
    got = cooccurrence.cooccurrences(_mentions(spark, [("d1", 0, "A"), ("d1", 0, "B"), ("d1", 0, "B"), ("d1", 1, "B"), ("d1", 1, "C"), ("d2", 0, "A"), ("d2", 0, "C"), ("d3", 0, "D")])).collect()
    assert sorted((r[0], r[1], r["sent_count"], r["docs_count"]) for r in got) == [("A", "B", 1, 1), ("A", "C", 1, 1), ("B", "C", 1, 1)]


def test_evidence_takes_turns(spark):
    rows = [(f"d{d}", s, e) for d in range(10) for s in range(2) for e in "XY"]
    r = cooccurrence.cooccurrences(_mentions(spark, rows)).first()
    assert r["doc_ids_sample"] == [f"d{i}" for i in range(5)] and r["evidence_sentences"] == [f"d{i}/0" for i in range(5)]
    r = cooccurrence.cooccurrences(_mentions(spark, [("d1", 0, "X"), ("d1", 0, "Y"), ("d1", 1, "X"), ("d1", 1, "Y"), ("d2", 0, "X"), ("d2", 0, "Y")])).first()
    assert r["doc_ids_sample"] == ["d1", "d2", "d1"] and r["docs_count"] == 2 and r["sent_count"] == 3


def test_pairs_and_evidence_against_a_model(spark):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(6)}", rng.randrange(4), rng.choice("ABCDE")) for _ in range(120)]
    want = {}
    sentences = {}
    for i, (d, s, e) in enumerate(rows):
        sentences.setdefault((d, s), ([], i))[0].append(e)
    for (d, s), (es, first) in sentences.items():
        for pair in combinations(sorted(set(es)), 2):
            want.setdefault(pair, {}).setdefault(d, []).append((first, f"{d}/{s}"))
    got = {(r[0], r[1]): r for r in cooccurrence.cooccurrences(_mentions(spark, rows)).collect()}
    assert set(got) == set(want)
    for pair, by_doc in want.items():
        turns = []
        queues = {d: [t for _, t in sorted(x)] for d, x in sorted(by_doc.items())}
        while any(queues.values()) and len(turns) < 5:
            for d in queues:
                if queues[d] and len(turns) < 5:
                    turns.append((d, queues[d].pop(0)))
        r = got[pair]
        assert list(zip(r["doc_ids_sample"], r["evidence_sentences"], strict=True)) == turns
        assert (r["sent_count"], r["docs_count"]) == (sum(map(len, by_doc.values())), len(by_doc))


@pytest.fixture(scope="module")
def small(spark):
    names = [("brca1", "gene"), ("cancer", "disease"), ("aspirin", "chemical"), ("tp53", "gene"), ("patients", "disease")]
    e = spark.createDataFrame([(n, n, t, None, None, None, None, None) for n, t in names], ENTITY)
    p = spark.createDataFrame([("brca1", "cancer", 10, 5, ["a"], ["s"]), ("brca1", "aspirin", 1, 1, None, None), ("tp53", "cancer", 4, 3, ["b"], ["t"]), ("brca1", "patients", 15, 10, ["c"], ["u"]), ("brca1", "gone", 9, 9, None, None)], PAIR)
    return e, p


@pytest.mark.parametrize(("config", "kept"), [
    (FilterConfig(3, 1, False), 3), (FilterConfig(1, 5, False), 2), (FilterConfig(1, 1), 1), (FilterConfig(1, 1, False, (("gene", "chemical"),)), 1), (FilterConfig(1, 1, False, ()), 4), (FilterConfig(1, 1, True, None, frozenset({"Aspirin"})), 3),
])
def test_filters(small, config, kept):
    rows = filtering.named(small[1], small[0])
    a, b = filtering.split(rows, config)
    assert (a.count(), b.count()) == (kept, 4 - kept)


def test_reasons_and_sample(small):
    rows = filtering.named(small[1], small[0])
    got = {(r["entity_a_id"], r["entity_b_id"]): r["reasons"] for r in filtering.with_reasons(rows, FilterConfig(3, 5)).collect()}
    assert got[("brca1", "aspirin")] == ["docs_count", "sent_count"] and got[("brca1", "cancer")] == ["stopword"] and got[("tp53", "cancer")] == ["sent_count", "stopword"]
    s = [sorted(r["entity_b_id"] for r in filtering.sample_rows(rows, 2, 42).collect()) for _ in range(2)]
    assert s[0] == s[1] and len(s[0]) == 2 and filtering.sample_rows(rows, 99, 1).count() == 4


def test_graph(small):
    g = graph.build(*small, FilterConfig(2, 2, False))
    assert g.stats.first().asDict() == {"entities_created": 5, "relationships_created": 3, "entities_filtered": 0, "relationships_filtered": 1}
    assert g.edges.count() == 6 and g.vertices.count() == 5 and graph.duplicate_ids(g.vertices).count() == 0
    rows = graph.neighbors(g, "BRCA", min_evidence=1).collect()
    assert [r["neighbor_name"] for r in rows] == ["patients", "cancer"]
    assert [r["neighbor_name"] for r in graph.gene_diseases(g, "", min_evidence=1).collect()] == ["patients", "cancer"]
    r = graph.explain(g, "cancer", "tp53").first()
    assert r["found"] and r["docs_count"] == 3 and r["evidence_sentences"] == ["t"] and r["entity_b_type"] == "gene"
    r = graph.explain(g, "cancer", "nobody").first()
    assert not r["found"] and r["docs_count"] == 0 and r["sample_doc_ids"] == [] and r["entity_b_name"] == "nobody" and r["entity_a_type"] is None
    r = graph.shared_neighbors(g, "brca1", "tp53", min_evidence=1).collect()
    assert [(x["neighbor_name"], x["docs_count"], x["sample_doc_ids"]) for x in r] == [("cancer", 8, ["a", "b"])]


def test_json_lists(spark):
    p = spark.createDataFrame([("a", "b", 1, 1, '["x"]', "bad")], "entity_a_id string, entity_b_id string, sent_count long, docs_count long, doc_ids_sample string, evidence_sentences string")
    r = graph.symmetric(p).first()
    assert r["sample_doc_ids"] == ["x"] and r["evidence_sentences"] == []


def test_shared_neighbors_keep_the_best_pair(spark):
    rng = random.Random(3)
    names = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(2)] + ["ab"] + [f"n{i}" for i in range(4)]
    v = spark.createDataFrame([(n, n, "gene", None, None, None, None, None) for n in names], ENTITY)
    w = {p: rng.randrange(1, 6) for p in combinations(sorted(names), 2)}
    g = Graph(v, graph.symmetric(spark.createDataFrame([(a, b, n, n, [], []) for (a, b), n in w.items()], PAIR)), v)
    got = {r["neighbor_name"]: r["docs_count"] for r in graph.shared_neighbors(g, "a", "b", min_evidence=1, limit=50).collect()}
    weight = lambda x, y: w[tuple(sorted((x, y)))]
    for n in names:
        pairs = [weight(a, n) + weight(b, n) for a in names if "a" in a and a != n for b in names if "b" in b and b not in (n, a)]
        assert got[n] == max(pairs)


def test_linking(spark):
    texts = spark.createDataFrame([("Glucose",), ("Aspirin",), ("cancer",), ("nothing",), ("Glucose",)], "text string")
    aliases = spark.createDataFrame([("glucose", "C1", 0.95, None, "Glu", ["T1"]), ("aspirin", "C2", 0.89, "Aspirin", "A", None), ("cancer", "C3", 0.45, "Cancer", "C", None), ("cancer", "C4", 0.40, "x", "y", None)], "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>")
    got = {r["text"]: (r["umls_cui"], r["linking_confidence"], r["umls_preferred_name"]) for r in linking.link(texts, aliases).collect()}
    assert got == {"Glucose": ("C1", 0.95, "Glu"), "Aspirin": ("C2", 0.89, "Aspirin"), "cancer": (None, 0.45, None), "nothing": (None, None, None)}
    assert all(r["linking_confidence"] is None for r in linking.link(texts, aliases, LinkerConfig(enabled=False)).collect())
    store = spark.createDataFrame([("Glucose", "OLD", 0.8, "n", None, 1), ("Glucose", "C0", 0.9, "g", None, 2), ("cancer", None, 0.3, None, None, 1), ("Aspirin", None, None, None, None, 1)], LINK + ", mention_seq long")
    got = {r["text"]: r["umls_cui"] for r in linking.link_with_cache(texts, store, aliases).collect()}
    assert got == {"Glucose": "C0", "Aspirin": "C2", "cancer": None, "nothing": None}
    e = found(spark, [("d", "ALK Inhibitor", 0, "m", "gene", 0, "old")])
    r = linking.apply_links(e, spark.createDataFrame([("ALK Inhibitor", None, 0.1, None, None)], LINK)).first()
    assert (r["entity_type"], r["umls_cui"], r["linking_confidence"]) == ("chemical", None, 0.1)


def test_documents(spark):
    a = spark.createDataFrame([("1", None, "text", "Article", "J", 2001, "", None, "d", None, None)], ARTICLE)
    d = documents.from_abstracts(a)
    r = d.first()
    assert (r["id"], r["title"], r["text"], r["source"], r["extras"]) == ("1", "", "text", "pubmed", {"journal": "J", "doi": "d", "document_type": "Article"})
    stored = documents.processed(d.withColumn("extras", F.map_concat("extras", F.create_map(F.lit("pmc_id"), F.lit("P")))), found(spark, [("1", "abc", 0, "m", "x", 0, None)]), "{}")
    r = stored.first()
    assert (r["entity_count"], r["journal"], r["extras_json"]) == (1, "J", '{"pmc_id":"P"}')
    assert documents.restored(stored).first()["extras"] == {"journal": "J", "doi": "d", "document_type": "Article", "pmc_id": "P"}
    told = documents.info(stored)
    assert told.pop("processed_at") is not None and told == {"doc_count": 1, "entity_count": 1, "config_json": "{}"} and documents.info(stored.limit(0)) is None
    assert documents.info(stored.unionByName(stored.withColumn("config_json", F.lit("x")))) is None
    with pytest.raises(ValueError):
        documents.check_config(stored, "other")
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, o int")
    assert sorted(map(tuple, documents.upsert(old, new, "k", "o").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_windows():
    per = {f"2020-02-{d:02d}": 3 for d in range(1, 29)} | {"2020-01-05": 4}
    count = lambda a, b: sum(n for d, n in per.items() if a <= d <= b)
    got = ids.windows(count, 1000, 2021, cap=25)
    assert [(w.start, w.count) for w in got] == [("2020-02-01", 21), ("2020-02-08", 21), ("2020-02-15", 21), ("2020-02-22", 21), ("2020-01-01", 4)]
    assert [w.start for w in ids.windows(count, 30, 2021, cap=25)] == ["2020-02-01", "2020-02-08"]
    assert (ids.serve(15000, 15000), ids.serve(5000, 9000), ids.serve(15000, 100)) == (0, 5000, 100)


def test_limited_ids(spark):
    raw = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "d")], "pos int, id string")
    seen = spark.createDataFrame([("b",), ("z",)], "id string")
    assert [r["id"] for r in ids.deduplicate_and_limit(raw, seen, 4).orderBy("pos").collect()] == ["a", "c"]
    assert ids.deduplicate_and_limit(raw, seen, 1).count() == 0


def test_settings(tmp_path):
    for bad in (lambda: FilterConfig(0), lambda: LinkerConfig(core_model=" "), lambda: LinkerConfig(confidence_threshold=2), lambda: NerConfig({}), lambda: NerConfig({"craft": 0})):
        with pytest.raises(ValueError):
            bad()
    assert load_ner_config(str(tmp_path / "none.yaml")) == NerConfig()


def test_metrics_of_nothing(spark):
    e = found(spark, [])
    assert metrics.totals(spark.createDataFrame([], "id string"), e).first()["umls_rate"] == 0
    assert metrics.link_coverage(e).first()["mention_rate"] == 0


def test_rows_are_numbered_over_all_ranges(spark, tmp_path):
    rows = [(k % 7 if k % 11 else None, k if k % 5 else None) for k in range(200)]
    got = store.numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), str(tmp_path / "n"), F.desc_nulls_last("a"), F.asc_nulls_last("b"))
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0))
    assert [(r["pos"], r["a"], r["b"]) for r in got.orderBy("pos").collect()] == [(i + 1, *r) for i, r in enumerate(want)]
    assert store.numbered(spark.createDataFrame([], "a long, b long"), str(tmp_path / "none"), F.asc("a")).count() == 0


def test_results_in_request_order_are_numbered_without_gaps(spark):
    from evigraph.plans import catalog

    pos = sorted(r["pos"] for r in catalog.queries()["results_in_request_order"](spark, "/root/testdata/sf0.001").collect())
    assert pos == [*range(1, len(pos) + 1)]


def test_articles_leave_a_task_in_portions():
    text = lambda i: f"<s><PubmedArticle><PMID>{i}</PMID><Abstract><AbstractText>{'x' * 1000}</AbstractText></Abstract></PubmedArticle></s>"
    got = list(articles.portions([text(0), None, "no xml", *map(text, range(1, 100))], articles.parse_abstracts, 5000))
    assert [a["pmid"] for p in got for a in p] == [str(i) for i in range(100)] and max(map(len, got)) == 5 and got[-1]


def test_applied_links_are_counted_behind_the_shuffle(spark):
    from evigraph.plans import catalog

    plan = catalog.queries()["apply_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("partial_count(1)") < plan.index("Exchange hashpartitioning(doc_id")
