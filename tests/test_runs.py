"""Sources, agent and whole runs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evigraph.config import AgentConfig, FilterConfig, LinkerConfig
from evigraph.operators import documents, graph, linking, mentions, metrics
from evigraph.plans import agent, bindings, pipeline
from evigraph.sources import articles, literature, store
from evigraph.streaming import resume

ARTICLE = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>One <i>two</i></ArticleTitle><Abstract><AbstractText>First.</AbstractText><AbstractText>Second <b>x</b> y</AbstractText></Abstract>
<AuthorList><Author><LastName>Smith</LastName><ForeName>John</ForeName></Author><Author><ForeName>No</ForeName></Author><Author><LastName>Lee</LastName></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName>Neoplasms</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Glucose</DescriptorName></MeshHeading></MeshHeadingList>
<OtherAbstract Type="COI"><AbstractText>None declared.</AbstractText></OtherAbstract><KeywordList><Keyword> a </Keyword><Keyword>b</Keyword></KeywordList><PubDate><Year>2024</Year></PubDate></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId><ArticleId IdType="doi"> 10.1/x </ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>8</PMID><Book><BookTitle>Book</BookTitle><AuthorList Type="editors"><Author><LastName>Ed</LastName><ForeName>A</ForeName></Author></AuthorList></Book><Abstract><AbstractText>Chapter.</AbstractText></Abstract></BookDocument></PubmedBookArticle><Other><PMID>9</PMID></Other></PubmedArticleSet>"""
FULL = """<pmc><article><front><journal-meta><journal-title>FJ</journal-title></journal-meta><article-meta><article-id pub-id-type="pmc">PMC1</article-id><article-id pub-id-type="pmid">5</article-id><title-group><article-title>T</article-title></title-group>
<contrib contrib-type="author"><name><surname>Doe</surname><given-names>John</given-names></name></contrib><pub-date><year>x</year></pub-date><abstract>Ab <i>in</i></abstract></article-meta></front><body><p>Body.</p></body></article>
<article><front><article-meta><article-id>PMC123</article-id></article-meta></front></article><article><body/></article></pmc>"""


def test_abstract_records():
    a, b = articles.parse_abstracts(ARTICLE)
    assert (a["pmid"], a["title"], a["abstract"], a["journal"], a["year"], a["authors"], a["mesh_terms"], a["doi"], a["keywords"]) == ("7", "One ", "First. Second", "J", 2024, "John Smith, Lee", "Neoplasms, Glucose", "10.1/x", "a, b")
    assert (b["document_type"], b["title"], b["journal"], b["authors"], b["abstract"], b["year"]) == ("BookChapter", "Book", "Book", "A Ed", "Chapter.", None)
    only_coi = '<S><PubmedArticle><PMID>1</PMID><OtherAbstract Type="coi"><AbstractText>C</AbstractText></OtherAbstract></PubmedArticle></S>'
    assert articles.parse_abstracts(only_coi)[0]["abstract"] == "C"
    assert articles.parse_abstracts("invalid xml") == [] == articles.parse_abstracts(None)


def test_full_texts():
    a, b = articles.parse_full_texts(FULL)
    assert (a["pmid"], a["abstract"], a["authors"], a["year"], a["journal"], a["pmc_id"]) == ("5", "Ab in\n\nBody.", "John Doe", None, "FJ", None)
    assert (b["pmid"], b["title"], b["journal"], b["authors"], b["pmc_id"]) == ("PMC123", "No title", "Unknown journal", None, "PMC123")


def test_routes():
    assert agent.route("What genes are associated with disease blue bolt?") == ("FindGenesForDisease", {"disease": "blue bolt"})
    assert agent.route("What diseases involve gene red anvil?") == ("FindDiseasesForGene", {"gene": "red anvil"})
    assert agent.route("Explain the relationship between a b and c") == ("ExplainRelationship", {"entity_a": "a b", "entity_b": "c"})
    assert agent.route("Which genes are linked to both x and y?") == ("FindSharedNeighbors", {"entity_a": "x", "entity_b": "y", "neighbor_type": "gene"})
    assert agent.route("What is metformin related to?") == ("FindEntityNeighbors", {"entity": "metformin", "entity_type": None})
    assert agent.split_pair("a, b, c") == ("a", "b, c") and agent.split_pair("a") is None


def test_answers(spark):
    g = bindings.knowledge_graph(spark, "/root/testdata/sf0.001")
    r = agent.ask(g, "What is blue related to?", [{"role": "user", "content": str(i)} for i in range(20)], AgentConfig(min_evidence=2))
    assert r["tool"] == "FindEntityNeighbors" and r["doc_ids"] and len(r["messages"]) == 12
    assert agent.grounding(r["answer"], r["tool_output"])["invented"] == []
    assert agent.grounding("- **Other** -- x", r["tool_output"])["invented"] == ["Other"]
    rows = agent.TOOLS["FindEntityNeighbors"](g, AgentConfig(min_evidence=2), agent.no_concepts, entity="blue")
    listed = agent.blocks(rows, [F.desc("docs_count"), "neighbor_name", "neighbor_id"]).orderBy("pos").collect()
    assert r["tool_output"] == "\n".join(x["block"] for x in listed)
    assert agent.ask(g, "What is nobody related to?")["tool_output"] == "No results found in knowledge graph."
    broken = agent.ask(graph.Graph(g.vertices.drop("name"), g.edges, g.stats), "What is blue related to?")
    assert "messages" not in broken and broken["doc_ids"] == [] and broken["error"]
    with pytest.raises(AttributeError):
        agent.ask(None, "What is blue related to?")  # a fault of the program is no answer


def test_questions_by_concept(spark):
    g = bindings.knowledge_graph(spark, "/root/testdata/sf0.001")
    one = g.vertices.where("umls_cui IS NOT NULL").orderBy("id").first()
    aliases = spark.createDataFrame([("my own word", one["umls_cui"], 0.9, "x", "y", None), ("weak", "C9", 0.2, "x", "y", None)], "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>")
    link = agent.linker(aliases)
    assert link("My own word") == [one["umls_cui"]] and link("weak") == link("other") == link("") == [] and agent.linker(None)("x") == []
    r = agent.ask(g, "What is my own word related to?", config=AgentConfig(min_evidence=1), concepts=link)
    assert r["doc_ids"] and not agent.ask(g, "What is my own word related to?", config=AgentConfig(min_evidence=1))["doc_ids"]
    assert linking.loaded(lambda: spark.read.parquet("/no/such/table")) is None and linking.loaded(lambda: aliases, LinkerConfig(enabled=False)) is None
    assert graph.named_pair(g, one["name"].upper(), "nobody").count() == 0


def test_run_and_resume(spark, tmp_path):
    rows = [(str(i), f"202{i % 3}-0{i % 9 + 1}-11", f"<S><PubmedArticle><PMID>{i}</PMID><ArticleTitle>t</ArticleTitle><Abstract><AbstractText>Glucose meets insulin in trial {i}. Insulin alone.</AbstractText></Abstract></PubmedArticle></S>") for i in range(12)]
    corpus, out = str(tmp_path / "literature"), str(tmp_path / "run")
    spark.createDataFrame(rows, "pmid string, day string, xml string").write.parquet(corpus)
    assert literature.total(spark, corpus, "GLUCOSE") == 12
    assert literature.search(spark, corpus, "insulin", 5, cap=3, year=2023).count() == 5
    terms = spark.createDataFrame([("glucose", "bc5cdr", "CHEMICAL"), ("insulin", "bionlp", "GENE_OR_GENE_PRODUCT")], "term string, source_model string, source_label string")
    aliases = spark.createDataFrame([("glucose", "C1", 0.9, "Glucose", "g", None)], "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>")
    done = pipeline.run(spark, corpus, "insulin", 100, terms, aliases, out)
    assert done["steps_completed"] == 4 and done["nlp"] == {"doc_count": 12, "entity_count": 36, "umls_linked": 12, "umls_rate": 33.3, "output_path": f"{out}/nlp"}
    assert done["kg"]["entities"] == 2 and done["kg"]["cooccurrences"] == 1 and done["graph"]["relationships_created"] == 1
    assert pipeline.needed(spark, out) == []
    store.clear(spark, f"{out}/kg")
    assert pipeline.resume(spark, terms, aliases, out, filters=FilterConfig(99, 1))["steps_needed"] == ["kg", "graph"]
    assert pipeline.load_graph(spark, f"{out}/graph").edges.count() == 0
    again = pipeline.annotate_and_link(spark, spark.createDataFrame([("0", "x", "Glucose."), ("new", "x", "Glucose, insulin.")], "id string, title string, text string").withColumns({"source": F.lit("s"), "pub_year": F.lit(1), "extras": F.create_map().cast("map<string,string>")}), terms, aliases, f"{out}/nlp")
    assert (again["doc_count"], again["entity_count"]) == (13, 38)
    assert store.point(spark, f"{out}/nlp/documents", "id", "new")["id"] == "new" and store.point(spark, f"{out}/nlp/documents", "id", "o'x") is None
    with pytest.raises(FileNotFoundError):
        pipeline.resume(spark, terms, aliases, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.table_path()
    with pytest.raises(RuntimeError):
        literature.checked("<ERROR>no</ERROR>")


def test_stream_resumes(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "id string, text string"
    spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], schema).write.parquet(folder)
    assert resume.process_new(spark, folder, schema, out, mark, lambda d: d) == 2
    spark.createDataFrame([("2", "b"), ("3", "c")], schema).write.mode("append").parquet(folder)
    assert resume.process_new(spark, folder, schema, out, mark, lambda d: d) == 3
    assert resume.process_new(spark, folder, schema, out, mark, lambda d: d) == 3


TERMS = [("glucose", "bc5cdr", "CHEMICAL"), ("insulin", "bionlp", "GENE_OR_GENE_PRODUCT"), ("breast cancer", "bc5cdr", "DISEASE"), ("cancer", "bc5cdr", "DISEASE"), ("cancer", "bionlp", "CANCER"), ("TNF-α", "bionlp", "GGP"), ("HER2", "bionlp", "GGP")]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, source_model string, source_label string")


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("glucose", "C1", 0.9, "Glucose", "g", ["T1"]), ("her2", "C2", 0.95, "ERBB2", "h", None)], "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>")


def test_terms_of_several_words(spark, terms):
    text = "HER2 in breast  cancer. Cancer, tnf-α and TNF α; HER22 Breast-cancer\nbreast\tCancer cancer"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = mentions.annotate(docs, terms).orderBy("mention_seq", "source_model").collect()
    assert all(text[r["start_pos"] : r["end_pos"]] == r["text"] for r in rows)
    assert [r["text"] for r in rows if r["source_model"] == "bc5cdr"] == ["breast  cancer", "Cancer", "cancer", "breast\tCancer", "cancer"]
    assert [r["text"] for r in rows if r["source_model"] == "bionlp"] == ["HER2", "cancer", "Cancer", "tnf-α", "cancer", "Cancer", "cancer"]
    assert not [r for r in rows if r["source_model"] == "bc5cdr" and r["text"].lower() == "cancer" and text[: r["start_pos"]].lower().endswith(("breast  ", "breast\t"))]
    assert mentions.annotator_info(terms)["models"]["bc5cdr"] == {"terms": 3, "labels": ["CHEMICAL", "DISEASE"]}


def test_texts_in_request_order(spark, terms, aliases, tmp_path):
    out = str(tmp_path / "nlp")
    texts = ["HER2 and glucose.", "nothing here", "Insulin or breast cancer? Glucose."]
    rows = pipeline.process_texts(spark, texts, terms, aliases, out, ["z", "a", "m"]).collect()
    assert [(r["pos"], r["id"], dict(r["entities"])) for r in rows] == [(0, "z", {"gene": ["HER2"], "chemical": ["glucose"]}), (1, "a", {}), (2, "m", {"gene": ["Insulin"], "disease": ["breast cancer", "cancer"], "chemical": ["Glucose"]})]
    assert [r["id"] for r in pipeline.process_texts(spark, [*texts, "glucose"], terms, aliases, out, ["z", "a", "m", "new"]).collect()] == ["z", "a", "m", "new"]
    assert len({r["id"] for r in pipeline.process_texts(spark, ["x", "x"], terms, None, str(tmp_path / "other")).collect()}) == 2
    with pytest.raises(ValueError):
        pipeline.process_texts(spark, texts, terms, aliases, out, ["z"])
    assert pipeline.process_text(spark, "insulin", terms, None, str(tmp_path / "demo"))["entities"] == {"gene": ["insulin"]}
    loaded = {r["id"]: r for r in pipeline.load_processed(spark, out).collect()}
    assert [e["umls_cui"] for e in loaded["z"]["entities"]] == ["C2", "C1"] and loaded["a"]["entities"] == [] and loaded["z"]["extras"] == {}
    info = documents.info(spark.read.parquet(f"{out}/documents"))
    assert info["doc_count"] == 4 and info["processed_at"] is not None
    with pytest.raises(RuntimeError):
        linking.check_updated(0, 3)
    linking.check_updated(0, 0)
    bench = metrics.benchmark(lambda: terms, lambda t: mentions.annotate(spark.createDataFrame([("d", "glucose")], "doc_id string, text string"), t), spark.range(2))
    assert (bench["mentions"], bench["per_document"], bench["labels"]) == (1, 0.5, ["CHEMICAL"]) and bench["run_seconds"] > 0


def test_link_fields_that_are_kept(spark):
    found = spark.createDataFrame([("d", "a", "gene", "C", 0.1, "n", ["T9"])], "doc_id string, text string, entity_type string, umls_cui string, linking_confidence double, umls_preferred_name string, umls_semantic_types array<string>")
    links = spark.createDataFrame([("a", "C1", 0.9, "A", [])], "text string, umls_cui string, linking_confidence double, umls_preferred_name string, umls_semantic_types array<string>")
    assert linking.apply_links(found, links).first()["umls_semantic_types"] is None
    kept = linking.apply_links(found, links, keep_types=True).first()
    assert kept["umls_semantic_types"] == ["T9"] and kept["umls_cui"] == "C1"


def test_searches(spark, tmp_path):
    a, b = str(tmp_path / "abstracts"), str(tmp_path / "full")
    one = "<S><PubmedArticle><PMID>{}</PMID><ArticleTitle>insulin</ArticleTitle></PubmedArticle></S>"
    spark.createDataFrame([(str(i), f"2024-01-{i % 28 + 1:02d}", one.format(i)) for i in range(60)] * 2, "pmid string, day string, xml string").write.parquet(a)
    spark.createDataFrame([("5", "2024-01-01", FULL.replace("<pmc>", "<pmc><!-- insulin -->"))], "pmid string, day string, xml string").write.parquet(b)
    all_ = [r["pmid"] for r in literature.search(spark, a, "Insulin", 60).collect()]
    assert len(all_) == len(set(all_)) == 60
    assert [r["pmid"] for r in literature.search(spark, a, "insulin", 7, start=50).collect()] == all_[50:57]
    assert literature.search(spark, a, "insulin", 40, cap=10, year=2024).count() == 40 and literature.search(spark, a, "nothing", 5).count() == 0
    assert [w[0] for w in literature.plan(literature._per_day(spark.read.parquet(a), "insulin"), 40, 20, 2024)] == ["2024-01-01", "2024-01-08", "2024-01-15"]
    ids = spark.createDataFrame([("3",), ("3",), ("99",)], "pmid string")
    got = literature.fetch(spark, a, ids)
    assert [r["pmid"] for r in got.collect()] == ["3"] and [r["pmid"] for r in documents.missing_ids(ids, got).collect()] == ["99"]
    name, found = literature.first_working(spark, {"gone": ("/no/such/table", True), "empty": (a, True), "full": (b, True), "abstracts": (a, False)}, "insulin")
    assert name == "full" and found.count() == 2
    assert literature.first_working(spark, {"gone": ("/no/such/table", True)}, "x") == (None, None)


def test_requests(spark):
    def service(ids):
        if "bad" in ids:
            return "<ERROR>no such id</ERROR>"
        return "<S>" + "".join(f"<PubmedArticle><PMID>{i}</PMID></PubmedArticle>" for i in ids) + "</S>"

    spark.dataSource.register(literature.requests(service))
    rows = spark.read.format("literature_requests").options(ids="1,2,3,bad,4", batch=2, pause=0, wait=0).load()
    assert sorted(r["pmid"] for r in articles.articles(rows).collect()) == ["1", "2", "4"]
    calls = []

    def down():
        calls.append(1)
        raise OSError("down")

    assert literature.with_retry(down, 3, 0, "none") == "none" and len(calls) == 3


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("10", 'a"b'), ("9", None), ("1", "ü")], "pmid string, v string")
    store.write(df, path)
    assert [r["pmid"] for r in store.ordered(spark, path).collect()] == ["1", "10", "9"] and store.reachable(spark, path) and not store.reachable(spark, path + "x")
    store.write_json_array(spark.read.parquet(path), path + ".json", ["pmid"])
    store.write_json_array(spark.read.parquet(path).limit(0), path + ".none", ["pmid"])
    read = lambda p: json.loads("".join(f.read_text(encoding="utf-8") for f in sorted(Path(p).glob("part-*"))))
    assert read(path + ".json") == [{"pmid": "1", "v": "ü"}, {"pmid": "10", "v": 'a"b'}, {"pmid": "9", "v": None}] and read(path + ".none") == []
    store.replace(spark.read.parquet(path).where("pmid <> '9'"), path)
    assert spark.read.parquet(path).count() == 2
    Path(path).rename(path + ".old")
    assert store.restore(spark, path) and spark.read.parquet(path).count() == 2 and not store.restore(spark, path + "y")
    assert store.point(spark, path, "v", 'a"b')["pmid"] == "10" and store.point(spark, path, "v", "\\' OR 1=1") is None
    ids = spark.createDataFrame([(0, "12"), (1, "3"), (2, "12"), (3, "412")], "pos int, id string")
    assert [r["id"] for r in documents.shown(ids, "12").collect()] == ["12", "412"] and [r["id"] for r in documents.shown(ids, " ").collect()] == ["12"] and documents.shown(ids, "x").count() == 0
    assert [r["v"] for r in metrics.by_length(df, "v").collect()] == ['a"b', "ü", None]


def test_merged_graph(spark, tmp_path):
    kg, out = str(tmp_path / "kg"), str(tmp_path / "graph")
    vertex = "id string, name string, entity_type string, umls_cui string"
    pair = "entity_a_id string, entity_b_id string, sent_count long, docs_count long, doc_ids_sample array<string>, evidence_sentences array<string>"
    store.write(spark.createDataFrame([("a", "a", "gene", None), ("b", "b", "gene", None)], vertex), f"{kg}/entity")
    store.write(spark.createDataFrame([("a", "b", 5, 5, ["1"], ["s"])], pair), f"{kg}/cooccurrence")
    pipeline.merge_graph(spark, kg, out)
    store.write(spark.createDataFrame([("b", "new", "gene", None), ("c", "c", "gene", None)], vertex), f"{kg}/entity")
    store.write(spark.createDataFrame([("b", "c", 3, 2, ["2"], ["t"])], pair), f"{kg}/cooccurrence")
    for _ in range(2):
        pipeline.merge_graph(spark, kg, out)
    g = pipeline.load_graph(spark, out)
    assert {r["id"]: r["name"] for r in g.vertices.collect()} == {"a": "a", "b": "new", "c": "c"} and graph.duplicate_ids(g.vertices).count() == 0
    assert sorted((r["src"], r["dst"], r["docs_count"]) for r in g.edges.collect()) == [("a", "b", 5), ("b", "a", 5), ("b", "c", 2), ("c", "b", 2)]
