"""Streams of pages, keyed writers, the name index and pushed keys."""

import json
import os
import random
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evigraph.operators import graph, names
from evigraph.__main__ import log_to, parser
from evigraph.config import AgentConfig
from evigraph.plans import agent, bindings, pipeline
from evigraph.sources import service, store
from evigraph.workers import ship

HITS = {"2024": 23, "2023": 0, "2022": 7, "2021": 40}


def paged(log: str, broken: str = ""):
    """A service of HITS records, which notes each request; pages of ``broken`` fail while its file is there."""

    def count(window):
        return HITS[window]

    def fetch(window, start, size):
        Path(log, f"{time.time()}-{uuid.uuid4().hex}").write_text(f"{window}:{start}")
        if broken and os.path.exists(broken) and (window, start) == ("2021", 10):
            raise OSError("down")
        return [(f"{window}-{i}", f"<x>{i}</x>") for i in range(start, min(start + size, HITS[window]))]

    return service.pages(count, fetch)


def run(spark, tmp, rate=1000):
    rows = spark.readStream.format("literature_pages").options(windows=",".join(HITS), size=10, pages=3, rate=rate, tries=1, wait=0).load()
    query = rows.writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "mark")).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    ship(spark)
    (tmp_path / "log").mkdir()
    broken = tmp_path / "broken"
    broken.touch()
    spark.dataSource.register(paged(str(tmp_path / "log"), str(broken)))
    with pytest.raises(Exception, match="2021"):
        run(spark, tmp_path)
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < before < sum(HITS.values())
    broken.unlink()
    run(spark, tmp_path)
    got = [r["pmid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(f"{w}-{i}" for w, n in HITS.items() for i in range(n))
    asked = [p.read_text() for p in (tmp_path / "log").iterdir()]
    assert asked.count("2024:0") == 1  # what was committed before is not asked again


def test_requests_of_all_tasks_stay_within_the_rate(spark, tmp_path):
    ship(spark)
    (tmp_path / "log").mkdir()
    spark.dataSource.register(paged(str(tmp_path / "log")))
    run(spark, tmp_path, rate=10)
    at = sorted(float(p.name.split("-")[0]) for p in (tmp_path / "log").iterdir())
    assert len(at) == 8 and at[-1] - at[0] >= 0.3  # three pages at once, then their share of the rate


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = service.Pace(10, 2, lambda: now[0], sleep)
    for _ in range(4):
        pace.wait()
    assert [round(s, 6) for s in slept] == [0.2, 0.2, 0.2]
    now[0] += 100
    pace.wait()
    pace.wait()
    assert round(slept[-1], 6) == 0.2 and len(slept) == 4  # idle time is not saved up


def test_graph_is_written_once_through_faults(spark, tmp_path):
    ship(spark)
    folder, told = str(tmp_path / "store"), str(tmp_path / "told")
    Path(folder).mkdir()

    def send(kind, rows):
        rng = random.Random(time.time_ns())
        if rng.random() < 0.2:
            raise OSError("not sent")
        for r in rows:
            key = r["id"] if kind == "vertices" else f"{r['src']}~{r['dst']}"
            Path(folder, f"{kind}~{key}").write_text(json.dumps(r))
        if rng.random() < 0.2:
            raise OSError("the answer is lost")
        return "<ERROR>busy</ERROR>" if rng.random() < 0.1 else "ok"

    spark.dataSource.register(service.graph_service(send, lambda what, sums: Path(told).write_text(json.dumps([what, sums]))))
    v = spark.range(330).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.lit("a")).alias("l")).repartition(5)
    v.write.format("graph_service").options(kind="vertices", batch=50, wait=0, tries=20).mode("append").save()
    assert len(os.listdir(folder)) == 330 and json.loads(Path(folder, "vertices~7").read_text()) == {"id": "7", "name": "n7", "l": ["a"]}
    what, sums = json.loads(Path(told).read_text())
    assert what == "commit" and sums["rows"] == 330 and 7 <= sums["requests"] <= 12
    spark.dataSource.register(service.graph_service(lambda kind, rows: "<ERROR>no</ERROR>", lambda what, sums: Path(told).write_text(json.dumps([what, sums]))))
    with pytest.raises(Exception, match="cannot be written"):
        v.write.format("graph_service").options(kind="vertices", wait=0, tries=2).mode("append").save()
    assert json.loads(Path(told).read_text())[0] == "abort"


def test_name_index_is_a_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [(str(i), "".join(rng.choices("abÉé日 -", k=rng.randrange(0, 12))) if i % 50 else None, "x", None) for i in range(400)] + [("long", "ab" * 20_000, "x", None)]
    v = spark.createDataFrame(rows, "id string, name string, entity_type string, umls_cui string")
    store.write(names.postings(v), str(tmp_path / "names"))
    plain = graph.Graph(v, v.limit(0), v.limit(0))
    indexed = graph.Graph(v, v.limit(0), v.limit(0), spark.read.parquet(str(tmp_path / "names")))
    for term in ("ab", "aba", "ÉÉÉ", "b日-", "é a", "no such", "ababab", "   ", "日"):
        assert sorted(r["src"] for r in graph.seeds(plain, term).collect()) == sorted(r["src"] for r in graph.seeds(indexed, term).collect())
    plan = graph.seeds(indexed, "aba")._jdf.queryExecution().toString()
    assert "In(id" in plan or "id#" in plan


def test_keys_reach_the_scan(spark):
    g = bindings.knowledge_graph(spark, "/root/testdata/sf0.001")
    for df in (graph.neighbors(g, "blue anvil", min_evidence=1), graph.shared_neighbors(g, "blue", "ring", min_evidence=1), graph.explain(g, "blue", "ring")):
        scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "evidence_sentences" in line]
        assert scans and all("PushedFilters: [" in s and ("In(src" in s or "EqualTo(src" in s) for s in scans)


def test_many_seeds_are_joined(spark, monkeypatch):
    g = bindings.knowledge_graph(spark, "/root/testdata/sf0.001")
    ask = lambda: [[str(r) for r in f.collect()] for f in (graph.neighbors(g, "b", min_evidence=1), graph.shared_neighbors(g, "blue", "ring", min_evidence=1), graph.explain(g, "blue", "ring"))]
    want = ask()
    monkeypatch.setattr(graph, "FEW", 1)
    assert ask() == want


def test_stored_graphs_have_a_name_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "MOST_DELTAS", 2)
    kg, out = str(tmp_path / "kg"), str(tmp_path / "graph")
    vertex = "id string, name string, entity_type string, umls_cui string"
    pair = "entity_a_id string, entity_b_id string, sent_count long, docs_count long, doc_ids_sample array<string>, evidence_sentences array<string>"
    for i in range(pipeline.MOST_DELTAS + 3):
        store.write(spark.createDataFrame([("a", f"name {i}", "gene", None), (f"v{i}", f"other {i}", "gene", None)], vertex), f"{kg}/entity")
        store.write(spark.createDataFrame([("a", f"v{i}", 5, 5, ["1"], ["s"])], pair), f"{kg}/cooccurrence")
        pipeline.merge_graph(spark, kg, out)
    g = pipeline.load_graph(spark, out)
    assert g.names is not None and g.vertices.count() == pipeline.MOST_DELTAS + 4 and g.edges.count() == 2 * (pipeline.MOST_DELTAS + 3)
    assert [r["src"] for r in graph.seeds(g, f"name {pipeline.MOST_DELTAS + 2}").collect()] == ["a"] and graph.seeds(g, "name 0").count() == 0


def test_questions_phrased_otherwise(spark):
    g = bindings.knowledge_graph(spark, "/root/testdata/sf0.001")
    a, b = (r["name"] for r in g.edges.orderBy(F.desc("docs_count"), "src", "dst").limit(1).join(g.vertices, (F.col("id") == F.col("src")) | (F.col("id") == F.col("dst"))).orderBy("name").collect())
    assert agent.recognised(g, f"Does {a.upper()} say anything of {b}?") == [a, b] and agent.recognised(g, "nothing known") == []
    config = AgentConfig(min_evidence=1)
    one = agent.ask(g, f"I wonder why {a} keeps meeting {b}, please", config=config)
    assert one["tool"] == "ExplainRelationship" and one["doc_ids"]
    two = agent.ask(g, f"{a}, who are its companions?", config=config)
    assert two["tool"] == "FindEntityNeighbors" and two["doc_ids"]
    assert agent.route_by_names(g, f"what do {a} and {b} share")[0] == "FindSharedNeighbors" and agent.route_by_names(g, "hm") is None
    assert agent.ask(g, "who knows?", config=config)["tool_output"] == agent.NOTHING


def test_log_of_the_command_line(tmp_path):
    import logging

    path = tmp_path / "run.log"
    for _ in range(2):
        log_to(str(path))
    logging.getLogger("evigraph.test").warning("once")
    assert path.read_text(encoding="utf-8").count("WARNING evigraph.test: once") == 1
    log = logging.getLogger("evigraph")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    assert parser().parse_args(["extend-kg", "--source", "a", "--out", "b", "--log", "c"]).log == "c"


def test_a_trigram_of_all_names_is_dealt_to_many_tasks(spark):
    named = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Customer#"), F.col("id").cast("string")).alias("name"))
    index = names.postings(named)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = [r["count"] for r in names.postings(named).withColumn("task", F.spark_partition_id()).where("gram = 'mer'").groupBy("task").count().collect()]
        per = [r["count"] for r in names.postings(named.select("id", F.lit("Mer").alias("name"))).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(held) == 20_000 and index.where("gram = 'mer'").count() == 20_000
    assert sum(per) == 20_000 and max(per) < 10_000
