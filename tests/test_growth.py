"""Near-miss linking, term tries, tables by batches with runs that break off, searches that lose nothing."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evigraph.config import FilterConfig, LinkerConfig, NerConfig
from evigraph.operators import candidates, cooccurrence, ids, linking, mentions
from evigraph.operators.trie import TermTrie, plain
from evigraph.plans import agent, pipeline
from evigraph.sources import batches, literature, store
from evigraph.streaming import resume

ALIAS = "alias string, umls_cui string, confidence double, canonical_name string, first_alias string, umls_semantic_types array<string>"


# ---- candidates ------------------------------------------------------------------------------------------------------------------
def grams(name):
    padded = f"  {name} "
    return {padded[i : i + 3] for i in range(len(name) + 1)}


@pytest.mark.parametrize("least", [0.3, 0.7, 0.95, 1.0])
def test_candidates_are_those_of_all_pairs(spark, least):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé日", k=rng.randrange(0, 9))) + rng.choice(["", " inhibitor", "-1"])
    texts, aliases = [word() for _ in range(150)] + ["  ABC  ", "", None, "a" * 3000], [word() for _ in range(200)] + [None, "", "a" * 3001]
    rows = candidates.candidates(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(a,) for a in aliases], "alias string"), least, k=4)
    found = sorted((r["text"], r["rank"], r["alias"], round(r["similarity"], 9)) for r in rows.collect())
    known, want = {a.strip().lower() for a in aliases if a} - {""}, []
    for t in {t for t in texts if t and t.strip()}:
        x = grams(t.strip().lower())
        like = sorted((-len(x & grams(a)) / math.sqrt(len(x) * len(grams(a))), a) for a in known)
        want += [(t, i, a, round(-s, 9)) for i, (s, a) in enumerate([y for y in like if -y[0] >= least][:4], 1)]
    assert found == sorted(want)


def test_near_names_get_their_concept(spark):
    aliases = spark.createDataFrame([("metformin hydrochloride", "C1", 0.9, "Metformin", "m", ["T1"]), ("Metformin", "C2", 0.5, None, "M", None), ("insulin", "C3", 0.8, "Insulin", "i", None), ("insulin", "C4", 0.3, "x", "i", None)], ALIAS)
    texts = spark.createDataFrame([("Metformine",), ("metformin",), ("insuline",), ("nothing at all",), ("insulin",)], "text string")
    exact = {r["text"]: (r["umls_cui"], r["linking_confidence"]) for r in linking.link(texts, aliases).collect()}
    assert exact == {"Metformine": (None, None), "metformin": (None, None), "insuline": (None, None), "nothing at all": (None, None), "insulin": ("C3", 0.8)} or exact["metformin"] == (None, 0.5)
    near = {r["text"]: r for r in linking.link(texts, aliases, LinkerConfig(least_similarity=0.7)).collect()}
    assert near["insulin"]["linking_confidence"] == 0.8 and near["insuline"]["umls_cui"] == "C3" and near["insuline"]["umls_preferred_name"] == "Insulin"
    assert 0.7 <= near["insuline"]["linking_confidence"] < 1 and near["Metformine"]["umls_cui"] == "C2" and near["nothing at all"]["linking_confidence"] is None
    assert agent.linker(aliases)("insuline") == ["C3"] and len(near) == 5
    assert linking.link(texts, aliases.limit(0), LinkerConfig(least_similarity=0.7)).where("umls_cui IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        LinkerConfig(least_similarity=0.0)


def test_candidates_take_nothing_to_the_driver(spark):
    """no side of a join is sent to all tasks, however small it is."""
    names = [(f"name {i}",) for i in range(20)]
    rows = candidates.candidates(spark.createDataFrame(names, "text string"), spark.createDataFrame(names, "alias string"), k=1)
    assert sorted((r["text"], r["alias"]) for r in rows.collect()) == sorted(n * 2 for n in names)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_candidates_come_without_a_product(spark):
    one = spark.createDataFrame([("a",)], "text string")
    plan = candidates.candidates(one, one.withColumnRenamed("text", "alias"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- trie ------------------------------------------------------------------------------------------------------------------------
def plain_matches(terms, sentence):
    words = [m.span() for m in re.finditer(r"[^\W_]+", sentence)]
    hits = set()
    for i in range(len(words)):
        for j in range(i, len(words)):
            a, b = words[i][0], words[j][1]
            hits |= {(a, b, model, label) for term, model, label in terms if re.findall(r"[^\W_]+", plain(term)) and plain(term) == plain(sentence[a:b])}
    inner = lambda h: any(o[2] == h[2] and o[0] <= h[0] and o[1] >= h[1] and o[:2] != h[:2] for o in hits)
    return sorted(h for h in hits if not inner(h))


def test_trie_finds_what_all_runs_of_words_do():
    rng = random.Random(4)
    for _ in range(300):
        run = lambda k: "".join(rng.choice(["a", "B", "c1", "é"]) + rng.choice([" ", "  ", "-", " "]) for _ in range(k)).strip(" -")
        terms = [(run(rng.randrange(1, 5)), rng.choice("xy"), rng.choice("pq")) for _ in range(rng.randrange(1, 9))] + [("--", "x", "p"), ("", "x", "p")]
        sentence = run(rng.randrange(0, 14))
        assert sorted(TermTrie(terms).matches(sentence)) == plain_matches(terms, sentence)


def test_trie_and_join_agree(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(str(i), " ".join(rng.choices(["a", "B", "c", "d.", "e-f", "\n"], k=40))) for i in range(30)] + [("n", None), ("e", "")], "doc_id string, text string")
    terms = spark.createDataFrame([("a", "x", "GGP"), ("a b", "x", "GGP"), ("a b", "x", "CL"), ("b c a", "y", "GO"), ("e-f", "x", "SO"), ("c", "y", "CL"), ("c", "x", "CL")], "term string, source_model string, source_label string")
    one = sorted(map(str, mentions.annotate(docs, terms).collect()))
    monkeypatch.setattr(mentions, "BROADCAST_TERMS", 0)
    assert one == sorted(map(str, mentions.annotate(docs, terms).collect())) and one


def test_a_dictionary_of_many_words_moves_no_text(spark):
    docs = spark.createDataFrame([("1", "w7 and W149999 x"), ("2", "none")], "doc_id string, text string")
    terms = spark.range(150_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"), F.lit("x").alias("source_model"), F.lit("GGP").alias("source_label"))
    found = mentions.annotate(docs, terms)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["doc_id"], r["text"], r["start_pos"], r["end_pos"]) for r in found.orderBy("start_pos").collect()] == [("1", "w7", 0, 2), ("1", "W149999", 7, 14)]


def test_duplicates_are_told_without_a_shuffle(spark):
    """mentions stay in their task beside their sentences; only an id of several rows takes a shuffle."""
    rng = random.Random(7)
    words = ["a", "A", "b c", "B C", "d.", "\n", "İx", "ix", "é", "É", "-"]
    docs = [(str(i), " ".join(rng.choices(words, k=60))) for i in range(30)] + [("n", None), ("e", ""), (None, "a A b c")]
    terms = spark.createDataFrame([(t, m, "GGP") for t in ("a", "b c", "c", "ix", "İx", "é") for m in ("x", "bionlp")] + [("b", "craft", "SO"), ("b c", "craft", "SO")], "term string, source_model string, source_label string")
    priorities = {"craft": 2, "bionlp": 1}
    for rows in (docs, docs + [(str(i), "A a B c") for i in range(9)] + [(None, "a a")]):
        given = spark.createDataFrame(rows, "doc_id string, text string")
        found = mentions.found(given, terms, priorities)
        want = mentions.deduplicate(mentions.annotate(given, terms), priorities)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == (rows is not docs)


def test_only_close_mentions_are_compared(spark, monkeypatch):
    """F4, F7, F8: mentions alone in their five characters are no duplicates, and what is kept has one row for each text."""
    docs = spark.createDataFrame([("1", "blue ring blue. Ring ring blue"), ("2", "no no blue blue"), ("3", "none")], "doc_id string, text string")
    terms = spark.createDataFrame([(t, m, "GGP") for t, m in (("blue", "craft"), ("ring", "bionlp"), ("no", "craft"))], "term string, source_model string, source_label string")
    seen, held = [], []
    monkeypatch.setattr(mentions, "_first_of_each", lambda hits, priorities, first=mentions._first_of_each: seen.append(str(hits)) or first(hits, priorities))
    found = mentions.found(docs, terms, {"craft": 2}, keep=lambda rows: held.append(rows) or rows)
    assert [(r["doc_id"], r["start_pos"]) for r in found.orderBy("doc_id", "mention_seq").collect()] == [("1", 0), ("1", 5), ("1", 10), ("1", 16), ("1", 21), ("1", 26), ("2", 0), ("2", 6), ("2", 11)]
    assert len(seen) == 1 and "close" in seen[0] and held[0].count() == 2
    trie = TermTrie([("blue", "x", "q"), ("blue", "x", "p")])
    assert trie.words == {"blue": (("x", "p"), ("x", "q"))} and trie.matches("Blue, red") == [(0, 4, "x", "p"), (0, 4, "x", "q")]


def test_few_links_leave_mentions_where_they_are(spark, monkeypatch):
    found = spark.createDataFrame([("d", "a b", "gene"), ("d", "x", "gene"), ("e", "a b", "gene")], "doc_id string, text string, entity_type string")
    links = spark.createDataFrame([("a b", "C1", 0.9, "A", None), ("x", None, None, None, None)], "text string, umls_cui string, linking_confidence double, umls_preferred_name string, umls_semantic_types array<string>")
    plain_rows = sorted(map(str, linking.apply_links(found, links).collect()))
    few = linking.apply_links(found, linking.telling(links))
    assert "hint" in few._jdf.queryExecution().analyzed().toString().lower() and sorted(map(str, few.collect())) == plain_rows
    monkeypatch.setattr(linking, "BROADCAST_LINKS", 0)
    many = linking.apply_links(found, linking.telling(links))
    assert "hint" not in many._jdf.queryExecution().analyzed().toString().lower() and sorted(map(str, many.collect())) == plain_rows


def test_trie_costs_the_same_for_long_terms():
    import time

    words = [f"w{i % 50}" for i in range(100_000)]
    took = []
    for n in (1, 400):
        trie = TermTrie([(" ".join(f"w{(i + j) % 50}" for j in range(n)), "x", "p") for i in range(0, 50, 7)] + [("w1 " * 500, "x", "p")])
        sentence = " ".join(w if i % 97 else "zz" for i, w in enumerate(words))
        began = time.perf_counter()
        trie.matches(sentence)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 1


# ---- tables by batches -----------------------------------------------------------------------------------------------------------
DOCS = "id string, title string, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"source": F.lit("s"), "pub_year": F.lit(1), "extras": F.create_map().cast("map<string,string>")})


TEXTS = ["Glucose and insulin. Insulin with aspirin and glucose.", "Aspirin, insulin.", "Glucose. Glucose and aspirin!", "nothing", "Insulin, glucose, aspirin. Aspirin glucose.", "Glucose insulin", "insulin aspirin"]
PARTS = [[(str(i), "t", TEXTS[i % len(TEXTS)]) for i in range(k, 21, 3)] for k in range(3)]


@pytest.fixture(scope="module")
def tables(spark):
    terms = spark.createDataFrame([("glucose", "bc5cdr", "CHEMICAL"), ("insulin", "bionlp", "GGP"), ("aspirin", "bc5cdr", "CHEMICAL")], "term string, source_model string, source_label string")
    return terms, spark.createDataFrame([("glucose", "C1", 0.9, "Glucose", "g", ["T1"]), ("aspirine", "C2", 0.9, "Aspirin", "a", None)], ALIAS)


def all_rows(spark, out):
    return {t: sorted(map(str, spark.read.parquet(f"{out}/{t}").drop("batch", "processed_at").collect())) for t in ("nlp/entities", "nlp/documents", "kg/entity", "kg/mention", "kg/cooccurrence")}


@pytest.fixture(scope="module")
def at_once(spark, tables, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("once"))
    pipeline.annotate_and_link(spark, docs_of(spark, sum(PARTS, [])), *tables, f"{out}/nlp")
    pipeline.build_kg(spark, f"{out}/nlp", f"{out}/kg")
    return all_rows(spark, out)


def test_three_batches_are_one(spark, tables, at_once, tmp_path, monkeypatch):
    out, seen = str(tmp_path), []
    read = batches.read
    monkeypatch.setattr(batches, "read", lambda s, path, only=None: seen.append((path, only)) or read(s, path, only))
    for i, part in enumerate(PARTS):
        seen.clear()
        pipeline.annotate_and_link(spark, docs_of(spark, part + PARTS[0] * (i > 0)), *tables, f"{out}/nlp")
        done = pipeline.extend_kg(spark, f"{out}/nlp", f"{out}/kg")
        assert done["batches"] == [batches.numbered(i)]
        assert all(only == [batches.numbered(i)] for path, only in seen if path.endswith("/mention"))  # earlier mentions stay unread
    assert all_rows(spark, out) == at_once
    assert batches.ids(spark, f"{out}/nlp/entities") == [batches.numbered(i) for i in range(3)]
    assert spark.read.parquet(f"{out}/nlp/links").groupBy("text").count().where("count > 1").count() == 0
    assert pipeline.extend_kg(spark, f"{out}/nlp", f"{out}/kg")["batches"] == []
    linked = {r["umls_cui"] for r in spark.read.parquet(f"{out}/nlp/entities").where("text = 'aspirin' OR text = 'Aspirin'").collect()}
    assert linked == {"C2"}  # by a name of one letter more


@pytest.mark.parametrize("step, after", [(0, False), (1, True), (2, False), (2, True), (3, True), (4, False), (5, True)])
def test_runs_that_break_off(spark, tables, at_once, tmp_path, monkeypatch, step, after):
    """Each write of the second batch fails in turn, before or after it is done; the next run makes good."""
    out, write, calls = str(tmp_path), batches.write, []

    def broken(df, path, batch):
        calls.append(path)
        if len(calls) == step + 1:
            if after:
                write(df, path, batch)
            else:
                df.limit(1).write.parquet(f"{path}/_aside/{batch}")
            raise OSError("lost")
        return write(df, path, batch)

    def both(part):
        pipeline.annotate_and_link(spark, docs_of(spark, part), *tables, f"{out}/nlp")
        pipeline.extend_kg(spark, f"{out}/nlp", f"{out}/kg")

    both(PARTS[0])
    monkeypatch.setattr(batches, "write", broken)
    with pytest.raises(OSError):
        both(PARTS[1])
    monkeypatch.setattr(batches, "write", write)
    both(PARTS[1])
    both(PARTS[2])
    assert all_rows(spark, out) == at_once


def test_merge_on_read_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        assert batches.write(spark.createDataFrame([("a", i), (f"k{i}", i)], "id string, v int"), path, batches.numbered(i))
        assert not batches.write(spark.createDataFrame([("a", 99)], "id string, v int"), path, batches.numbered(i))
    want = {("a", 3), ("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3)}
    assert {tuple(r) for r in batches.latest(spark, path, "id").collect()} == want and batches.read(spark, path).count() == 8
    batches.compact(spark, path, "id")
    assert {tuple(r) for r in batches.latest(spark, path, "id").collect()} == want == {tuple(r) for r in batches.read(spark, path).collect()}
    assert batches.ids(spark, path) == [batches.numbered(3)] and batches.next_id(spark, path) == batches.numbered(4) and store.complete(spark, path)
    assert batches.ids(spark, str(tmp_path / "none")) == []


def test_partial_states_merge_to_the_whole(spark):
    rng = random.Random(8)
    rows = [(f"d{rng.randrange(40)}", rng.randrange(6), rng.choice("abcde")) for _ in range(600)]
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string").withColumn("sentence_text", F.concat_ws("/", "doc_id", "sentence_id"))
    parts = [cooccurrence.partial(found.where(F.crc32("doc_id") % 3 == i)) for i in range(3)]
    merged = cooccurrence.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(str, merged.collect())) == sorted(map(str, cooccurrence.cooccurrences(found).collect()))


@pytest.mark.parametrize("block", [2, 3, 7, 100])
def test_pairs_by_blocks_are_all_pairs(spark, block):
    rows = [(f"d{n}", 0, f"e{i:03d}") for n in (1, 2, 3, 5, 7, 8, 20) for i in range(n)] * 2
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string")
    got = sorted((r["doc_id"], r["entity_a_id"], r["entity_b_id"]) for r in cooccurrence.contexts(found, block).collect())
    assert got == sorted((f"d{n}", f"e{i:03d}", f"e{j:03d}") for n in (1, 2, 3, 5, 7, 8, 20) for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("least", [1, 4, 5, 9, 18])
def test_frequent_pairs_are_those_of_all_pairs(spark, least, monkeypatch):
    """pairs of many documents are found without a row for each pair."""
    rng = random.Random(least)
    rows = [(f"d{d}", s, f"e{e}") for d in range(30) for s in range(rng.randrange(1, 3)) for e in range(25) if rng.random() < 0.9 - e / 30] * 2
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string")
    want = sorted(map(str, cooccurrence.counts(cooccurrence.contexts(found)).where(F.col("docs_count") >= least).collect()))
    monkeypatch.setattr(cooccurrence, "TASK_PAIRS", 500)
    got = cooccurrence.frequent(found, least).select("entity_a_id", "entity_b_id", "sent_count", "docs_count")
    assert sorted(map(str, got.collect())) == want and want
    kept = []
    cooccurrence.frequent(found, least, keep=lambda df: kept.append(store.cut(df)) or kept[-1]).collect()
    assert least < 4 or kept[-1].count() < 25 * 24 // 2 * (1 if least < 9 else 0.8)


def test_copies_of_sentences_are_dealt_by_rounds(spark, monkeypatch):
    """of the copies that sentences have in many tasks only those of one round are on disk at once."""
    rng = random.Random(3)
    rows = [(f"d{d}", 0, f"e{e}") for d in range(30) for e in range(40) if rng.random() < 0.9 - e / 80]
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string")
    want = sorted(map(str, cooccurrence.counts(cooccurrence.contexts(found)).where("docs_count >= 8").collect()))
    monkeypatch.setattr(cooccurrence, "TASK_PAIRS", 300)
    monkeypatch.setattr(cooccurrence, "ROUND_BYTES", 1)
    kept, freed = [], []
    monkeypatch.setattr(cooccurrence, "_released", lambda spark, real=cooccurrence._released: freed.append(len(kept)) or real(spark))
    got = cooccurrence.frequent(found, 8, keep=lambda df: kept.append(store.cut(df)) or kept[-1]).select("entity_a_id", "entity_b_id", "sent_count", "docs_count")
    assert sorted(map(str, got.collect())) == want and want
    rounds = [t for t in kept if t.columns == ["c", "d", "n"]]
    assert len(rounds) > 2 and len(freed) == len(rounds) + 4 and sum(t.count() for t in rounds) == len({(r["c"], r["d"]) for t in rounds for r in t.collect()})


@pytest.mark.parametrize("listed", [0, 20, 256])
def test_pairs_are_left_by_their_lists(spark, monkeypatch, listed):
    """pairs with too few documents in common take no row for each document; entities of many rows, and documents of equal hashes, have no list."""
    place = spark.createDataFrame([(f"d{d}", s, e) for e, n, m in (("a", 12, 1), ("b", 9, 2), ("c", 30, 1)) for d in range(n) for s in range(m)] + [(None, 0, "a")], "doc_id string, sentence_id int, entity_id string")
    found = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], cooccurrence.KEYS)
    monkeypatch.setattr(cooccurrence, "LISTED", listed)
    left = sorted(tuple(r) for r in cooccurrence._may_share(found, cooccurrence._lists(place), 10).collect())
    assert left == {0: [("a", "b"), ("a", "c"), ("b", "c")], 20: [("a", "c"), ("b", "c")], 256: [("a", "c")]}[listed]


def test_entities_of_one_code_are_told_apart(spark, monkeypatch):
    rows = [(f"d{d}", 0, e) for d in range(6) for e in "abc"[: 2 + (d > 1)]]
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string")
    monkeypatch.setattr(cooccurrence.F, "hash", lambda c: F.lit(7))
    assert sorted(tuple(r) for r in cooccurrence.frequent(found, 5).select("entity_a_id", "entity_b_id", "docs_count").collect()) == [("a", "b", 6)]


def test_a_large_sentence_is_dealt_to_many_tasks(spark):
    found = spark.range(6000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("sentence_id"), F.col("id").cast("string").alias("entity_id"))
    spread = cooccurrence.contexts(found).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in spread) == 6000 * 5999 // 2 and max(r["count"] for r in spread) < 6000 * 5999 // 4


def test_streams_that_are_run_again(spark, tmp_path, monkeypatch):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema, write = "id string, text string", batches.write
    put = lambda *rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
    run = lambda where=mark: resume.process_new(spark, folder, schema, out, where, lambda d: d)
    put(("1", "a"), ("2", "b"))
    assert run() == 2
    put(("2", "b"), ("3", "c"))

    def lost(df, path, batch):
        write(df, path, batch)
        raise OSError("lost after the write")

    monkeypatch.setattr(batches, "write", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(batches, "write", write)
    assert run() == 3 == run()
    assert run(str(tmp_path / "another mark")) == 3  # a new checkpoint reads all files again
    put(("4", "d"), ("1", "a"))
    assert run() == 4


def test_pairs_read_their_mentions_once(spark, tmp_path):
    rng = random.Random(12)
    rows = [(f"d{rng.randrange(9)}", s := rng.randrange(4), f"e{rng.randrange(6)}", f"text {s}", k) for k in range(300)]
    spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string, sentence_text string, mention_seq long").write.parquet(str(tmp_path / "found"))
    found, kept = spark.read.parquet(str(tmp_path / "found")), []
    for make in (cooccurrence.cooccurrences, cooccurrence.partial, cooccurrence.evidence):
        rows = make(found, keep=lambda df: kept.append(df) or store.cut(df))
        assert len(kept) == 1 and not [f for f in rows.inputFiles() if f"{tmp_path}/found" in f]
        assert sorted(map(str, rows.collect())) == sorted(map(str, make(found).collect()))
        kept.clear()


def test_filters_of_counts_take_no_texts(spark):
    from evigraph.plans import catalog

    for name in ("filter_thresholds", "filter_stopwords"):
        assert "sentence_text" not in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


# ---- searches --------------------------------------------------------------------------------------------------------------------
def test_windows_stay_within_the_cap():
    rng = random.Random(9)
    per_day = {f"{y}-{m:02d}-{d:02d}": rng.choice([0, 1, 3, 40, 700]) for y in (2019, 2020) for m in range(1, 13) for d in range(1, 29, rng.choice([1, 5]))}
    for cap in (1, 7, 100, 10_000):
        found = ids.windows(lambda a, b: sum(n for d, n in per_day.items() if a <= d <= b), 1 << 60, 2021, cap)
        assert all(0 < w.count <= cap for w in found) and sum(w.count for w in found) == sum(per_day.values())
        assert len({(w.start, w.offset) for w in found}) == len(found)


@pytest.mark.parametrize("cap", [1, 10, 100, 9999])
def test_searches_lose_nothing(spark, tmp_path, cap):
    path = str(tmp_path / "store")
    day = lambda i: None if i % 10 == 0 else "2024-01-05" if i % 3 == 0 else "1890-01-01" if i == 7 else "2099-05-05" if i == 8 else "2024" if i == 11 else f"2023-{i % 12 + 1:02d}-{i % 28 + 1:02d}"
    rows = [(str(i), day(i), f"<x>insulin {i}</x>") for i in range(300)]
    spark.createDataFrame(rows + [("1", "2001-01-01", "<x>insulin again</x>"), ("10", "2022-02-02", "<x>insulin dated</x>")], "pmid string, day string, xml string").write.parquet(path)
    assert literature.total(spark, path, "insulin") == 300
    everything = [r["pmid"] for r in literature.search(spark, path, "insulin", 1 << 60, cap=cap, year=2025).collect()]
    assert sorted(everything) == sorted(str(i) for i in range(300)) and everything[0] == "8"
    assert [r["pmid"] for r in literature.search(spark, path, "insulin", 299, cap=cap, year=2100).collect()] == everything[:299]
    assert [r["pmid"] for r in literature.search(spark, path, "insulin", 40, cap=cap, year=2100, start=20).collect()] == everything[20:60]


def test_a_search_for_the_newest_takes_the_last_weeks_of_a_month(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"{d:02d}{i}", f"2023-12-{d:02d}", "<x>insulin</x>") for d in range(1, 32) for i in range(3)] + [("later", "2099-01-01", "<x>insulin</x>")]
    spark.createDataFrame(rows, "pmid string, day string, xml string").write.parquet(path)
    want = ["later"] + [f"{d:02d}{i}" for d in range(31, 0, -1) for i in range(3)]
    for cap in (2, 10):
        assert [r["pmid"] for r in literature.search(spark, path, "insulin", 7, cap=cap, year=2025).collect()] == want[:7]
        assert [r["pmid"] for r in literature.search(spark, path, "insulin", 7, cap=cap, year=2025, start=5).collect()] == want[5:12]


def test_default_settings_link_near_names():
    assert NerConfig().linker.least_similarity == 0.7 and LinkerConfig().least_similarity is None


def test_pairs_made_in_their_tasks_are_all_pairs(spark, tmp_path, monkeypatch):
    """counts and evidence without a shuffled row for each pair, in both directions."""
    rng = random.Random(21)
    rows = [(f"d{rng.randrange(30)}", rng.randrange(5), rng.choice(["a", "b", "ç", "d" * 40, "e", "日", "C1", "CUSTOM:x"])) for _ in range(500)] + [("d1", 9, "lonely"), ("big", 0, "a"), *[("big", 0, f"n{i}") for i in range(70)]]
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, entity_id string").withColumn("sentence_text", F.when(F.col("sentence_id") < 4, F.concat_ws("/", "doc_id", "sentence_id"))).withColumn("mention_seq", F.col("sentence_id") * 10 - F.length("entity_id"))
    want = {(r["entity_a_id"], r["entity_b_id"]): r for r in cooccurrence.cooccurrences(found).collect()}
    for name, n in (("DEALT_PAIRS", 300), ("HELD_PAIRS", 40), ("BATCH_CHARS", 50), ("BATCH_ROWS", 7)):
        sentences = store.cut(cooccurrence.sentences(found))
        got = cooccurrence.gathered(sentences)
        assert sorted(map(str, got.select(*want["a", "b"].asDict()).collect())) == sorted(map(str, want.values()))
        assert "Window" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") == 1
        both = cooccurrence.directed(sentences, 3, 5).withColumn("task", F.spark_partition_id()).collect()
        kept = {k for k, r in want.items() if r["docs_count"] >= 3 and r["sent_count"] >= 5}
        assert sorted((r["src"], r["dst"]) for r in both) == sorted(kept | {(b, a) for a, b in kept}) and len(kept) < len(want)
        for r in both:
            w = want[min(r["src"], r["dst"]), max(r["src"], r["dst"])]
            assert (r["docs_count"], r["sent_count"], r["sample_doc_ids"], r["evidence_sentences"]) == (w["docs_count"], w["sent_count"], w["doc_ids_sample"], w["evidence_sentences"])
        assert len({(r["src"], r["task"]) for r in both}) == len({r["src"] for r in both})
        monkeypatch.setattr(cooccurrence, name, n)
    empty = cooccurrence.sentences(found.where("false"))
    assert cooccurrence.gathered(empty).count() == cooccurrence.directed(empty).count() == 0


def test_edges_from_sentences_are_those_from_pairs(spark, tmp_path, monkeypatch):
    """a run's graph is that of its pair table."""
    rng = random.Random(22)
    rows = [(f"d{rng.randrange(30)}", rng.randrange(5), rng.choice(["cell", "a1", "b2", "c3", "d4"])) for _ in range(300)]
    found = spark.createDataFrame(rows, "doc_id string, sentence_id int, text string").selectExpr("doc_id", "text", "sentence_id", "concat(doc_id, '/', sentence_id) AS sentence_text", "0 AS start_pos", "1 AS end_pos", "'x' AS source_label", "cast(sentence_id AS long) AS mention_seq", "'gene' AS entity_type", *[f"cast(null AS string) AS {c}" for c in ("umls_cui", "umls_preferred_name", "chebi_id", "go_id", "mesh_id")]).where("length(text) > 1")
    found = found.withColumn("text", F.concat("text", F.lit(" long")))
    store.write(found, f"{tmp_path}/nlp/entities")
    pipeline.build_kg(spark, f"{tmp_path}/nlp", f"{tmp_path}/kg")
    for config in (FilterConfig(3, 4), FilterConfig(2, 2, stopwords=frozenset(["a1 long"])), FilterConfig(2, 2, True, (("gene", "disease"),))):
        told = [pipeline.build_graph(spark, f"{tmp_path}/kg", f"{tmp_path}/{k}", config, sentences) for k, sentences in (("plain", None), ("made", f"{tmp_path}/kg/sentence"))]
        plain, made = (pipeline.load_graph(spark, f"{tmp_path}/{k}").edges.collect() for k in ("plain", "made"))
        assert told[0] == told[1] and sorted(map(str, plain)) == sorted(map(str, made))
    pipeline.build_graph(spark, f"{tmp_path}/kg", f"{tmp_path}/made", FilterConfig(3, 4), f"{tmp_path}/kg/sentence")
    assert pipeline.load_graph(spark, f"{tmp_path}/made").edges.count()


def test_more_terms_than_a_trie_takes(spark, monkeypatch):
    """terms by their hashes give the mentions of the trie, without a row for each run of words."""
    rng = random.Random(6)
    words = ["ab", "Cd", "é", "日本", "x1", "TNF-α", "q"]
    sentence = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "-", "\t", ". ", "\n", "_"]) for _ in range(rng.randrange(0, 30)))
    docs = spark.createDataFrame([(i, sentence() if i % 9 else None) for i in range(120)], "doc_id int, text string")
    names = {" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(60)} | {"", " - ", "(ab)", "ab-cd", "AB  cd"}
    rows = [(t, rng.choice(["bionlp", "craft", "bc5cdr"]), rng.choice(["GGP", "CHEBI"])) for t in sorted(names) for _ in range(2)] + [(None, "craft", "GGP")]
    terms = spark.createDataFrame(rows, "term string, source_model string, source_label string")
    take = lambda: sorted(map(str, mentions.annotate(docs, terms).collect()))
    want = take()
    monkeypatch.setattr(mentions, "BROADCAST_TERMS", 5)
    plan = mentions.annotate(docs, terms)._jdf.queryExecution().executedPlan().toString()
    assert take() == want and len(want) > 500 and "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr("evigraph.operators.trie.WORDS_AT_ONCE", 3)
    assert take() == want
    monkeypatch.setattr(mentions, "HASHED_TERMS", 5)
    assert "Join" in mentions.annotate(docs, terms)._jdf.queryExecution().executedPlan().toString() and take() == want


@pytest.mark.parametrize(("least", "shared", "longest"), [(0.7, 3, 40), (0.7, 2, 7), (0.5, 3, 9), (0.9, 2, 5)])
def test_names_meet_by_several_trigrams(spark, monkeypatch, least, shared, longest):
    """names that are not alike seldom meet, and none that are alike are lost, whatever their lengths."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcd", k=rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 12, 20])))
    texts, aliases = {word() for _ in range(150)}, {word() for _ in range(150)}
    monkeypatch.setattr(candidates, "SHARED", shared)
    monkeypatch.setattr(candidates, "LONG", longest)
    frame = lambda names, c: spark.createDataFrame([(n,) for n in sorted(names)], f"{c} string")
    found = candidates.candidates(frame(texts, "text"), frame(aliases, "alias"), least, k=1000).collect()
    like = {(t, a): len(grams(t) & grams(a)) / math.sqrt(len(grams(t)) * len(grams(a))) for t in texts for a in aliases}
    assert sorted((r["text"], r["alias"], round(r["similarity"], 9)) for r in found) == sorted((t, a, round(s, 9)) for (t, a), s in like.items() if s >= least - 1e-12)
    rarity = spark.createDataFrame([], "gram string, df long")
    sets = [candidates._sets(frame(n, "name"), rarity) for n in (texts, aliases)]
    meet = lambda k: candidates._prefixes(sets[0], least, k).select("key", "name").join(candidates._prefixes(sets[1], least, k).select("key", F.col("name").alias("other")), "key").select("name", "other").distinct().count()
    assert least != 0.7 or meet(3) < meet(1) / 2
