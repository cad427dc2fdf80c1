import random

import duckdb
import pandas as pd
from tokenizers import Tokenizer as Library

import corpus_pipeline
from evigraph.llm.catalog import VOCABULARY, queries
from evigraph.llm.mixing import oracle as mixing_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    words = "the quick brown fox jumps over lazy dogs while seven wizards watch from old stone towers".split()
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 30)) for i in range(1, 9)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)] + [(100, texts[0], "en", "s0"), (101, texts[0] + " end", "en", "s1"), (102, "123 456", "en", "s0"), (103, None, "en", None), (None, "words without any id at all", None, "s0"), (4, texts[4], "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        if name != "bpe":
            assert kept.columns == docs.columns
            kept.write.parquet(f"{tmp_path}/{name}")
            kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in kept.collect()]
        if name == "language_id":
            assert 102 not in ids and 103 not in ids and len(ids) == len(rows) - 2
        if name == "near_dedup":
            assert sorted(i for i in ids if i is not None) == list(range(8)) and None in ids
        if name == "mixing":
            assert set(ids) <= {None, *range(8)} and ids
    assert set(kept.columns) == {"doc_id", "n_tokens", "ids", "decoded"} and len(ids) == kept.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_registered():
    names = list(queries())
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 14
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mixing", "bpe"]


def jaccard_groups(rows, k, num, den):
    """Which of ``rows (id, text)`` stay if one of each group of linked texts does, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best.setdefault(find(i), []).append(((r[0] is None, r[0] or 0, text_hash(r[1])), r))
    return {(r[0], r[1]) for r in rows if not (r[1] or "").split()} | {(m[1][0], m[1][1]) for v in best.values() for m in [min(v, key=lambda x: x[0])]}


HASHES = {}


def text_hash(text):
    return HASHES[text]


def test_near_dedup_is_by_row(spark):
    """Against all pairs: repeated ids, rows without id, columns with names that an implementation may use."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(60)] = rng.choice(words)
            rows.append((rng.choice([None, *range(20)]), " ".join(w)))
    rows += [(3, rows[0][1]), (3, rows[8][1]), (3, rows[8][1]), (None, ""), (5, None), (5, "  "), (None, "few words")]
    docs = spark.createDataFrame([(d, t, f"keep {i}", i, i, "r", 1, 2) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _text string, _kept int, _row int, row string, row_id int, group_id int")
    HASHES.update((r["text"], r["h"]) for r in docs.selectExpr("text", "xxhash64(text) AS h").collect())
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all(r["_text"].startswith("keep ") and rows[int(r["_text"][5:])] == (r["doc_id"], r["text"]) for r in got)
    want = jaccard_groups(rows, 5, 80, 100)
    assert len(got) == len(want) and {(r["doc_id"], r["text"]) for r in got} == want


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"the words of text number {i} are here and there", "en", "s", 7, "a", "b", 1.0) for i in range(6)], "doc_id long, text string, lang string, source string, _row int, _text string, whole_row string, rate double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r["_row"], r["_text"], r["whole_row"], r["rate"]) for r in out.collect()} <= {(7, "a", "b", 1.0)}, name


def test_language_stage(spark):
    """One rule for texts of all lengths: short clean texts stay, whatever is in no learned language goes once it is long enough to tell."""
    folder = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(folder).select("doc_id", "text", "lang")
    strange = ["xkcd qwzx zzzq vvxk jjqx wqkz " * 10, "Это русский текст который не принадлежит ни к одному из изученных языков " * 3, "123 456 ..", None, ""]
    clean = ["of the", "und", "The. Thonour and the tionand thes", "de la"]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(strange)] + [(2 * 10**6 + i, t, None) for i, t in enumerate(clean)], "doc_id long, text string, lang string")
    ids = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert not ids & set(range(10**6, 10**6 + 5)) and set(range(2 * 10**6, 2 * 10**6 + 4)) <= ids
    letters = {r["doc_id"] for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert letters <= ids


def test_whole_run_by_brute_force(spark):
    """Every stage's kept rows on sf0.001, told again without Spark: trigram profiles, all pairs, rates by hand, the library."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "")
    rows = [tuple(r) for r in docs.collect()]
    first = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(str, first)) == sorted(str(tuple(r)) for r in kept.collect())
    HASHES.update((r["text"], r["h"]) for r in docs.selectExpr("text", "xxhash64(text) AS h").collect())
    want = jaccard_groups([(r[0], r[1]) for r in first], 5, 80, 100)
    kept = corpus_pipeline.near_dedup(spark, kept, "")
    second = [tuple(r) for r in kept.collect()]
    assert {(r[0], r[1]) for r in second} == want and len(second) == len(want)
    drawn = {r["doc_id"] for r in corpus_pipeline.mixing(spark, kept, "").collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(second, columns=docs.columns))
    assert drawn == {r[0] for r in con.sql(mixing_sql()).fetchall() if r[-1]}
    library = Library.from_file(VOCABULARY)
    end = {r["doc_id"]: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert set(end) == drawn
    for r in second:
        if r[0] in drawn:
            ids = library.encode(r[1], add_special_tokens=False).ids
            assert end[r[0]]["ids"] == " ".join(map(str, ids)) and end[r[0]]["decoded"] == library.decode(ids, skip_special_tokens=False)
