"""Queries over whole tables: no language, frequency or id is left out."""

import re
from collections import Counter

from evigraph.plans import catalog

WORDS = "Glucose glucose in the liver. It rises! Insulin\nfalls"


def test_text_queries_read_all_documents(spark, tmp_path):
    rows = [(i, WORDS, ("en", "de", None)[i % 3]) for i in range(240)] + [(240, None, "en"), (241, "liver", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    want = sorted((str(i), m[0], m.start(), m.end()) for i, t, _ in rows for m in re.finditer("[A-Za-z]+", t or "") if len(m[0]) >= 4)
    assert sorted((r["doc_id"], r["text"], r["start_pos"], r["end_pos"]) for r in run("gazetteer_mentions")) == want
    split = sorted((str(i), n, s) for i, t, _ in rows for n, s in enumerate(re.findall("[^.!?\\n]+[.!?]*", t or "")))
    assert sorted((r["doc_id"], r["sentence_id"], r["sentence_text"]) for r in run("sentence_split")) == split
    assert {r["text"]: r["mentions"] for r in run("short_mention_filter")} == Counter(w for _, t, _ in rows for w in re.findall("[A-Za-z]+", t or "") if len(w) > 2)


def test_id_queries_read_all_documents(spark, tmp_path):
    ids = [*range(13), 499, 500, 501]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    url = "https://pubmed.ncbi.nlm.nih.gov/"
    got = {r["doc_id"]: r["linked"] for r in catalog.queries()["citation_links"](spark, str(tmp_path)).collect()}
    assert got == {i: f"see [{i}]({url}{i}) and [{i + 1}]({url}{i + 1})." for i in ids}
    want = {str(i): "old" for i in ids} | {str(2 * i): "new" for i in ids}
    rows = catalog.queries()["upsert_documents"](spark, str(tmp_path)).collect()
    assert {r["pmid"]: r["version"] for r in rows} == want and len(rows) == len(want)
