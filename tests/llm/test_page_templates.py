"""Templates of pages: against explicit occurrence vectors, on pages without telling names, and on repeated rows."""

import re

import pytest

from evigraph.llm import html_text
from evigraph.llm.html_text import PAGE, TEXT, deduced, extract, main_text, parse, settle, template, tokens_of

SF = "/root/testdata/sf0.01/pages.parquet"
ROW = "page_id long, url string, html string"


def host_of(url):
    return re.match(r"[a-z]+://([^/:]*)", url or "x://")[1]


def neutral(page, host):
    """The page without names that tell what an element is for, with a long part and a line in the main text that all pages of the host have."""
    page = re.sub(r"</article>", f"<p>Read on at {host} every day</p></article>", page)
    page = re.sub(r"<article>", f"<div>{''.join(f'<p>{host} part {k}: what readers of this host should know about it. </p>' for k in range(60))}</div><article>", page)
    page = re.sub(r"<(/?)(nav|article|footer|aside|section|main|header)\b", r"<\1div", page)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", page)


def brute(pages):
    """The template of one host's ``(id, url, html)`` from occurrence vectors that are written out page by page."""
    pages = sorted(set(pages), key=str)
    vectors, facts = {}, {}
    for i, (_, _, page) in enumerate(pages):
        root = parse(page or "")
        settle(root)
        for (token, kind), (up, depth, times, chars, link) in tokens_of(root).items():
            vectors.setdefault((token, kind), [0] * len(pages))[i] = times
            f = facts.setdefault((token, kind), [up, depth, 0, 0])
            f[0] = min(f[0], up)
            f[2] += chars
            f[3] += link
    if len(pages) < 4:
        return None
    rows = []
    for (token, kind), v in vectors.items():
        n = sum(x > 0 for x in v)
        if kind != PAGE and max(v) == 1 and n >= 4 and n >= 0.1 * len(pages):
            f = facts[token, kind]
            rows.append((token, kind, f[0], f[1], n, tuple(v), 0, f[2], f[3]))
    return template(rows, len(pages))


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(SF).select("page_id", "url", "html").collect()]


def test_against_vectors_written_out(spark, table):
    keyed = spark.createDataFrame([(host_of(u), f"{i} {u}", h) for i, u, h in table], "host string, key string, html string")
    got = {r["host"]: (r["spot"], sorted(r["texts"]), sorted(r["forms"])) for r in deduced(keyed).collect()}
    by = {}
    for row in table:
        by.setdefault(host_of(row[1]), []).append(row)
    want = {h: t for h, rows in by.items() if (t := brute(rows))}
    assert {h: tuple(map(lambda x: x if isinstance(x, int) else sorted(x), t)) for h, t in want.items()} == got and len(got) > 15


def test_template_decides_on_pages_without_names(spark, table):
    """With all telling names taken away, the deduced template still finds the text that names tell; without it, other parts stay."""
    count = {}
    for _, u, _ in table:
        count[host_of(u)] = count.get(host_of(u), 0) + 1
    plain = [(i, u, neutral(h, host_of(u))) for i, u, h in table if count[host_of(u)] >= 4]
    want = {i: extract(h) for i, u, h in table}
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(plain, ROW)).collect()}
    assert len(plain) > 100 and sum(got[i] == want[i] for i, _, _ in plain) >= 0.97 * len(plain)
    assert sum(extract(h) != got[i] for i, _, h in plain) >= 0.97 * len(plain)


def test_repeated_rows_change_nothing(spark, table):
    once = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(table, ROW)).collect()}
    twice = main_text(spark.createDataFrame(table + table, ROW)).collect()
    assert len(twice) == 2 * len(table) and all(once[r["page_id"]] == r["text"] for r in twice)
    page = [(None, None, f"<body><div>top line</div><div><p>words {i} of <b>all</b></p><p>end</p></div></body>") for i in range(4)]
    a = sorted(r["text"] for r in main_text(spark.createDataFrame(page, ROW)).collect())
    b = sorted(r["text"] for r in main_text(spark.createDataFrame(page * 2, ROW)).collect())
    assert sorted(a * 2) == b


def test_parts_of_an_article():
    page = "<body><article><header><h1>Head</h1><p>by me</p></header><p class='notice'>one</p><div class='tag'>two</div><figure><figcaption>three</figcaption></figure><div class='cookie-notice'>x</div></article><article><p>four</p></article><footer>f</footer></body>"
    assert extract(page) == "Head\n\none\n\ntwo\n\nthree\n\nfour"


def test_near_copies_keep_their_text(spark):
    """A tenth of the host's pages are near copies of one long article: what they share is theirs, not a form's template."""
    shared = "".join(f"<p>Sentence number {k} that all these copies share.</p>" for k in range(12))
    rows = [(i, f"http://copy.example/{i}", f"<body><div>menu</div><article><h1>T{i}</h1>{shared if i % 4 == 0 else f'<p>Own words of page {i}.</p>'}</article></body>") for i in range(32)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, ROW)).collect()}
    assert all(got[i].count("Sentence number") == (12 if i % 4 == 0 else 0) for i in range(32))


def test_large_tables_of_templates_are_joined(spark, table, monkeypatch):
    want = sorted(map(str, main_text(spark.createDataFrame(table, ROW)).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_TEXTS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = main_text(spark.createDataFrame(table, ROW))
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().toString() and sorted(map(str, joined.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_deep_pages():
    assert extract("<div>" * 60_000 + "deep") == "deep"
    assert TEXT == 2
