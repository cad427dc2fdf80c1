import random

import numpy as np

from evigraph.llm.html_text import extract, main_text
from evigraph.llm.vector_search import BEAM, SHARD_ROWS, beam_search, build, indexed, nearest, raised, ranked

PAGE = "page_id long, url string, html string, host string, tokens int, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", 1, "t") for i, u, h in rows], PAGE)


def shop(i, body):
    return f"""<!DOCTYPE html><html><head><title>Site</title><script>var t="</p>";</script><style>p{{}}</style></head><body><div class="top-menu"><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></div>
<div id="cookie-notice">We use cookies</div><div class="content"><h1>Title {i}</h1>{body}<p>Read this on paper</p></div><div class="sidebar"><p>{'Popular things to read today. ' * 9}</p></div>
<form><p>Your mail</p><input><button>Send</button></form><section class="comments"><article><p>{'Reader words ' * 40}</p></article></section><div class="footer">&copy; Site</div></body></html>"""


def test_article_rules():
    page = '<nav>menu</nav><article><header>h</header><h1>Ti&amp;tle</h1><p>One\n two<br>three<p><b>Four</b> &lt;five&gt;<aside>x</aside> six</p><ul><li>a<li>b</ul><script>var x="</article>"</script><!-- <p>no</p> --><div class="comments"><p>c</p></div></article><footer>f</footer>'
    assert extract(page) == "Ti&tle\n\nOne two three\n\nFour <five>\n\nsix\n\na\n\nb"
    assert extract(None) == extract("") == extract("<nav>x</nav>") == extract("<<<>>>&") [:0]
    assert extract("plain words &eacute;") == "plain words é"
    assert extract('<div class="ad"><p>buy<article><p>text</article>') == "text"
    assert extract("<body><p>a<p>b") == "a\n\nb"
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    assert extract(deep) == "deep"


def test_template_without_article(spark):
    rng = random.Random(0)
    bodies = [[" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 5))] for _ in range(12)]
    rows = [(i, f"http://shop.example/{i}", shop(i, "".join(f"<p>{p}</p>" for p in b))) for i, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in main_text(pages(spark, rows)).collect()}
    for i, b in enumerate(bodies):
        assert got[i] == "\n\n".join([f"Title {i}", *b])  # the line that is on all pages is the template's


def test_template_inside_article(spark):
    long = "We and our partners store information on your device to measure what you read. " * 3
    notice = f"<p>Get the weekly letter</p><div><p>{long}</p></div>"
    rows = [(i, f"http://news.example/{i}", f"<html><body><article><h1>Title {i}</h1><p>Body {i} of all</p>{notice}</article></body></html>") for i in range(4)]
    forms = [(10 + i, f"http://two.example/{i}", f"<body><article><h1>T {i}</h1><p>Text {i}</p>{'<div><b>Buy</b><i>now at our shop</i></div>' if i % 3 == 0 else ''}<p>more {i}</p></article></body>") for i in range(15)]
    copies = [(30 + i, f"http://copies.example/{i}", "<body><article><h1>Same</h1><p>One text</p></article></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in main_text(pages(spark, rows + forms + copies)).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i}\n\nBody {i} of all" for i in range(4)]
    assert [got[10 + i] for i in range(15)] == [f"T {i}\n\nText {i}\n\nmore {i}" for i in range(15)]  # a third of the pages have the advert
    assert {got[30 + i] for i in range(6)} == {"Same\n\nOne text"}


def test_names_of_article_parts():
    parts = ['<section id="related-work"><p>one</p></section>', '<p class="side-effects">two</p>', '<h2 class="section-header">three</h2>', '<h2 id="copyright">four</h2>', "<figure><img><figcaption>five</figcaption></figure>", '<div class="social-share"><p>x</p></div>', '<div id="comments">y</div>']
    words = "one\n\ntwo\n\nthree\n\nfour\n\nfive"
    assert extract(f"<body><article>{''.join(parts)}</article></body>") == words
    for wrapper in ("layout has-sidebar", "no-sidebar"):
        assert extract(f'<body><div class="{wrapper}"><article>{"".join(parts)}</article></div><div class="post-footer">z</div></body>') == words
    assert extract(f'<body><div class="top-menu">menu</div><div class="layout has-sidebar"><p>{"long text " * 9}</p><h2 class="section-header">more</h2></div></body>') == ("long text " * 9).strip() + "\n\nmore"
    assert extract('<body><div class="content"><p>A page of its own text.</p></div><ol class="comment-list"><li><article>I agree</article></li></ol></body>') == "A page of its own text."
    assert extract('<body><article><p>A page of its own text.</p></article><div class="related-posts"><article>And one more</article></div></body>') == "A page of its own text."


def test_page_cases(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "http://a.b/", "<p>x"), (3, "http://a.b/", "<p>x"), (None, "nonsense", "<article><p>" + "long text " * 50_000), (4, "HTTP://A.b:80/q", "<title>t</title>")]
    got = main_text(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 499_999), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert main_text(pages(spark, [])).count() == 0


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100 + i, [float(i), 1.0]) for i in range(5)] + [(200, None), (201, [0.0, 0.0]), (202, [1.0, None]), (203, [float("nan"), 1.0]), (204, [1.0, 2.0, 3.0]), (205, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, shard int")
    got = nearest(df, df.where("vec_id IN (3, 100, 200, 201)"), k=6).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 3] == [(3, 104, 4.0), (3, 103, 3.0), (3, 102, 2.0), (3, 0, 1.0), (3, 1, 1.0), (3, 2, 1.0)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 100] == [(101, 1.0), (102, 1.0), (103, 1.0), (104, 1.0), (0, 0.0), (1, 0.0)]
    assert {r["query_id"] for r in got} == {3, 100} and [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6] * 2
    assert nearest(df.limit(0), df).count() == 0
    assert nearest(df.where("vec_id < 2"), df.where("vec_id < 1"), k=5).count() == 1


def test_repeated_rows_of_equal_vectors(spark):
    rows = [(0, [1.0, 0.0])] * 7 + [(i, [1.0, 0.0]) for i in range(1, 12)] * 2 + [(50, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, df.where("vec_id IN (0, 3, 11)"), k=6).orderBy("query_id", "rank").collect()
    for q in (0, 3, 11):
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] == [(i, 1.0) for i in range(8) if i != q][:6]


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.7 * rng.normal(size=(3000, 24))).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    scores = x[::20].astype(float) @ x.T.astype(float)
    recall = []
    for k, i in enumerate(range(0, 3000, 20)):
        scores[k, i] = -np.inf
        recall.append(len(set(np.argsort(-scores[k], kind="stable")[:20].tolist()) & set(found[i])) / 20)
    assert np.mean(recall) > 0.95


def recall_of_shard(x, queries=200):
    """Mean recall of the 20 nearest of the last ``queries`` vectors in the shard of the others, and its beam."""
    x, q = x[:-queries], x[-queries:]
    shard, beam = indexed(x, np.arange(len(x)), 20, BEAM)
    found, scores, ok = shard.search(q, 20, beam)
    best = np.argsort(-(q.astype(float) @ x.T.astype(float)), 1)[:, :20]
    assert ok.all() and np.allclose(scores, np.einsum("qd,qkd->qk", q.astype(float), x[found].astype(float)), rtol=0, atol=1e-12)
    return np.mean([len(set(b) & set(f)) / 20 for b, f in zip(best.tolist(), found.tolist(), strict=True)]), beam


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(SHARD_ROWS, 64)) @ rng.normal(size=(64, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    recall, beam = recall_of_shard(x)
    assert recall > 0.99 and beam >= BEAM


def test_recall_on_vectors_that_are_hard_for_graphs():
    """Independent Gaussian numbers: no beam of a reasonable width is enough, so the shard is scanned."""
    recall, beam = recall_of_shard(np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32))
    assert recall > 0.95 and (beam == 0 or beam > BEAM)


def test_ranked_ties():
    scores, names = np.array([[1.0, 3.0, 2.0, 2.0, 2.0, -np.inf] * 20]), np.arange(120)[None, ::-1]
    for k in (1, 5, 25, 60, 130):
        top, ok = ranked(scores, names, k)
        want = sorted(zip(-scores[0], names[0], strict=True))[:k]
        assert [(-scores[0][i], names[0][i]) for i in top[0]] == want and ok.sum() == min(k, 100)


def test_double_vectors_and_ties_by_id(spark):
    """Many different vectors with one inner product; scores are those of the double vectors."""
    rows = [(1000 - i, [0.1, float(i)]) for i in range(300)] + [(5, [1.0, 0.0]), (2000, [0.3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 5"), k=4, exact=True).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2000, 0.3), (701, 0.1), (702, 0.1), (703, 0.1)]
    few = df.where("vec_id < 60 OR vec_id > 960")
    got = nearest(few, few.where("vec_id = 5"), k=4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2000, 0.3), (961, 0.1), (962, 0.1), (963, 0.1)]


def test_shards_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [sorted(map(str, nearest(df.repartition(n), df.where("vec_id % 20 = 0"), k=5, shard_rows=200).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 45 * 5
    best = {q: sorted(((-float(x[q].astype(float) @ x[j].astype(float)), j) for j in range(900) if j != q))[:5] for q in range(0, 900, 20)}
    exact = nearest(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=200, exact=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in exact] == [(q, j) for q in best for _, j in best[q]]


def test_graph_of_few():
    for n in (1, 2, 3, 40):
        x = raised(np.random.default_rng(n).normal(size=(n, 5)).astype(np.float32))
        arcs, entry = build(x)
        nodes, _ = beam_search(x, arcs, entry, x, 64)
        assert (nodes[:, 0] == np.arange(n)).all()
