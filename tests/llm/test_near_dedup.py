import random
from itertools import combinations

import numpy as np

from evigraph.llm import shingles
from evigraph.llm.near_dedup import near_duplicates
from evigraph.llm.tables import connected_components

SCHEMA = "doc_id long, text string, set_key string, cid long, n_shingles int, bucket string"  # extra columns with clashing names


def brute(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = shingles.words(t)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if sets[i] and ids else d
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(map(str, out))


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1, 2, "b") for d, t in rows], SCHEMA)
    got = near_duplicates(df, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in got.collect())


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus(1, 12, 14, 5)
    for options in ({"words": 3, "num": 85, "den": 100}, {"words": 5, "num": 80, "den": 100}):
        assert run(spark, rows, **options) == brute(rows, **options)


def test_chain_of_edits(spark):
    """Neighbours in a chain are linked, its ends are not: one component all the same."""
    w = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((100 - i, " ".join(w)))
        for j in range(3):
            w[(i * 6 + j) % 200] = f"b{i}-{j}"
    got = run(spark, rows, words=3, num=85, den=100)
    assert got == brute(rows, 3, 85, 100) and all(", 71, " in r for r in got)


def test_cases(spark):
    long = " ".join(f"x{i % 97}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one"), (7, long), (8, long), (8, long), (None, long), (None, "alone here now"), (9, "É é"), (10, "é é"), (11, "other words for eleven"), (11, "one two")]
    assert run(spark, rows, words=3, num=85, den=100) == brute(rows, 3, 85, 100)
    assert run(spark, []) == []


def test_common_passage_does_not_link(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(120)) + " " + passage) for i in range(60)]
    assert run(spark, rows, words=3, num=85, den=100) == brute(rows, 3, 85, 100)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (None, 1)] + [(i, i + 1) for i in range(100, 140)], "u long, v long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys((3, 4, 5, 9), 3), 7: 7, 8: 7, **dict.fromkeys(range(100, 141), 100)}
    assert connected_components(edges.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    probes = shingles.probe_table(128)
    for size in (3, 40, 900):
        fits = []
        for _ in range(60):
            x = rng.integers(0, 2**64, size + size // 3, dtype=np.uint64)
            a, b = np.unique(x[:size]), np.unique(x[size // 3 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            fits.append((shingles.one_permutation(a, 128, probes) == shingles.one_permutation(b, 128, probes)).mean() - true)
        assert abs(np.mean(fits)) < 0.06
