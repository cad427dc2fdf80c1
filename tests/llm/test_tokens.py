"""BPE automaton and token files against the tokenizers library, exact."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer as Library
from tokenizers.models import BPE
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import WhitespaceSplit

from evigraph.llm.bpe import Automaton, Tokenizer, bpe
from evigraph.llm.catalog import VOCABULARY
from evigraph.llm.token_files import Code, LibraryIds, code_lengths, read_ids, write_ids

SPEC = open(VOCABULARY, encoding="utf-8").read()
LIBRARY = Library.from_file(VOCABULARY)
ALPHABET = "aaabbcde'stſİIßΣσéÉ  \n\t\x1c\x85 ḉ<|endoftext|>$$$!!123٣日本語"


def texts(n=3000):
    rng = random.Random(9)
    return ["", "<|endoftext|>x<|startoftext|>", "aaaaaaaa aaaaaaa", "<|endoftext", "ΑΣ ΑΣ.", "it's we'll  don't", "J̌ ǰ", "ạ́", "x" * 5000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_automaton_is_the_library():
    t = Tokenizer(SPEC, word_memo=50)
    for text, e in zip(texts(), LIBRARY.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert t.encode(text) == (len(e.ids), " ".join(map(str, e.ids)), LIBRARY.decode(e.ids, skip_special_tokens=False)), text


def test_every_code_point():
    """Each code point between two letters, alone behind a space, and doubled, against the library; ids by both operators."""
    mine, lib = Tokenizer(SPEC), LibraryIds(SPEC)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        batch = [f"a{c}b {c} a{c}{c}" for c in part]
        ids = lib.encode(batch) if at < 0x4000 else [None] * len(batch)  # it hands other texts to the library
        for c, text, e, raw in zip(part, batch, LIBRARY.encode_batch_fast(batch, add_special_tokens=False), ids, strict=True):
            assert mine.encode(text)[1] == " ".join(map(str, e.ids)), hex(ord(c))
            assert raw is None or np.frombuffer(raw, lib.kind).tolist() == e.ids, hex(ord(c))


def test_other_vocabulary_files():
    """The file's own normaliser and splitter count: here none, and one by white space alone."""
    vocab = {c: i for i, c in enumerate("abcABC'1")} | {f"{c}</w>": i + 8 for i, c in enumerate("abcABC'1")} | {"ab": 16, "abc</w>": 17, "AB</w>": 18}
    for normalizer, splitter in ((None, None), (None, WhitespaceSplit()), (Lowercase(), WhitespaceSplit())):
        library = Library(BPE(vocab, [("a", "b"), ("ab", "c</w>"), ("A", "B</w>")], end_of_word_suffix="</w>"))
        if normalizer:
            library.normalizer = normalizer
        if splitter:
            library.pre_tokenizer = splitter
        mine = Tokenizer(library.to_str())
        for text in ("abc", "ABab'1", *(["ab abc\nAB  cab", " "] if splitter else [])):
            assert mine.encode(text)[1] == " ".join(map(str, library.encode(text).ids)), (text, splitter)


def test_rules_that_make_one_token_are_refused():
    vocab = {c: i for i, c in enumerate("ab")} | {"aa": 2, "aaa": 3}
    with pytest.raises(ValueError, match="several rules"):
        Automaton(vocab, [("a", "a"), ("a", "aa"), ("aa", "a")])


def test_arc_table_is_the_gadgets():
    """The compiled intervals against the arcs told by the states' histories."""
    data = json.loads(SPEC)
    a = Automaton(data["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]])
    rng, made = random.Random(6), sorted(a.made)
    few = rng.sample(made, 300)
    for last in rng.sample(made, 60):
        for token in few + [t for t in made if a.left[t] == last][:50]:
            assert a.arc(last, token) == a._leaves(a.behind[last], token)


def test_any_merges():
    """Small random rule sets, runs of one letter included."""
    rng = random.Random(3)
    for _ in range(40):
        vocab = {c: i for i, c in enumerate("ab")} | {f"{c}</w>": i + 2 for i, c in enumerate("ab")}
        merges = []
        for _ in range(12):
            u = rng.choice([t for t in vocab if not t.endswith("</w>")])
            v = rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        library = Library(BPE(vocab, merges, end_of_word_suffix="</w>"))
        mine = Automaton(vocab, merges)
        for _ in range(200):
            w = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
            assert mine.encode(w[:-1] + chr(ord(w[-1]) + 0x2000)) == library.encode(w).ids, (merges, w)


def test_operator_cases(spark):
    rows = [(1, None), (2, ""), (3, "Hello, World"), (3, "Hello, World"), (None, "x"), (4, "long text " * 30_000)]
    df = spark.createDataFrame([(d, t, 7, "n", "i") for d, t in rows], "doc_id long, text string, n_tokens int, ids string, _x string")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe(df, VOCABULARY, digests=True).collect())
    want = []
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe(df, VOCABULARY).where("doc_id = 3").first()["decoded"] == "hello</w> ,</w> world</w>"
    assert bpe(df.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_code_is_complete_and_decodes(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.2, n).clip(max=10**9).astype(np.int64)
    lengths = code_lengths(counts, 14)
    assert lengths.max() <= 14 and (n == 1 or abs((2.0**-lengths).sum() - 1) < 1e-9)
    ids = np.sort(rng.choice(60_000, n, replace=False))
    code = Code(ids, lengths)
    some, sizes = rng.choice(ids, 5000), np.array([0, 1, 3000, 1999])
    payload, begin, at = code.encode(some, sizes)
    first = np.array([0, 1, 1025, 2049, 3001, 4025])
    assert (code.decode(payload, at[first], np.diff([*first, 5000])) == some).all() and len(payload) == begin[-1]


def test_lengths_are_optimal():
    import heapq

    rng = random.Random(1)
    for _ in range(30):
        counts = [rng.randrange(1, 100) for _ in range(rng.randrange(2, 30))]
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert (code_lengths(np.array(counts), 30) * counts).sum() == cost


def test_library_words():
    lib = LibraryIds(SPEC, 60)
    batch = texts(600)
    for at in range(0, len(batch), 50):
        part = batch[at : at + 50]
        for t, raw in zip(part, lib.encode(part), strict=True):
            assert np.frombuffer(raw, lib.kind).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t


def test_library_words_in_blocks(monkeypatch):
    odd = ["", " ", "'", "''s", "'s's", "x'll've", "'re", "'r", "5's", "--'s", "'sand 'tis 'd", "a1b22c", "\u00e9t\u00e9's \u00df\u00a0\u0131x", "\x85a\x1cb\x0bc", "q" * 64 + " " + "q" * 65 + "r " + "q" * 66, "-" * 300 + "'s", "Ab\n\nC", "\u0130 dot", "\u4e2d"]
    rng = random.Random(4)
    odd += ["".join(rng.choice("ab'stdrevlm1. \u00e9-") for _ in range(rng.randrange(40))) for _ in range(400)]
    monkeypatch.setattr("evigraph.llm.word_ids.BLOCK", 300)
    monkeypatch.setattr("evigraph.llm.token_files.BLOCK", 300)
    odd += [" ".join(odd[20:120]), "w" * 2000, "w " * 2000]
    for memo in (3, 5000):
        lib = LibraryIds(SPEC, memo)
        for t, raw in zip(odd, lib.encode(odd), strict=True):
            assert np.frombuffer(raw, lib.kind).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t
        assert lib.encode([]) == [] and lib.encode([None]) == [b""]


def test_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i * 7 - 50, rng.choice(texts(50))) for i in range(1300)] + [(5, None), (6, ""), (9, "same"), (9, "same"), (None, "no id"), (10**12, "far " * 20_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, range int, n int")
    write_ids(df, f"{tmp_path}/files", VOCABULARY)
    got = read_ids(spark, f"{tmp_path}/files").collect()
    crc = {r["start"]: r["ids_crc32"] for r in read_ids(spark, f"{tmp_path}/files", digests=True).collect()}
    want = [(d, LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(want, key=key)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and crc[at] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [d for d, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))]


def test_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    write_ids(df, f"{tmp_path}/none", VOCABULARY)
    assert read_ids(spark, f"{tmp_path}/none").count() == 0
