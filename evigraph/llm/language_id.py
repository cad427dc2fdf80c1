"""Language identification by hyperdimensional profiles.

Each letter has a random vector of -1 and 1. A trigram ``abc`` is bound from the permuted vectors of its letters,
``roll(a, 2) * roll(b, 1) * c``; a text is the bundle (sum) of its trigrams, a language the bundle of the
trigrams of all its learning texts. A text goes to the language with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop, rows_of, ship, slices

#: Symbols: 0 stands between words, 1 to 26 are a to z, all other letters share 27 to 63 by their code point.
SYMBOLS, OTHER = 64, 37
UNKNOWN = "und"
#: Languages at most: 4 MB of numbers for each thousand of them travel to the tasks.
MOST_LANGS = 4096
#: How many standard deviations chance is granted in ``fit``: the inner product of a trigram with a prototype has a deviation of about 1.
SIGMAS = 3.0


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % OTHER
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Numbers of the trigrams of a whole text, in order: lower case, one gap between words and at both ends."""
    if not text:
        return np.empty(0, np.int32)
    symbols = _symbol_table()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    s = symbols[keep]
    if symbols[0] == 0 and not keep[0]:
        s = np.concatenate([symbols[:1], s])
    s = s.astype(np.int32)
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:] if len(s) > 2 else np.empty(0, np.int32)


@lru_cache(2)
def _letters(size: int, seed: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SYMBOLS, size)) * 2 - 1).astype(np.int8)


def bound(grams: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The bound vector of each trigram number, as float32 rows."""
    v = _letters(size, seed)
    return (np.roll(v, 2, 1)[grams >> 12] * np.roll(v, 1, 1)[(grams >> 6) & 63] * v[grams & 63]).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, summed within a task."""

    def rows():
        for lang, c in total.items():
            g = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(c[g], pa.int64())], ["lang", "gram", "n"])

    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in rows_of(batch, "lang", "text"):
            if len(total) >= 64 and lang not in total:
                yield from rows()
                total = {}
            c = total.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))
            g, n = np.unique(trigrams(text), return_counts=True)
            c[g] += n
    yield from rows()


def _bundle(counts: pd.DataFrame, size: int, seed: int) -> pd.DataFrame:
    """The bundle of one language: the sum of the bound vectors of its counted trigrams, how many they are, and how many different ones."""
    total = np.zeros(size, np.int64)
    grams, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    for low in range(0, len(grams), 8192):
        total += np.rint(n[low : low + 8192].astype(np.float64) @ bound(grams[low : low + 8192], size, seed)).astype(np.int64)
    return pd.DataFrame({"lang": [counts["lang"].iloc[0]], "total": [total], "n": [int(n.sum())], "kinds": [len(grams)]})


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = 1024, seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, their unit prototypes, their coherence and how many different trigrams they were learned from, from all rows with a language.

    Trigrams are counted in the tasks and bundled language by language, no more than 64^3 counts of each; one vector of ``size`` whole numbers for each language reaches the driver,
    and :data:`MOST_LANGS` languages at most: what is sent to all tasks is bounded by that, so more are an error. The
    coherence of a language is the mean inner product of its trigrams with its prototype.

    Cases: rows without text or language teach nothing; texts without a letter teach a language of which nothing is known, which no
    text is like; no rows, no languages.
    """
    base = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = base.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bundles = cut(counts.groupBy("lang").applyInPandas(lambda c: _bundle(c, size, seed), "lang string, total array<long>, n long, kinds long"), "bundles")
    if bundles.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: these are not language names")
    rows = bundles.orderBy("lang").collect()
    drop(bundles)
    totals = np.array([r["total"] for r in rows], np.float64).reshape(len(rows), size)
    norms = np.linalg.norm(totals, axis=1)
    return [r["lang"] for r in rows], totals / np.maximum(norms, 1e-12)[:, None], norms / np.maximum([r["n"] for r in rows], 1), np.array([r["kinds"] for r in rows], np.float64)


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], prototypes: np.ndarray, coherence: np.ndarray, kinds: np.ndarray, size: int, seed: int, block: int = 128) -> Iterator[pa.RecordBatch]:
    p = prototypes.astype(np.float32)
    for batch in slices(batches, block):
        texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
        pred, score, fit = [], [], []
        grams = [trigrams(t) for t in texts]
        joined = np.concatenate(grams) if grams else np.empty(0, np.int32)
        used = np.flatnonzero(np.bincount(joined, minlength=1)) if len(joined) else np.empty(0, np.int64)
        local = np.zeros(SYMBOLS**3, np.int32)
        local[used] = np.arange(len(used))
        counts = np.zeros((len(grams), len(used)), np.float32)
        for i, g in enumerate(grams):
            if len(g):
                counts[i] = np.bincount(local[g], minlength=len(used))
        vectors = np.zeros((len(grams), size), np.float32)
        for low in range(0, len(used), 4096):
            vectors += counts[:, low : low + 4096] @ bound(used[low : low + 4096], size, seed)
        dots = vectors @ p.T if len(langs) else np.zeros((len(grams), 1))
        cosine = dots / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        best = cosine.argmax(1)
        for i, g in enumerate(grams):
            known = len(g) > 0 and len(langs) > 0
            pred.append(langs[best[i]] if known else UNKNOWN)
            score.append(float(min(1.0, max(0.0, cosine[i, best[i]]))) if known else 0.0)
            own = max(float(coherence[best[i]]), 1e-9) if known else 1.0
            chance = SIGMAS / len(g) ** 0.5 + SIGMAS / kinds[best[i]] ** 0.5 if known else 0.0
            fit.append(float(dots[i, best[i]] / len(g) + chance) / own if known else 0.0)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], [*names, "lang_pred", "score", "fit"])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether CRC-32 of the id as text is divisible by 5; a null id counts as empty text, and so as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 1024, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text: ``id, held_out, lang_pred, score, fit`` and the columns in ``keep``.

    Prototypes are learned from the rows that are not held out and name a language; predictions see the text alone.
    ``score`` is the cosine with the best prototype, no less than 0. ``fit`` is the most that the text's trigrams may be like
    that language, 1 for texts like those it was learned from: the mean inner product of a trigram with the prototype,
    plus what chance can take from a text of this length and a language learned from so many different trigrams, over the
    language's own mean.

    Cases: null text, and text without a letter, are ``und`` with score 0, as is all text if nothing could be learned; a tie
    goes to the language that sorts first; repeated rows pass through; other columns are not read. Letters that
    differ by a multiple of 37 beyond a-z share a vector.
    """
    ship(docs.sparkSession)
    langs, prototypes, coherence, kinds = learn(docs.where(~held_out(id_col)), text_col=text_col, lang_col=lang_col, size=size, seed=seed)
    base = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), *keep, F.col(text_col).cast("string").alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "_text")
    return base.mapInArrow(lambda it: _predict(it, langs, prototypes, coherence, kinds, size, seed), f"{out}, lang_pred string, score double, fit double")
