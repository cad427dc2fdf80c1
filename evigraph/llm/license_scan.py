"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Texts and templates are words of a-z and 0-9. A template of :data:`LONG` shingles or more is retrieved by windows of
:data:`WINDOW` shingles: those of a text begin at every fourth shingle, those of a template at every one, and each
window has one smallest hash in each of :data:`BANDS` bands. Any eleven shingles of a template that stand in a text
hold a window of the text that is also one of the template, which collides in all bands; a window of similarity ``s`` to one
of the template is missed by all bands with probability ``(1 - s) ** BANDS``. Shorter templates have windows of one
shingle, where the smallest hash is the shingle itself and every shared shingle collides. The keys of all templates are a band table that
each key of a text is looked up in, at a cost that does not depend on the number of templates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LICENSES
from .native import let, longs, word_shingles

WORDS, LONG, WINDOW, STRIDE, BANDS = 5, 16, 8, 4, 6
#: Templates travel in the plan: so many at most.
MOST_TEMPLATES = 2000


def plain_words(text: Column) -> Column:
    """Lower-case words of a-z and 0-9; none for null."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.array_remove(F.split(flat, " "), "")


def _shingles(text: Column) -> Column:
    """Shingle hashes in order; none for fewer than five words."""
    return let(plain_words(text), lambda w: F.when(F.size(w) >= WORDS, word_shingles(w, WORDS)).otherwise(F.array().cast("array<bigint>")))


def _window_keys(shingles: Column, stride: int) -> Column:
    """The band keys of all windows that begin at every ``stride``-th shingle."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - WINDOW, F.lit(0)), F.lit(stride))

    def band(b: int) -> Column:
        hashes = F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b)))
        return let(hashes, lambda v: F.transform(starts, lambda i: F.xxhash64(F.lit(b), F.array_min(F.slice(v, i + 1, WINDOW)))))

    return F.when(F.size(shingles) >= WINDOW, F.concat(*[band(b) for b in range(BANDS)])).otherwise(F.array().cast("array<bigint>"))


def _templates(spark: SparkSession, texts: dict[str, str]) -> list[tuple[str, list[int], list[int]]]:
    """Name, retrieval keys and distinct shingles of each template."""
    if not texts or len(texts) > MOST_TEMPLATES or any("\n" in name for name in texts):
        raise ValueError(f"from 1 to {MOST_TEMPLATES} templates, with names of one line")
    rows = spark.createDataFrame(sorted(texts.items()), "name string, text string")
    rows = rows.select("name", _shingles(F.col("text")).alias("s"))
    rows = rows.select("name", F.when(F.size("s") >= LONG, _window_keys(F.col("s"), 1)).otherwise(F.col("s")).alias("keys"), "s").collect()
    short = [r["name"] for r in rows if not r["s"]]
    if short:
        raise ValueError(f"templates of fewer than {WORDS} words: {short}")
    return [(r["name"], sorted(set(r["keys"])), sorted(set(r["s"]))) for r in sorted(rows)]


def _index(found: list[tuple[str, list[int], list[int]]]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """The band table of the templates, as constants of the plan: a test that drops most keys that no template has, and a
    look-up of the numbers of the templates that have a key, null for none.

    The test reads one bit of a map of 32 bits or more for each key; the look-up reads one bucket of about four keys. Neither
    depends on how many templates there are.
    """
    owners: dict[int, list[int]] = {}
    for t, (_, keys, _) in enumerate(found):
        for k in keys:
            owners.setdefault(k, []).append(t)
    words = 1 << max(0, (len(owners) * 32 // 64 - 1).bit_length())
    buckets = 1 << max(0, (len(owners) // 4 - 1).bit_length())
    bits, lists = [0] * words, [[] for _ in range(buckets)]
    for k, numbers in owners.items():
        bits[(k >> 6) & (words - 1)] |= 1 << (k & 63)
        lists[(k >> 32) & (buckets - 1)].append(f"{k}:{' '.join(map(str, numbers))}")
    marks = longs([x - (1 << 64) if x >> 63 else x for x in bits])
    rows = F.split(F.lit("\n".join(",".join(x) for x in lists)), "\n")

    def maybe(k: Column) -> Column:
        return F.getbit(F.get(marks, F.shiftright(k, 6).bitwiseAND(F.lit(words - 1).cast("long")).cast("int")), k.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    def numbers_of(k: Column) -> Column:
        bucket = F.get(rows, F.shiftright(k, 32).bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int"))
        return F.split(F.try_element_at(F.str_to_map(bucket, F.lit(","), F.lit(":")), k.cast("string")), " ").cast("array<int>")

    return maybe, numbers_of


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """One row for each license found in a row of ``docs``: ``id, license, n_shingles, n_common, containment, at_word``.

    A template is found if at least ``containment`` of its distinct five-word shingles stand in the whole text. ``at_word`` is the
    word, from 1, at which the first of them begins. Each row stands alone: no shuffle, no join, so neither a hot source nor
    a passage that all texts share costs more. The keys of a row are looked up in the band table; only the templates found
    there are compared, so the time of a row does not grow with the number of templates that it has nothing of.

    Cases: null, empty and shorter texts have no license; a text with several has a row for each; repeated rows and null ids
    pass through; no rows, no result; other columns are not read.
    """
    found = _templates(docs.sparkSession, templates or LICENSES)
    maybe, numbers_of = _index(found)
    names = F.split(F.lit("\n".join(name for name, _, _ in found)), "\n")
    wholes = F.split(F.lit("\n".join(",".join(map(str, s)) for _, _, s in found)), "\n")

    def verified(s: Column, numbers: Column) -> Column:
        one = lambda t: let(
            F.split(F.get(wholes, t), ",").cast("array<bigint>"),
            lambda x: F.struct(F.get(names, t).alias("license"), F.size(x).alias("n"), F.array_intersect(x, s).alias("common")),
        )
        near = F.filter(F.transform(numbers, one), lambda t: F.size(t["common"]) >= containment * t["n"])
        return F.transform(near, lambda t: F.struct(t["license"].alias("license"), t["n"].alias("n"), F.transform(t["common"], lambda x: F.array_position(s, x)).alias("at")))

    def licenses(s: Column) -> Column:
        hits = F.array_distinct(F.filter(F.concat(s, _window_keys(s, STRIDE)), maybe))
        numbers = let(hits, lambda h: F.when(F.size(h) > 0, F.array_distinct(F.flatten(F.filter(F.transform(h, numbers_of), lambda t: t.isNotNull())))))
        return let(numbers, lambda t: F.when(F.size(t) > 0, verified(s, t)))

    # an outer explode: for a plain one the planner would compute all this once more, as a filter on empty results
    rows = docs.select(F.col(id_col), F.explode_outer(let(_shingles(F.col(text_col).cast("string")), licenses)).alias("_t")).where("_t IS NOT NULL")
    n, common = F.col("_t.n"), F.size("_t.at")
    return rows.select(id_col, F.col("_t.license").alias("license"), n.alias("n_shingles"), common.alias("n_common"), F.round(common / n, 4).alias("containment"), F.array_min("_t.at").alias("at_word"))


def oracle(containment: float = 0.8) -> str:
    """The same in DuckDB SQL: every text against every template, without retrieval."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LICENSES.items())
    words = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    runs = "list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))"
    return f"""
WITH t AS (SELECT license, list_distinct({runs}) AS s FROM (SELECT license, {words.format("text")} AS w FROM (VALUES {values}) v(license, text))),
d AS (SELECT doc_id, {runs} AS s FROM (SELECT doc_id, {words.format("text")} AS w FROM documents) WHERE len(w) >= 5)
SELECT doc_id, license, len(t.s)::INT AS n_shingles, len(list_intersect(t.s, d.s))::INT AS n_common, round(len(list_intersect(t.s, d.s)) / len(t.s), 4) AS containment,
  list_min(list_transform(list_intersect(t.s, d.s), lambda x: list_position(d.s, x)))::BIGINT AS at_word
FROM d, t WHERE list_has_any(t.s, d.s) AND len(list_intersect(t.s, d.s)) >= {containment} * len(t.s)
"""
