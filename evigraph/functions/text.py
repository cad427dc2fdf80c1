"""Scalar rules as column expressions: names, ids, types, citations, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LABEL_TYPES, UNKNOWN_TYPE

WORD = "(?iU)\\b({})\\b"
#: No word of a correction is shorter.
SHORTEST_HEAD = 8
SENTENCE = "[^.!?\n]+[.!?]*"
CITATION_URL = "https://pubmed.ncbi.nlm.nih.gov/"
# Pattern that decides, types it changes, new type. The first pattern that matches decides alone.
CORRECTIONS = (
    ("inhibitors?|inhibition", ("gene", "sequence_feature", "cell_type", "disease", "organism", "anatomy", "cellular_component", "biological_process", "substance"), "chemical"),
    ("antibod(?:y|ies)", ("gene", "sequence_feature", "biological_process", "cell_type"), "chemical"),
    ("syndrome", ("gene", "chemical", "cell_type", "organism", "anatomy", "sequence_feature", "pathology"), "disease"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text, in order; none where it is shorter. Takes time by the text's length."""
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + j) for j in range(n)]))
    return let(F.split(text, ""), lambda c: F.when(F.size(c) >= n, F.array_distinct(runs(c))).otherwise(F.array().cast("array<string>")))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def normalize_name(c: Column) -> Column:
    return strip(F.lower(c))


def filled(c: Column) -> Column:
    """Null for empty text."""
    return F.nullif(c, F.lit(""))


def entity_id(cui: Column, chebi: Column, go: Column, mesh: Column, name: Column) -> Column:
    """The first identifier that is not empty, else ``CUSTOM:`` and the normalised name."""
    return F.coalesce(filled(cui), filled(chebi), filled(go), filled(mesh), F.concat(F.lit("CUSTOM:"), normalize_name(name)))


def type_of_label(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, label), F.lit(UNKNOWN_TYPE))


def corrected_type(text: Column, kind: Column) -> Column:
    """Types that the head noun of a mention settles: inhibitors and antibodies are chemicals, syndromes diseases."""
    out = kind
    for i, (pattern, changes, new) in reversed(list(enumerate(CORRECTIONS))):
        change = kind.isin(*changes)
        if i == 0:
            change &= ~text.rlike(WORD.format("activity|pathway|process"))
        out = F.when(text.rlike(WORD.format(pattern)), F.when(change, F.lit(new)).otherwise(kind)).otherwise(out)
    return F.when(F.length(text) < SHORTEST_HEAD, kind).otherwise(out)


def _whole(doc_id: Column) -> Column:
    return F.concat(F.lit("(?U)\\b\\Q"), doc_id, F.lit("\\E\\b"))


def cited_ids(ids: Column, answer: Column) -> Column:
    """The ids that stand as whole words in the answer, in their order; all of them if none does."""
    cited = F.filter(ids, lambda d: F.regexp_like(answer, _whole(d)))
    return F.when(F.size(cited) > 0, cited).otherwise(ids)


def linkify(text: Column, ids: Column) -> Column:
    """Each id, as a whole word, becomes a Markdown link."""
    return F.aggregate(ids, text, lambda acc, d: F.regexp_replace(acc, _whole(d), F.concat(F.lit("["), d, F.lit(f"]({CITATION_URL}"), d, F.lit(")"))))


def sentences(text: Column) -> Column:
    """Sentences of a text: runs up to full stops, exclamation or question marks, or line ends."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def query_kind(question: Column) -> Column:
    """What a question asks about, by its words."""
    has = lambda *words: question.rlike("(?i)(" + "|".join(words) + ")")
    return F.when(has("relationship", "explain"), "relationship").when(has("gene"), "gene").when(has("drug", "chemical"), "chemical").when(has("disease"), "disease").otherwise("general")
