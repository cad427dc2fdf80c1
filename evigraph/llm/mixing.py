"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to the target share of each source, language and
topic. The raked share of a cell over its own tokens is the rate at which its documents are kept, scaled so that the
largest rate is 1: what is kept then has the target marginals in expectation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that the driver rakes at most (24 bytes of numbers each); their number depends on the labels, not on the rows.
MOST_CELLS = 2_000_000
#: Up to so many cells (about 20 MB) the rates are broadcast; beyond, Spark joins by shuffle and splits hot cells.
BROADCAST_CELLS = 200_000
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A topic where the table names none: ``licensed``, ``marked`` (symbol runs), ``shouting`` (no a-z) or ``prose``."""
    return (
        F.when(text.isNull(), F.lit("prose")).when(text.contains("icensed under") | text.contains("Released under"), F.lit("licensed"))
        .when(text.contains("$$$") | text.contains("%%%"), F.lit("marked")).when(text.rlike("[A-Z]") & ~text.rlike("[a-z]"), F.lit("shouting")).otherwise(F.lit("prose"))
    )


def token_count(text: Column) -> Column:
    """Tokens as parts between single blanks, tabs and line ends; none for null or empty text."""
    gaps = F.length(text) - F.length(F.translate(text, " \n\t\r", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


def rake(labels: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int) -> np.ndarray:
    """``tokens`` of cells fitted in turn to each dimension's ``targets``; ``labels`` hold each cell's place in them."""
    w = tokens.astype(np.float64)
    for _ in range(rounds):
        for at, target in zip(labels, targets, strict=True):
            have = np.bincount(at, w, len(target))
            w = w * np.divide(target, have, out=np.zeros(len(target)), where=have > 0)[at]
    return w


def rates(cells: list[tuple], exponent: float, rounds: int, targets: list[dict[str, float]] | None = None) -> list[tuple]:
    """``(source, lang, topic, rate)`` of each ``(source, lang, topic, tokens)``.

    Without ``targets`` each dimension's shares are its present ones to the power ``exponent``, made to sum to 1. Cells
    without tokens have rate 1: they cost nothing.
    """
    full = [c for c in cells if c[3] > 0]
    if not full:
        return [(*c[:3], 1.0) for c in cells]
    tokens = np.array([c[3] for c in full], np.float64)
    labels, wanted = [], []
    for d in range(3):
        names, at = np.unique([c[d] for c in full], return_inverse=True)
        share = np.bincount(at, tokens, len(names)) ** exponent if targets is None else np.array([targets[d].get(n, 0.0) for n in names])
        if share.sum() <= 0:
            raise ValueError("no target weight falls on a value that occurs")
        labels.append(at)
        wanted.append(share / share.sum())
    rate = rake(labels, tokens, wanted, rounds) / tokens
    return [(*c[:3], float(r)) for c, r in zip(full, rate / rate.max(), strict=True)] + [(*c[:3], 1.0) for c in cells if c[3] <= 0]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, tokens: Column | None = None, exponent: float = 0.8, targets: list[dict[str, float]] | None = None, rounds: int = 25, seed: int = 17, carry: bool = False) -> DataFrame:
    """Each row's cell, rate and draw: ``id, source, lang, topic, n_tokens, rate, kept``; with ``carry`` also its whole
    input row as the struct ``_row``.

    Token sums by cell are pre-aggregated in the tasks, so a hot source is no hot task; the driver gets one row for each
    cell and rakes them; the rates come back as a join, broadcast up to a counted size. A row is kept if
    its draw, 52 bits of MD5 of seed and id, is below its rate: the same rows whatever the order or the cluster.

    Cases: no rows, no result; null source or language is the value ``(none)``; null or empty text has no tokens and, if its whole cell has
    none, rate 1; a null id draws as empty text; repeated rows draw alike; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    topic = topic_of(text) if topic is None else topic
    tokens = token_count(text) if tokens is None else tokens
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    base = docs.select(F.col(id_col), label(source_col).alias("source"), label(lang_col).alias("lang"), F.coalesce(topic.cast("string"), F.lit(NONE)).alias("topic"), tokens.alias("n_tokens"), *([F.struct(*docs.columns).alias("_row")] if carry else []))
    cells = base.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    found = [tuple(r) for r in cells.limit(MOST_CELLS + 1).collect()]
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: use coarser labels")
    table = spark.createDataFrame(rates(sorted(found), exponent, rounds, targets), "source string, lang string, topic string, rate double")
    if len(found) <= BROADCAST_CELLS:
        table = F.broadcast(table)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return base.join(table, ["source", "lang", "topic"]).select(F.col(id_col), "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), (draw < F.col("rate")).alias("kept"), *(["_row"] if carry else []))


def margins(mixed: DataFrame) -> DataFrame:
    """How near a mixture comes to its targets: ``dimension, value, tokens, expected, reached`` of each source, language and topic.

    ``tokens`` is the share of all tokens, ``expected`` the share under the rates (the target, as far as raking has met it),
    ``reached`` that of the rows drawn. ``mixed`` is the result of :func:`mix`; one row for each value, none for no rows.
    """
    n, kept = F.col("n_tokens"), F.col("kept").cast("int")
    cells = mixed.groupBy("source", "lang", "topic").agg(F.sum(n).alias("tokens"), F.sum(n * F.col("rate")).alias("expected"), F.sum(n * kept).alias("reached"))
    by = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("source", "lang", "topic")])).alias("m")
    sums = cells.select(by, "tokens", "expected", "reached").groupBy("m").agg(*[F.sum(c).alias(c) for c in ("tokens", "expected", "reached")])
    share = lambda c: (F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("m.dimension")), F.lit(0))).alias(c)
    return sums.select("m.dimension", "m.value", share("tokens"), share("expected"), share("reached"))


def oracle(exponent: float = 0.8, rounds: int = 25, seed: int = 17) -> str:
    """:func:`mix` of ``documents`` in DuckDB SQL; one step of the recursion is one round over all three dimensions."""
    step = "cells"
    for d in ("source", "lang", "topic"):
        step = f"(SELECT *  REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {step})"
    step = step.replace("FROM cells)", "FROM fit WHERE k < %d)" % rounds, 1)
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN text IS NULL THEN 'prose' WHEN contains(text, 'icensed under') OR contains(text, 'Released under') THEN 'licensed' WHEN contains(text, '$$$') OR contains(text, '%%%') THEN 'marked'
      WHEN regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]') THEN 'shouting' ELSE 'prose' END AS topic,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(translate(text, ' ' || chr(10) || chr(9) || chr(13), '')) + 1 END::BIGINT AS n_tokens
  FROM documents
), cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM base GROUP BY ALL HAVING sum(n_tokens) > 0),
marg AS (SELECT *, pow(sum(tokens) OVER (PARTITION BY source), {exponent}) AS ps, pow(sum(tokens) OVER (PARTITION BY lang), {exponent}) AS pl, pow(sum(tokens) OVER (PARTITION BY topic), {exponent}) AS pt FROM cells),
sums AS (SELECT (SELECT sum(p) FROM (SELECT DISTINCT source, ps AS p FROM marg)) AS s, (SELECT sum(p) FROM (SELECT DISTINCT lang, pl AS p FROM marg)) AS l, (SELECT sum(p) FROM (SELECT DISTINCT topic, pt AS p FROM marg)) AS t),
fit AS (
  SELECT 0 AS k, source, lang, topic, tokens, ps / s AS t_source, pl / l AS t_lang, pt / t AS t_topic, tokens AS w FROM marg, sums
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, t_source, t_lang, t_topic, w FROM {step}
), rated AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS rate FROM fit WHERE k = {rounds})
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(rate, 1.0), 6) AS rate,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(rate, 1.0) AS kept
FROM base LEFT JOIN rated USING (source, lang, topic)
"""
