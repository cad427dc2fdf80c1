"""A training-corpus pipeline over ``documents``: language, near-duplicates, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.bpe import bpe
from evigraph.llm.catalog import VOCABULARY
from evigraph.llm.language_id import UNKNOWN, identify
from evigraph.llm.mixing import mix
from evigraph.llm.near_dedup import one_of_each
from evigraph.llm.tables import cut

#: Documents whose trigrams are at most this much like those of their best language, whatever chance takes from a text of their
#: length, are in no language that was learned. Texts of the learned languages lie around 1.
LEAST_FIT = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null, no letters, or a fit below ``LEAST_FIT`` beyond doubt.

    Cases: repeated rows and null ids are judged by their text; no rows, no result; where nothing can be learned (no row
    with a language) no text has one; columns of any name pass through.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("whole_row"))
    return identify(rows, keep=("whole_row",)).where((F.col("lang_pred") != UNKNOWN) & (F.col("fit") >= LEAST_FIT)).select("whole_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: links share 80 % of their five-word shingles.

    Cases: rows equal in id and text become one; rows without words stay; an id on several texts is judged in each; a row
    without id stays only if no member of its group has one; columns of any name pass through; no rows, no result.
    """
    return one_of_each(docs, words=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics take flattened shares of the tokens.

    Cases: null labels are a value of their own; null or empty texts weigh nothing; rows with one id are drawn alike; no rows,
    no result; columns of any name pass through.
    """
    return mix(docs, carry=True).where("kept").select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to: ``doc_id, n_tokens, ids, decoded``.

    Cases: null or empty text has no tokens; repeated rows and null ids pass through; no rows, no result.
    """
    return bpe(docs, VOCABULARY)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", tokens)]

#: The first stage learns and scores vectors, the second searches by sketches: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again but for the last.

    Cases are those of the stages; a table without rows gives the last stage's columns without rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
