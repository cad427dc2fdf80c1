"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, lexical_search, license_scan, mixing, secret_scan, sharding
from .bpe import bpe
from .fingerprints import fingerprints
from .html_text import main_text
from .language_id import identify
from .near_dedup import near_duplicates
from .tables import shared_path
from .token_files import read_ids, write_ids

from .vector_search import nearest

#: The vocabulary file of the registered queries; the operators take any path.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shards of the registered query; the table has the first prime of 100 slots for each.
SHARDS = 64


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of three-word shingle sets with ``100 * |A & B| >= 85 * |A | B|``."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents state."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return identify(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to a file set and read back, as digests."""
    path = shared_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), path, VOCABULARY)
    return read_ids(spark, path, digests=True)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return bpe(table(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and draw of every document, with flattened source, language and topic shares as targets."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every language's documents, in each order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that match each benchmark item best."""
    return lexical_search.search(lexical_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with those that only their targets' names give away."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run  # it takes the vocabulary from here

    return {"pipeline": run} | {f.__name__: f for f in (op1_sharding, op2_vector_search, op3_near_duplicates, op4_license_scan, op5_language_id, op6_html_text, op7_token_files, op8_fingerprints, op9_bpe, op10_mixing, op11_filter_audit, op12_lexical_search, op13_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(SHARDS, sharding.slots_for(SHARDS)), "op4_license_scan": license_scan.oracle(), "op10_mixing": mixing.oracle(), "op11_filter_audit": filter_audit.oracle(), "op12_lexical_search": lexical_search.oracle()}
