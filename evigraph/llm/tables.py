"""Intermediate tables: lineage is cut by written Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

__all__ = ["connected_components", "cut", "drop", "rows_of", "shared_dir", "shared_path", "ship", "slices"]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset in local mode, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _forget_later(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/evigraph-tables/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    _forget_later(spark, path)
    return path


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table survives the loss of any executor and is computed once, unlike a cached or a
    locally checkpointed one. Files are removed when the JVM ends, or earlier by :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigraph-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _forget_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evigraph_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_evigraph_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of an Arrow batch as tuples of Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that what a task makes of one part stays small: up to ``rows`` rows, and no more
    than ``most_bytes`` of strings and lists unless one row alone has more."""
    for batch in batches:
        n = batch.num_rows
        if batch.nbytes <= most_bytes:
            cuts = range(0, n, rows)
        else:
            size = np.zeros(n, np.int64)
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                    size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                elif pa.types.is_list(column.type):
                    size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            cuts, begin, held = [], 0, 0
            for i, b in enumerate(size.tolist()):
                if i == 0 or i - begin >= rows or held + b > most_bytes:
                    cuts.append(i)
                    begin, held = i, 0
                held += b
        ends = [*cuts[1:], n]
        for a, b in zip(cuts, ends, strict=False):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers live on and share an executor's memory


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected graph given as ``u, v`` (long); returns ``node, label`` with the smallest member.

    Each round takes the smallest label among neighbours and then jumps to that label's own label, so that
    the number of rounds grows with the logarithm of the longest path. Edges and labels are joined as written tables, so that
    Spark can split the rows of a hot centre. Labels stay distributed: only the count of changed rows reaches the driver. Null ends and loops are ignored; no edges give no rows.
    """
    both = cut(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v").distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = cut(step.join(roots, "label").select("node", F.least("label", "root").alias("label"), (F.least("label", "root") < F.col("was")).alias("changed")), f"{name}-labels")
        changed = new.where("changed").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            out = labels.select("node", "label")
            out._evigraph_path = labels._evigraph_path
            return out
