"""Tables of a run: one folder each, complete when Spark's marker is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How tables are written: a sentence that stands beside many mentions is held once for each row group.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(32 << 20)}
#: For tables of pairs, whose tasks have each sentence beside many of them.
CLOSE = PACKED | {"parquet.dictionary.page.size": str(120 << 20)}


def table_path(folder: str | None = None, url: str | None = None, name: str = "") -> str:
    """Where a table is; ``url`` comes before ``folder``."""
    base = url or folder
    if not base:
        raise ValueError("a folder or an url is needed")
    return f"{base.rstrip('/')}/{name}".rstrip("/")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    where, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def write(df: DataFrame, path: str, options: dict[str, str] = PACKED) -> None:
    df.write.mode("overwrite").options(**options).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may be read from: written beside it, then moved into its place.

    The old table is moved aside before and removed last, so that at any moment one of them is whole; :func:`restore` puts
    right what a run that broke off between the moves has left.
    """
    swap(df.sparkSession, lambda new: df.write.mode("overwrite").parquet(new), path)


def swap(spark: SparkSession, make: Callable[[str], object], path: str) -> None:
    """Put what ``make`` writes to the folder it is given into the place of the table at ``path``."""
    clear(spark, f"{path}.new")
    make(f"{path}.new")
    now, fs = _fs(spark, path)
    old, new = _fs(spark, f"{path}.old")[0], _fs(spark, f"{path}.new")[0]
    fs.delete(old, True)
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, now):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(old, True)


def restore(spark: SparkSession, path: str) -> bool:
    """Put a table back that a broken :func:`replace` has moved aside; whether there is a complete table at ``path``."""
    now, fs = _fs(spark, path)
    if not fs.exists(now):
        for rest in (f"{path}.new", f"{path}.old"):
            if complete(spark, rest) and fs.rename(_fs(spark, rest)[0], now):
                break
    return complete(spark, path)


def clear(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by ``spark.checkpoint.dir``; a temporary one where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/evigraph-tables"


def forget_later(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    where, fs = _fs(spark, path)
    fs.deleteOnExit(where)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, written once to the work folder and read from there until the application ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    forget_later(spark, path)
    write(df, path)
    return spark.read.parquet(path)


def reachable(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read."""
    try:
        spark.read.parquet(path).limit(1).count()
        return True
    except AnalysisException:
        return False


def point(spark: SparkSession, path: str, key: str, value: str) -> dict | None:
    """The row of one key, found by a pushed-down filter."""
    row = spark.read.parquet(path).where(F.col(key) == value).head()
    return row.asDict() if row else None


def ordered(spark: SparkSession, path: str, key: str = "pmid") -> DataFrame:
    """A table in the order of its ids as text."""
    return spark.read.parquet(path).orderBy(F.col(key).cast("string"))


def numbered(df: DataFrame, path: str, *order: Column) -> DataFrame:
    """The rows with ``pos``, from 1 in the given order, without a window over all of them.

    They are dealt to ranges of the order and written to ``path``, so that a row's range is settled; a row's place in its range is added to the number of rows in the ranges before, one
    number a range.
    """
    spark = df.sparkSession
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    rows, before, held = spark.read.parquet(path), 0, []
    for r in rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # one for each range
        held.append((r["_range"], before))
        before += r["n"]
    start = F.broadcast(spark.createDataFrame(held, "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_place", place).join(start, "_range").withColumn("pos", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array of all rows, in order, in one file: written by one task as rows stream by, an empty array without rows."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                if line is not None:
                    out.append(mark + line)
                    mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])

    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(line.alias("value"), F.struct(*order).alias("at"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"), F.lit(None).cast(rows.schema["at"].dataType).alias("at"))  # a row there is in any case
    rows.unionByName(start).repartition(1).sortWithinPartitions("at").select("value").mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
