"""Incremental processing: new files of documents as micro-batches, each document once."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import unprocessed
from ..sources import batches


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def process_new(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "id", files: int = 100) -> int:
    """Run ``work`` over documents in files not seen yet and append its rows to ``out``; returns the rows there.

    The stream remembers files and, as keyed state on disk, the keys it has passed on: a file written again adds nothing, and a micro-batch costs the same
    however large the output is, which it does not read. Each micro-batch is a batch of :mod:`sources.batches` under the stream's id and its own number, so one that is run
    again after a failure finds itself done. Only what other streams have written (those of a lost checkpoint, say) is compared by key.
    """
    ready, names = threading.Event(), {}

    def batch(df: DataFrame, number: int) -> None:
        ready.wait()
        others = [b for b in batches.ids(spark, out) if not b.startswith(names["stream"])]
        fresh = unprocessed(df, batches.read(spark, out, others), key) if others else df
        if not batches.write(work(fresh), out, f"{names['stream']}-{number:09d}"):
            df.write.format("noop").mode("overwrite").save()  # the rows are there; the state of their keys is not

    had = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).dropDuplicates([key])
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        names["stream"] = f"s{query.id}"
        ready.set()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, had) if had else spark.conf.unset(STATE_STORE)
    return batches.read(spark, out).count() if batches.ids(spark, out) else 0


def counts_by_type(spark: SparkSession, folder: str, schema: str, name: str, checkpoint: str) -> DataFrame:
    """Events by type, counted by a stream that reads all files there are; a batch count gives the same."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()  # a stream reads folders
    source = spark.readStream.schema(schema).option("pathGlobFilter", where.getName() if single else "*.parquet")
    events = source.parquet(where.getParent().toString() if single else folder)
    query = events.groupBy("event_type").agg(F.count("*").alias("events")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
