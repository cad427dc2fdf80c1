"""What Python workers need: this package, sent to them once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each context, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_evigraph_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="evigraph-"), "evigraph_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("evigraph", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._evigraph_shipped = True
