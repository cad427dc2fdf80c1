import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoints").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Compares a query with its SQL in DuckDB over one folder of tables."""
    import duckdb

    def run(query, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        df = query(spark, str(folder))
        mine = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert sorted(rel.columns) == sorted(df.columns)
        assert mine == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())

    return run
