import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    made = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf_dir, query, sql):
    """Rows of a query and of its SQL, as sorted lists."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    form = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted(str([form(r[k]) for k in cols]) for r in df.collect())
    rel = c.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(k) for k in cols]
    return mine, sorted(str([form(r[i]) for i in at]) for r in rel.fetchall())
