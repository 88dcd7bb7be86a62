"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cantora.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = plain(tuple(r) for r in df.select(*columns).collect())
    if name not in catalog.SQL:
        assert df.columns
        return
    wanted = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert rows == plain(wanted)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["ngram_rhythm_norm", "ngram_rhythm_norm_all"])
def test_query_on_events_in_parts(spark, tmp_path, name):
    """Copies of the events with shifted keys, in several files. A side of a join that is too large for a broadcast by its estimate turns out
    small, as on large tables, so that rows stay in the parts in which they were written."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "3000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    events = spark.read.parquet(f"{DATA}/events.parquet")
    copies = events.crossJoin(spark.range(3).toDF("copy")).withColumn("event_id", F.expr("event_id + copy * 1000000")).withColumn("user_id", F.expr("user_id + copy * 1500"))
    copies.drop("copy").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        df = catalog.QUERIES[name](spark, str(tmp_path))
        rows = plain(tuple(r) for r in df.collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows and rows == plain(con.sql(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall())
