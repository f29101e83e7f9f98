"""Every engine query against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from morpholake.plans import file_queries, mesh_queries, queries, readout_queries, source_queries  # noqa: F401
from morpholake.plans.registry import QUERIES, SQL
from morpholake.plans.tables import BASE


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in BASE:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(df):
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        return float(x) if hasattr(x, "__float__") and not isinstance(x, str) else str(x)

    df = df[sorted(df.columns)]
    return sorted(str(tuple(plain(x) for x in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_solids_are_made_by_many_tasks(spark, sf):
    from morpholake.plans.tables import domain

    assert domain(spark, sf, "solids").rdd.getNumPartitions() >= 4


def test_bricks_of_halo_rows_alone_are_passed_over(spark):
    from morpholake.operators import surface

    def run(brick, rows):
        if brick != (0, 0, 0):
            raise ValueError(f"brick {brick}")
        return {"n": rows["x"]}

    rows = spark.sql("SELECT 1 AS series, 0L AS x, 0L AS y, 0L AS z")
    assert [tuple(r) for r in surface.by_bricks(rows, run, "n long", ("series",)).collect()] == [(1, 0)]


def test_crowded_loci_are_compared_by_many_tasks(spark, tmp_path):
    """Features on one locus: all pairs, and no task makes half of them."""
    spark.range(300).selectExpr("id * 5000 AS o_orderkey", "CAST(0 AS BIGINT) AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = [r["count"] for r in QUERIES["locus_overlap"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 300 * 299 and max(made) < sum(made) / 2


def test_every_feature_asks_for_its_overlaps(spark, tmp_path):
    """No id here is divisible by 100, and all three features share a locus."""
    spark.sql("SELECT o_orderkey, 0L AS o_custkey FROM VALUES (1L), (5001L), (10001L) AS t(o_orderkey)").write.parquet(f"{tmp_path}/orders.parquet")
    ids = (1, 5001, 10001)
    assert sorted(map(tuple, QUERIES["locus_overlap"](spark, str(tmp_path)).collect())) == sorted((a, b) for a in ids for b in ids if a != b)
