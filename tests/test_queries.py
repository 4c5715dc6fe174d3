"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import threading

import duckdb
import pytest

from sparknorm import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, (bool, str)):
            return str(v)
        return round(float(v), 4) if isinstance(v, (int, float)) or hasattr(v, "__float__") else str(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, db, name):
    mine, other = queries.QUERIES[name](spark, DIR).toPandas(), db.execute(queries.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    a, b = rows(mine), rows(other)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-4))


@pytest.mark.parametrize("name", ["graph_paths", "signal_features"])
def test_without_sql(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def edge_tables(spark, path, customers, suppliers):
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_nationkey int, s_acctbal double").write.parquet(f"{path}/supplier.parquet")


def test_clean_edges_of_odd_rows(spark, tmp_path):
    """Nulls, no numbers, loops, negative keys and nations on one side only, as in the SQL."""
    customers = [(k, k % 6) for k in range(-40, 40)] + [(None, 1), (5, None), (3, 99)]
    suppliers = [(g, float(v)) for g in range(1, 6) for v in (g * 700, g * 900, 100)]
    suppliers += [(0, None), (0, None), (1, None), (2, math.nan), (3, math.inf), (4, -math.inf), (None, 5.0), (98, 5.0)]
    edge_tables(spark, tmp_path, customers, suppliers)
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES["clean_edges"](spark, str(tmp_path)).toPandas()
    assert set(got["w"]) > {0.0, 1.0} and rows(got) == rows(con.execute(queries.ORACLES["clean_edges"]).df())


def test_clean_edges_of_one_large_nation(spark, tmp_path):
    """4e11 pairs of a customer and a supplier, which a minute does not hold."""
    spark.range(2_000_000).selectExpr("id AS c_custkey", "3 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(200_000).selectExpr("3 AS s_nationkey", "CAST(if(id % 4 < 3, id % 4 * 1000, NULL) AS DOUBLE) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sparkContext.setJobGroup("edges", "clean_edges", interruptOnCancel=True)
    late = threading.Timer(60, spark.sparkContext.cancelJobGroup, ["edges"])
    late.start()
    try:
        got = queries.QUERIES["clean_edges"](spark, str(tmp_path)).collect()
    finally:
        late.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == [(3, min(b, 3), max(b, 3), 0.2) for b in (0, 1, 2, 4, 5, 6)]
