"""The tables of an export are made once, whichever of its counts read them."""

import shutil

import duckdb

from traceloom.plans.catalog import load

SMALL = "/root/testdata/sf0.001"


def test_evidence_and_edges_are_dealt_once(spark):
    """Before, evidence was joined and dealt once for its count and once more for its sources; edges were folded twice."""
    counts = load()[0]["graph_export"](spark, SMALL)
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    assert sum("hashpartitioning(evidence_id" in x for x in dealt) == 1
    assert sum("hashpartitioning(edge_id" in x for x in dealt) == 1


def test_ends_that_are_null(spark, tmp_path):
    queries, oracles = load()
    shutil.copy(f"{SMALL}/orders.parquet", tmp_path)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr(
        "* EXCEPT (l_partkey)", "if(l_orderkey % 5 = 0, NULL, l_partkey) AS l_partkey")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.entity: r.n for r in queries["graph_export"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == dict(con.execute(oracles["graph_export"]).fetchall())
