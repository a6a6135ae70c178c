"""Where intermediate tables go."""

import pytest

from traceloom.session import materialize, shared_folder, spread, tune


def test_intermediate_tables_use_the_shared_folder(spark):
    out = materialize(spark.range(5).withColumnRenamed("id", "n"))
    assert sorted(r.n for r in out.collect()) == [0, 1, 2, 3, 4]
    assert all(shared_folder(spark).removeprefix("file:") in f for f in out.inputFiles())


def test_a_cluster_session_must_name_the_folder(spark, monkeypatch):
    context = type(spark.sparkContext)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(context, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_folder(spark)


def test_materialize_keeps_schema_when_empty(spark):
    df = spark.sql("select cast(null as timestamp_ntz) as t, array(struct('a' as x)) as s").where("false")
    out = materialize(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert out.isEmpty()


def test_spread_leaves_wide_tables_alone(spark):
    wide = spark.range(0, 100, 1, spark.sparkContext.defaultParallelism + 3)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_well_compressed_table_is_not_broadcast(spark):
    rows = spark.range(400_000).selectExpr("id", "repeat('a long label ', 20) as label")
    out = materialize(rows).join(tune(spark).range(2_000_000), "id").groupBy("label").count()
    assert [r["count"] for r in out.collect()] == [400_000]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
