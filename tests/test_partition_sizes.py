"""Partitions follow the size of the data and not a number fixed by the session."""

import re

from traceloom.session import tune


def test_shuffles_start_with_many_partitions(spark):
    """Before, a session of 4 shuffle partitions held a fourth of any table in one task."""
    plan = tune(spark).range(100).repartition("id")._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(id#\d+L, (\d+)\)", plan).group(1)) >= 400
    assert len(spark.range(100).repartition("id").collect()) == 100
