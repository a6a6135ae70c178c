"""Exact sums: the same bits in any order, on values that cancel and of any size."""

import math
import random
import struct
from fractions import Fraction

from traceloom.functions.exact import exact_sums


def test_sums_are_correctly_rounded(spark):
    rng = random.Random(4)
    groups = {"any": [], "cancel": [], "tiny": [5e-324] * 3 + [-1e-310, 2.5e-309], "none": [None], "zero": [0.0, -0.0, None],
              "big": [1.7e308, 1.7e308, -1.7e308], "over": [1.7e308, 1.7e308], "nan": [1.0, float("nan")], "inf": [float("inf"), 3.0],
              "both": [float("inf"), float("-inf")], "tie": [1.0, 2.0**-53], "above": [1.0, 2.0**-53, 2.0**-1000], None: [0.1] * 10}
    while len(groups["any"]) < 3000:
        x = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
        if math.isfinite(x) and abs(x) < 1e300:
            groups["any"].append(x)
    for _ in range(1500):
        x = rng.uniform(-1, 1) * 10.0 ** rng.randint(-200, 200)
        groups["cancel"] += [x, -x]
    groups["cancel"] += [3e-17, 1.0]
    rows = [(k, x) for k, own in groups.items() for x in own]
    for seed, parts in ((1, 3), (2, 7)):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "k string, x double").repartition(parts)
        got = {r.k: r.s for r in exact_sums(frame, ["k"], "x", "s").collect()}
        for k, own in groups.items():
            values = [x for x in own if x is not None]
            if k in ("nan", "both"):
                assert math.isnan(got[k])
            elif k == "over":
                assert got[k] == float("inf")
            else:
                finite = all(map(math.isfinite, values))
                want = (float(sum(map(Fraction, values))) if finite else sum(values)) if values else None
                assert got[k] == want, (k, got[k], want)


def test_graph_without_edges(spark):
    from traceloom.operators.traverse import graph_stats

    nodes = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("b", 1, 0)], "graph_id string, id int, tier int")
    edges = spark.createDataFrame([("a", "unresolved"), ("a", "unresolved"), ("a", "disputed")], "graph_id string, support_label string")
    got = {tuple(r) for r in graph_stats(nodes, edges, ["graph_id"]).collect()}
    assert got == {("a", "unresolved", 2, 2, 3, 3), ("a", "disputed", 1, 2, 3, 3), ("b", None, 0, 1, 0, 0)}
    assert [tuple(r) for r in graph_stats(nodes, edges.where("false")).collect()] == [(None, 0, 3, 3, 0)]
