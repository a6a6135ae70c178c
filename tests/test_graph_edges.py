"""A graph query folds its edges once, and a least neighbour needs no distinct ones."""

from traceloom.operators import traverse as tr
from traceloom.plans import graph as pl

SF = "/root/testdata/sf0.001"


def test_edges_are_folded_once(spark, monkeypatch):
    """Before, the walk and every later step folded the line items again."""
    asked = []
    real = pl.lens

    def counting(session, sf, name):
        asked.append(name)
        return real(session, sf, name)

    monkeypatch.setattr(pl, "lens", counting)
    depth = pl.research_depth(spark, SF)
    assert asked.count("edge") == 1
    assert "lineitem" not in " ".join(depth.inputFiles())
    assert depth.where("depth is not null").count() > 0


def test_depth_with_repeated_edges(rows):
    nodes = rows([("p", "product", 0), ("c", "component", 1), ("o", "organization", None), ("x", "organization", None), ("g", "geography", None)],
                 "id string, kind string, tier int")
    edges = rows([("c", "p"), ("c", "p"), ("o", "c"), ("o", "c"), ("o", "o"), ("o", "g"), ("x", "o")], "source_node_id string, target_node_id string")
    out = tr.research_depth(nodes, edges)
    assert rows.of(out, "id", "depth", "nearest_id") == sorted(
        [("p", 0, None), ("c", 1, None), ("o", 2, "c"), ("x", None, None), ("g", None, None)], key=repr)
