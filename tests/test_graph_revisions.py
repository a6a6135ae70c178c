"""Walks, bills of materials, revisions, mutation batches and scenario edits."""

import random

import pytest

from traceloom.operators import revisions as rv
from traceloom.operators import traverse as tr


def test_levels_take_the_shortest_path_and_survive_cycles(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(70)} | {(1, 0), (2, 1), (1, 2), (40, 41)}
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source_node_id string, target_node_id string")
    got = {r.id: r.tier for r in tr.levels(edges, spark.createDataFrame([("0",)], "id string")).collect()}
    want, queue = {"0": 0}, ["0"]
    while queue:
        parent = queue.pop(0)
        for a, b in pairs:
            if str(b) == parent and str(a) not in want:
                want[str(a)] = want[parent] + 1
                queue.append(str(a))
    assert got == want and "40" not in got


def test_parent_faults(spark):
    items = [(i, i - 1) for i in range(1, 40)] + [(0, None), (100, 101), (101, 102), (102, 100), (103, 100), (200, 999), (201, 200), (300, 300)]
    out = tr.parent_faults(spark.createDataFrame(items, "id int, parent_id int"))
    assert {(r.id, r.fault) for r in out.collect()} == {(100, "cycle"), (101, "cycle"), (102, "cycle"), (103, "cycle"), (200, "dangling"), (201, "dangling"), (300, "cycle")}


def test_bom_scope_rule(spark):
    nodes = spark.createDataFrame([("p", "product", "P"), ("a", "component", "A"), ("b", "component", "B"), ("c", "material", "C"), ("d", "component", "D"), ("o", "organization", "O")], "id string, kind string, label string")
    edges = spark.createDataFrame(
        [
            ("e1", "a", "p", "PART_OF", "product", "p", "directly_supported", 2.0, "ea", True),
            ("e2", "b", "p", "PART_OF", "generic", None, "directly_supported", None, None, False),
            ("e3", "c", "a", "INPUT_TO", "generic", None, "weakly_inferred", 1.0, "g", False),
            ("e4", "d", "b", "PART_OF", "generic", None, "directly_supported", None, None, False),
            ("e5", "o", "a", "MANUFACTURES", "generic", None, "directly_supported", None, None, False),
            ("e6", "d", "a", "PART_OF", "company", None, "directly_supported", None, None, False),
            ("e7", "d", "a", "PART_OF", "product", "other", "directly_supported", None, None, False),
        ],
        "edge_id string, source_node_id string, target_node_id string, predicate string, scope_type string, scope_product_id string, support_label string, quantity double, unit string, operational_provenance boolean",
    )
    rows = tr.bom_view(edges, nodes, "p")
    got = [(r.edge_id, r.tier, r.quantity_support_label) for r in tr.bom_order(rows).collect()]
    assert got == [("e1", 1, "user_asserted"), ("e3", 2, "weakly_inferred")]
    assert tr.bom_coverage(rows).first().coverage_pct == 50.0
    assert tr.bom_coverage(rows.where("false")).first().coverage_pct == 0.0
    assert [r.name for r in tr.bom_filter(rows, "material", "c").collect()] == ["C"]


def test_diff_and_events(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("c", None)], "id string, v int")
    changes = rv.diff(before, after, ["id"])
    assert {tuple(r) for r in changes.collect()} == {("b", "changed"), ("d", "added")}
    gone = rv.diff(after, before, ["id"])
    assert ("d", "removed") in {tuple(r) for r in gone.collect()}
    events = {(r.id, r.type) for r in rv.change_events(changes, gone).collect()}
    assert events == {("b", "node.updated"), ("d", "node.added"), ("b", "edge.updated")}


def test_cursor_is_bound_to_its_scope():
    scope = rv.scope_digest("w", "run", None, None)
    cursor = rv.encode_cursor(scope, "2026-01-01", "id1")
    assert rv.decode_cursor(cursor, scope) == ("2026-01-01", "id1")
    for bad in (cursor[:-6], "!!", rv.encode_cursor(scope, 1, "x")):
        with pytest.raises(ValueError):
            rv.decode_cursor(bad, scope)
    with pytest.raises(ValueError):
        rv.decode_cursor(cursor, rv.scope_digest("w", "graph", None, None))


def test_pages_cover_everything_once(spark):
    rows = spark.createDataFrame([(f"2026-01-{i % 5 + 1:02d}", f"id{i:02d}") for i in range(23)], "created_at string, id string")
    seen, after = [], None
    while True:
        page = rv.keyset_page(rows, 5, after).collect()
        seen += page[:5]
        if len(page) <= 5:
            break
        after = (page[4].created_at, page[4].id)
    assert len(seen) == 23 and seen == sorted(seen, reverse=True)


OPS = "graph_id string, seq long, op string, temp_id string, target_id string, source_id string, object_id string, predicate string, kind string, label string, fields array<string>"


def op(graph, seq, name, **k):
    return (graph, seq, name, *[k.get(c) for c in ("temp_id", "target_id", "source_id", "object_id", "predicate", "kind", "label", "fields")])


BAD = {
    "temp twice": ([("add_node", dict(temp_id="t", kind="component", label="x")), ("add_node", dict(temp_id="t", kind="component", label="y"))], "temp_id_reused"),
    "edge before node": ([("add_edge", dict(source_id="t", object_id="a", predicate="PART_OF")), ("add_node", dict(temp_id="t", kind="component", label="x"))], "endpoint_missing"),
    "self": ([("add_edge", dict(source_id="a", object_id="a", predicate="PART_OF"))], "self_relation"),
    "no place": ([("add_edge", dict(source_id="a", object_id="root", predicate="LOCATED_IN"))], "not_a_place"),
    "root": ([("remove_node", dict(target_id="root"))], "root_removed"),
    "in use": ([("remove_node", dict(target_id="a"))], "has_relations"),
    "identity": ([("update_node", dict(target_id="a", label="z", fields=["label"]))], "evidence_identity"),
    "tier": ([("update_node", dict(target_id="b", fields=["tier"]))], "immutable_field"),
    "edge twice": ([("remove_edge", dict(target_id="e1")), ("remove_edge", dict(target_id="e1"))], "target_missing"),
    "edge label": ([("update_edge", dict(target_id="e1", fields=["support_label"]))], "immutable_field"),
    "lost note": ([("annotate", dict(target_id="zz"))], "target_missing"),
}
GOOD = [
    ("add_node", dict(temp_id="t", kind="component", label="New")),
    ("add_edge", dict(source_id="t", object_id="root", predicate="PART_OF")),
    ("remove_edge", dict(target_id="e1")),
    ("remove_node", dict(target_id="a")),
    ("update_node", dict(target_id="b", label="B2", fields=["label"])),
    ("update_node", dict(target_id="b", fields=["data"])),
    ("annotate", dict(target_id="t")),
]


def test_mutation_batches(spark):
    cases = {**{n: ops for n, (ops, _) in BAD.items()}, "good": GOOD, "stale": []}
    ops = spark.createDataFrame([op(n, i, name, **k) for n, steps in cases.items() for i, (name, k) in enumerate(steps)], OPS)
    graphs = list(cases)
    nodes = spark.createDataFrame([(g, i, k, i.upper()) for g in graphs for i, k in (("root", "product"), ("a", "component"), ("b", "component"))], "graph_id string, id string, kind string, label string")
    edges = spark.createDataFrame([(g, "e1", "a", "root", "PART_OF") for g in graphs], "graph_id string, id string, source_node_id string, target_node_id string, predicate string")
    roots = spark.createDataFrame([(g, "root") for g in graphs], "graph_id string, root_id string")
    proven = spark.createDataFrame([(g, "a") for g in graphs], "graph_id string, id string")
    expected = spark.createDataFrame([(g, 4, 3 if g == "stale" else 4) for g in graphs], "graph_id string, revision int, expected_revision int")
    n, e, rejected = rv.apply_mutations(ops, nodes, edges, roots, proven, expected)
    reasons = {r.graph_id: r.reason for r in rejected.collect()}
    assert reasons == {**{name: reason for name, (_, reason) in BAD.items()}, "stale": "revision_conflict"}
    good = {r.label for r in n.where("graph_id = 'good'").collect()}
    assert good == {"ROOT", "B2", "New"}
    kept = e.where("graph_id = 'good'").collect()
    assert len(kept) == 1 and kept[0].target_node_id == "root" and kept[0].source_node_id.startswith("nd_")
    assert n.where("graph_id = 'in use'").count() == 3


def test_scenario_edits(spark):
    schema = "graph_id string, id string, kind string, label string, aliases array<string>, mpn string, manufacturer string, status string"
    nodes = spark.createDataFrame([("s", i, k, lab, [], None, None, "directly_supported") for i, k, lab in (("root", "product", "Board"), ("a", "component", "RP1"), ("b", "component", "PMIC"), ("o", "organization", "Acme"))], schema)
    edges = spark.createDataFrame([("s", "a", "root", "PART_OF", "product", "directly_supported"), ("s", "b", "root", "PART_OF", "product", "directly_supported"), ("s", "o", "a", "PRODUCES", "generic", "directly_supported")], "graph_id string, source_node_id string, target_node_id string, predicate string, scope_type string, support_label string")
    roots = spark.createDataFrame([("s", "root")], "graph_id string, root_id string")
    edits = spark.createDataFrame(
        [
            ("s", 1, "replace_node", "rp1", None, "Acme Alternative", None, None, None, None),
            ("s", 2, "add_edge", "Widget Foundry", "organization", None, None, "acme alternative", None, "SUPPLIES"),
            ("s", 3, "remove_edge", "PMIC", None, None, None, "Board", None, None),
            ("s", 4, "remove_node", "Board", None, None, None, None, None, None),
            ("s", 5, "add_node", "Loose", None, None, None, None, None, None),
            ("s", 6, "remove_edge", "PMIC", None, None, None, "Board", None, None),
            ("s", 7, "remove_node", "PMIC", None, None, None, None, None, None),
        ],
        "graph_id string, seq long, op string, label string, kind string, new_label string, new_kind string, object_label string, object_kind string, predicate string",
    )
    n, e, results = rv.apply_edits(nodes, edges, edits, roots)
    labels = {r.label: r for r in n.collect()}
    assert set(labels) == {"Board", "Acme Alternative", "Acme", "Widget Foundry"}
    assert labels["Acme Alternative"].status == "user_asserted" and labels["Acme Alternative"].kind == "component"
    swapped = labels["Acme Alternative"].id
    links = {(r.source_node_id, r.target_node_id, r.predicate, r.support_label) for r in e.collect()}
    assert links == {(swapped, "root", "PART_OF", "user_asserted"), ("o", swapped, "PRODUCES", "user_asserted"), (labels["Widget Foundry"].id, swapped, "SUPPLIES", "user_asserted")}
    skipped = {r.seq: r.reason for r in results.collect() if r.reason}
    assert skipped == {4: "node_unknown_or_root", 5: "kind_missing", 6: "edge_unknown"}
    assert nodes.count() == 4 and edges.count() == 3


def test_revisions(spark, tmp_path):
    from traceloom.sources.sinks import save_revision

    rows = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 2, "b"), ("h", 1, "z")], "graph_id string, revision int, id string")
    save_revision(rows, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert sorted(r.id for r in rv.at_revision(stored, "g").collect()) == ["a", "b"]
    assert [r.id for r in rv.at_revision(stored, "g", 1).collect()] == ["a"] and rv.at_revision(stored, "g", 9).count() == 0
    copy = rv.fork(rv.at_revision(rows, "g"), "s").collect()
    assert {(r.graph_id, r.revision, r.parent_graph_id, r.forked_from_revision) for r in copy} == {("s", 0, "g", 2)}
    meta = spark.createDataFrame([("s", 3, "g")], "graph_id string, revision int, parent_graph_id string")
    back = rv.reset(meta, rows).collect()
    assert {(r.graph_id, r.revision, r.id) for r in back} == {("s", 4, "a"), ("s", 4, "b")}
    index = spark.createDataFrame([("r1", 1, "x"), ("r1", 2, "y"), ("r2", 1, "z")], "run_id string, generated_at int, path string")
    assert {(r.run_id, r.path) for r in rv.export_index(index).collect()} == {("r1", "y"), ("r2", "z")}


def test_branches_and_depth(spark):
    nodes = spark.createDataFrame([("r", "product", 0), ("a", "component", 1), ("b", "component", 2), ("o", "organization", None), ("x", "organization", None), ("t", "geography", None)], "id string, kind string, tier int")
    edges = spark.createDataFrame([("a", "r", "PART_OF"), ("b", "a", "PART_OF"), ("o", "b", "OPERATES"), ("x", "t", "LOCATED_IN")], "source_node_id string, target_node_id string, predicate string")
    depth = {r.id: (r.depth, r.nearest_id) for r in tr.research_depth(nodes, edges).collect()}
    assert depth["o"] == (3, "b") and depth["x"] == (None, None) and depth["b"] == (2, None) and depth["t"] == (None, None)
    own = {r.id: r.branch_id for r in tr.branches(nodes, edges, nodes.where("id = 'r'").select("id")).collect()}
    assert own == {"r": "root", "a": "a", "b": "a"}
