"""Queries over revisions, mutations, scenario edits, exports and pages."""

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import mutations as mu
from ..operators import revisions as rv
from .catalog import query
from .evidence import label_sql
from .lens import duck, frame, lens, table

BEFORE = "observed_at < '1999-01-01'"
AFTER = "observed_at >= '1996-01-01'"
DIFF_SQL = f"""WITH c AS ({duck("claim")}), b AS ({label_sql("SELECT * FROM c WHERE " + BEFORE, "subject_id, object_id")}),
 a AS ({label_sql("SELECT * FROM c WHERE " + AFTER, "subject_id, object_id")}),
 d AS (SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.object_id, b.object_id) AS object_id,
 CASE WHEN b.subject_id IS NULL THEN 'added' WHEN a.subject_id IS NULL THEN 'removed' WHEN a.support_label <> b.support_label THEN 'changed' END AS change
 FROM a FULL JOIN b ON a.subject_id = b.subject_id AND a.object_id = b.object_id)"""


def edge_diff(spark, sf):
    claims = lens(spark, sf, "claim")
    keys = ["subject_id", "object_id"]
    before = ev.edge_support_labels(claims.where(BEFORE), keys)
    after = ev.edge_support_labels(claims.where(AFTER), keys)
    return rv.diff(before, after, keys)


@query("graph_diff", f"{DIFF_SQL} SELECT * FROM d WHERE change IS NOT NULL")
def graph_diff(spark, sf):
    return edge_diff(spark, sf)


@query(
    "change_events",
    f"""{DIFF_SQL} SELECT concat(CAST(subject_id AS STRING), '>', CAST(object_id AS STRING)) AS id, CASE change WHEN 'added' THEN 'edge.added' ELSE 'edge.updated' END AS type FROM d WHERE change IN ('added', 'changed')
 UNION ALL SELECT CAST(p_partkey AS STRING), 'node.added' FROM part WHERE p_size > 25""",
)
def change_events(spark, sf):
    pair = F.concat(F.col("subject_id").cast("string"), F.lit(">"), F.col("object_id").cast("string"))
    edges = edge_diff(spark, sf).select(pair.alias("id"), "change")
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_size")
    nodes = rv.diff(parts.where("p_size <= 25"), parts, ["id"])
    return rv.change_events(nodes, edges).select("id", "type")


# a graph per brand; parts of even size exist since revision 1, the others since revision 2
SNAPSHOTS = """SELECT p_brand AS graph_id, CAST(1 AS BIGINT) AS revision, p_partkey AS id, p_name AS label FROM {part} WHERE p_size % 2 = 0
UNION ALL SELECT p_brand, 2, p_partkey, p_name FROM {part} WHERE p_brand <> 'Brand#7'"""


@query(
    "fork",
    f"""WITH s AS ({duck(SNAPSHOTS)}), l AS (SELECT graph_id, max(revision) AS revision FROM s GROUP BY ALL)
SELECT 'scenario of ' || s.graph_id AS graph_id, 0::BIGINT AS revision, s.graph_id AS parent_graph_id, s.revision AS forked_from_revision, id, label FROM s JOIN l USING (graph_id, revision)""",
)
def fork(spark, sf):
    latest = rv.latest_revisions(frame(spark, sf, SNAPSHOTS))
    return rv.fork(latest, F.concat(F.lit("scenario of "), F.col("graph_id")))


@query(
    "reset",
    f"""WITH s AS ({duck(SNAPSHOTS)}), l AS (SELECT graph_id, max(revision) AS revision FROM s GROUP BY ALL), m AS (SELECT DISTINCT graph_id FROM s)
SELECT 'sc ' || m.graph_id AS graph_id, 6::BIGINT AS revision, s.revision AS forked_from_revision, s.id, s.label FROM m JOIN l USING (graph_id) JOIN s USING (graph_id, revision)""",
)
def reset(spark, sf):
    base = frame(spark, sf, SNAPSHOTS)
    meta = base.select(
        F.concat(F.lit("sc "), "graph_id").alias("graph_id"),
        F.lit(5).cast("long").alias("revision"),
        F.col("graph_id").alias("parent_graph_id"),
    ).distinct()
    return rv.reset(meta, base)


@query(
    "time_travel",
    f"SELECT * FROM ({duck(SNAPSHOTS)}) WHERE (graph_id = 'Brand#3' AND revision = 1) OR (graph_id = 'Brand#7' AND revision = 1)",
)
def time_travel(spark, sf):
    rows = frame(spark, sf, SNAPSHOTS)
    return rv.at_revision(rows, "Brand#3", 1).union(rv.at_revision(rows, "Brand#7").select(*rows.columns))


@query(
    "keyset_page",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderkey AS id, o_totalprice FROM orders
 WHERE o_orderdate < '1997-06-01' OR (o_orderdate = '1997-06-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
)
def keyset_page(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderkey").alias("id"), "o_totalprice"
    )
    return rv.keyset_page(rows, 50, ("1997-06-01", 500))


@query(
    "replay_events",
    """SELECT p_brand AS id, CASE p_brand WHEN 'Brand#1' THEN 'node.updated' ELSE 'node.added' END AS type, CASE p_brand WHEN 'Brand#1' THEN 0 ELSE 1 END AS what_order FROM (SELECT DISTINCT p_brand FROM part)
 UNION ALL SELECT 'e' || p_partkey, 'edge.added', 2 FROM part""",
)
def replay_events(spark, sf):
    part = table(spark, sf, "part")
    nodes = part.select(F.col("p_brand").alias("id")).distinct()
    edges = part.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"))
    return rv.replay_events(nodes, edges, "Brand#1")


@query(
    "graph_export",
    f"""WITH c AS (SELECT * FROM ({duck("claim")})), s AS (SELECT DISTINCT source_id FROM ({duck("source")}))
SELECT 'claim' AS entity, count(*) AS n FROM c UNION ALL SELECT 'evidence', count(DISTINCT claim_id) FROM c
UNION ALL SELECT 'source', count(DISTINCT source_id) FROM c SEMI JOIN s USING (source_id) UNION ALL SELECT 'edge', count(DISTINCT (subject_id, object_id)) FROM c""",
)
def graph_export(spark, sf):
    claims = lens(spark, sf, "claim")
    # never NULL: an end that is NULL is an end as in the SQL, and the join needs no edges of its own without NULLs
    end = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    pair = F.concat(end("subject_id"), F.lit(">"), end("object_id"))
    links = claims.select(pair.alias("edge_id"), "claim_id", "object_id")
    edges = links.select("edge_id").distinct()
    evidence = claims.select(F.concat(F.lit("ev"), "claim_id").alias("evidence_id"), "claim_id", "source_id")
    out = rv.graph_export(edges, links, claims, evidence, lens(spark, sf, "source"))
    names = {"edges": "edge", "claims": "claim", "evidence": "evidence", "sources": "source"}
    counts = None
    for name, df in out.items():
        rows = df.select(F.lit(1).cast("long").alias("n"))
        if name == "evidence":  # by source, so that it reads the rows that the sources read, and they are made once
            rows = df.groupBy("source_id").agg(F.count("*").alias("n"))
        row = rows.agg(F.lit(names[name]).alias("entity"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
        counts = row if counts is None else counts.union(row)
    return counts


# a graph per brand: the brand is the root, its parts hang below it
BRAND_NODES = """SELECT p_brand AS graph_id, concat('pt:', CAST(p_partkey AS STRING)) AS id, 'component' AS kind, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS label FROM {part}
UNION ALL SELECT DISTINCT p_brand, 'root', 'product', p_brand FROM {part}"""
BRAND_EDGES = "SELECT p_brand AS graph_id, concat('e:', CAST(p_partkey AS STRING)) AS id, concat('pt:', CAST(p_partkey AS STRING)) AS source_node_id, 'root' AS target_node_id, 'PART_OF' AS predicate FROM {part}"
# parts of size 1 are removed with their edge; size 2 get a new maker; size 3 are relabelled; in
# three brands one operation is invalid, which voids the batch
NO = "CAST(NULL AS STRING)"
OPS = f"""SELECT p_brand AS graph_id, p_partkey * 10 AS seq, 'remove_edge' AS op, {NO} AS temp_id, concat('e:', CAST(p_partkey AS STRING)) AS target_id, {NO} AS source_id, {NO} AS object_id, {NO} AS predicate, {NO} AS kind, {NO} AS label FROM {{part}} WHERE p_size = 1
UNION ALL SELECT p_brand, p_partkey * 10 + CASE WHEN p_brand = 'Brand#2' THEN -1 ELSE 1 END, 'remove_node', {NO}, concat('pt:', CAST(p_partkey AS STRING)), {NO}, {NO}, {NO}, {NO}, {NO} FROM {{part}} WHERE p_size = 1
UNION ALL SELECT p_brand, p_partkey * 10, 'add_node', concat('t', CAST(p_partkey AS STRING)), {NO}, {NO}, {NO}, {NO}, 'organization', concat('Maker ', CAST(p_partkey AS STRING)) FROM {{part}} WHERE p_size = 2
UNION ALL SELECT p_brand, p_partkey * 10 + CASE WHEN p_brand = 'Brand#4' THEN -1 ELSE 1 END, 'add_edge', {NO}, {NO}, concat('t', CAST(p_partkey AS STRING)), concat('pt:', CAST(p_partkey AS STRING)), 'MANUFACTURES', {NO}, {NO} FROM {{part}} WHERE p_size = 2
UNION ALL SELECT p_brand, p_partkey * 10, 'update_node', {NO}, CASE WHEN p_brand = 'Brand#6' THEN 'missing' ELSE concat('pt:', CAST(p_partkey AS STRING)) END, {NO}, {NO}, {NO}, {NO}, concat('Renamed ', CAST(p_partkey AS STRING)) FROM {{part}} WHERE p_size = 3"""


@query(
    "mutation_batch",
    """WITH b AS (SELECT p_brand AS graph_id, count(*) AS parts, count(*) FILTER (p_size = 1) AS gone, count(*) FILTER (p_size = 2) AS made, count(*) FILTER (p_size = 3) AS renamed,
 CASE WHEN p_brand = 'Brand#2' AND bool_or(p_size = 1) THEN 'has_relations' WHEN p_brand = 'Brand#4' AND bool_or(p_size = 2) THEN 'endpoint_missing' WHEN p_brand = 'Brand#6' AND bool_or(p_size = 3) THEN 'target_missing' END AS reason FROM part GROUP BY p_brand)
SELECT graph_id, reason, CASE WHEN reason IS NULL THEN parts + 1 - gone + made ELSE parts + 1 END AS nodes, CASE WHEN reason IS NULL THEN parts - gone + made ELSE parts END AS edges,
 CASE WHEN reason IS NULL THEN renamed ELSE 0 END AS renamed FROM b""",
)
def mutation_batch(spark, sf):
    nodes, edges = frame(spark, sf, BRAND_NODES), frame(spark, sf, BRAND_EDGES)
    ops = frame(spark, sf, OPS).withColumn(
        "fields", F.when(F.col("op") == "update_node", F.array(F.lit("label")))
    )
    graphs = nodes.select("graph_id").distinct()
    roots = graphs.withColumn("root_id", F.lit("root"))
    expected = graphs.withColumn("revision", F.lit(4)).withColumn("expected_revision", F.lit(4))
    none = nodes.where("id = 'none'").select("graph_id", "id")
    nodes, edges, rejected = rv.apply_mutations(ops, nodes, edges, roots, none, expected)
    n = nodes.groupBy("graph_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("label").startswith("Renamed")).alias("renamed")
    )
    e = edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    return n.join(e, "graph_id").join(rejected.select("graph_id", "reason"), "graph_id", "left")


# a graph per brand again, with every kind of operation on parts by their key; brand 2 has one bad operation
PATCH_NODES = """SELECT p_brand AS graph_id, concat('pt:', CAST(p_partkey AS STRING)) AS id, 'component' AS kind, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS label,
 'user_asserted' AS status, p_type AS container FROM {part} UNION ALL SELECT DISTINCT p_brand, 'root', 'product', p_brand, 'directly_supported', 'none' FROM {part}"""
PATCH_EDGES = """SELECT p_brand AS graph_id, concat('e:', CAST(p_partkey AS STRING)) AS id, concat('pt:', CAST(p_partkey AS STRING)) AS source_node_id, 'root' AS target_node_id,
 'PART_OF' AS predicate, 'generic' AS scope_type, CASE WHEN p_partkey % 16 = 6 THEN 'unresolved' ELSE 'weakly_inferred' END AS support_label, p_size AS size FROM {part}"""
OP_SCHEMA = "seq long, op string, temp_id string, target_id string, source_id string, object_id string, predicate string, kind string, scope_type string, note_key string, note_value string, patch map<string,string>"


def brand_ops(spark, sf, build):
    """Operations on each part: `build` maps key, node id and edge id columns to an array of op structs."""
    part = table(spark, sf, "part").select(F.col("p_brand").alias("graph_id"), F.col("p_partkey").alias("k"), "p_size")
    key = F.col("k").cast("string")
    ops = part.withColumn("node", F.concat(F.lit("pt:"), key)).withColumn("edge", F.concat(F.lit("e:"), key)).withColumn("key", key)
    made = ops.select("graph_id", F.explode(build).alias("o"))
    return made.select("graph_id", "o.*")


def op_struct(step, name, **fields):
    """One op of `OP_SCHEMA` at ten times the key plus `step`; values are SQL expressions."""
    columns = {"seq": f"k * 10 + {step}", "op": f"'{name}'", **fields}
    kinds = [field.split(" ", 1) for field in OP_SCHEMA.split(", ")]
    return "named_struct(" + ", ".join(f"'{c}', CAST({columns.get(c, 'NULL')} AS {kind})" for c, kind in kinds) + ")"


def case_by(modulus, cases):
    none = F.expr("CAST(array() AS array<struct<" + ",".join(f.replace(" ", ":", 1) for f in OP_SCHEMA.split(", ")) + ">>)")
    chosen = F.when(F.lit(False), none)
    for rest, steps in cases.items():
        chosen = chosen.when(F.col("k") % modulus == rest, F.expr(f"array({', '.join(steps)})"))
    return chosen.otherwise(none)


GOOD_OPS = {
    0: [op_struct(0, "update_node", target_id="node", patch="""map('label', concat('"Renamed ', key, '"'), 'data.operational.quantity', CAST(p_size AS STRING), 'data.operational.unit', '"ea"')""")],
    1: [op_struct(0, "update_node", target_id="node", patch="""map('label', '"First"', 'aliases', '["old"]', 'external_ids.mpn', '"A"', 'data.operational.weight', '0.5')"""),
        op_struct(1, "update_node", target_id="node", patch="""map('label', concat('"Second ', key, '"'), 'external_ids.mpn', concat('"M', key, '"'), 'external_ids.sku', '"S"', 'data.operational', CAST(NULL AS STRING))"""),
        op_struct(2, "update_node", target_id="node", patch="map('data.operational.lead_time_days', '7')")],
    2: [op_struct(0, "remove_edge", target_id="edge"), op_struct(1, "remove_node", target_id="node")],
    3: [op_struct(0, "add_node", temp_id="concat('t', key)", kind="'organization'", patch="""map('label', concat('"Maker ', key, '"'), 'canonical_name', '"maker"')"""),
        op_struct(1, "add_edge", source_id="concat('t', key)", object_id="node", predicate="'PRODUCES'", scope_type="'generic'", patch="map('data.custom.lot', '12')"),
        op_struct(2, "add_edge", source_id="concat('t', key)", object_id="node", predicate="'PRODUCES'", scope_type="'product'"),
        op_struct(3, "annotate", target_id="concat('t', key)", note_key="'note'", note_value="""concat('"by ', key, '"')""")],
    4: [op_struct(0, "update_edge", target_id="edge", patch="map('data.operational.quantity', '2.5')"),
        op_struct(1, "annotate", target_id="edge", note_key="'note'", note_value="'1'"), op_struct(2, "annotate", target_id="edge", note_key="'note'", note_value="'[2]'")],
    5: [op_struct(0, "annotate", target_id="node", note_key="'note'", note_value="""'"checked"'""")],
    6: [op_struct(0, "add_edge", source_id="node", object_id="'root'", predicate="'PART_OF'", scope_type="'product'", patch="map('data.custom.lot', '12')")],
    7: [op_struct(0, "add_node", temp_id="concat('u', key)", kind="'facility'", patch="""map('label', '"Gone"')"""), op_struct(1, "remove_node", target_id="concat('u', key)"),
        op_struct(2, "remove_edge", target_id="edge"), op_struct(3, "add_edge", source_id="node", object_id="'root'", predicate="'PART_OF'", scope_type="'product'")],
}


def brand_mutation(spark, sf):
    nodes, edges = frame(spark, sf, PATCH_NODES), frame(spark, sf, PATCH_EDGES)
    ops = brand_ops(spark, sf, case_by(8, GOOD_OPS))
    late = F.when((F.col("graph_id") == "Brand#2") & (F.col("op") == "remove_node"), F.lit("lost")).otherwise(F.col("target_id"))
    ops = ops.withColumn("target_id", late)
    graphs = nodes.select("graph_id").distinct()
    expected = graphs.withColumn("revision", F.lit(4)).withColumn("expected_revision", F.when(F.col("graph_id") == "Brand#3", 3).otherwise(4))
    claims = edges.select("graph_id", F.col("id").alias("edge_id"), F.col("id").alias("claim_id"), F.lit("accepted").alias("status"), "support_label")
    proven = nodes.where("id = 'none'").select("graph_id", "id")
    return mu.run_mutations(ops, nodes, edges, graphs.withColumn("root_id", F.lit("root")), proven, expected, claims)


VOID = "p_brand IN (SELECT p_brand FROM part WHERE p_brand = 'Brand#3' OR (p_brand = 'Brand#2' AND p_partkey % 8 IN (2, 7)))"
MUTATED_SQL = f"""WITH p AS (SELECT *, CASE WHEN {VOID} THEN -1 ELSE p_partkey % 8 END AS c, p_partkey::VARCHAR AS key FROM part)"""


@query(
    "mutation_nodes",
    f"""{MUTATED_SQL} SELECT p_brand AS graph_id, 'pt:' || key AS ref, 'component' AS kind, CASE c WHEN 0 THEN 'Renamed ' || key WHEN 1 THEN 'Second ' || key ELSE p_name || ' ' || key END AS label,
 'user_asserted' AS status, p_type AS container, NULL::VARCHAR AS canonical_name, CASE c WHEN 1 THEN 'old' END AS aliases, CASE c WHEN 1 THEN 'M' || key END AS mpn, CASE c WHEN 1 THEN 'S' END AS sku,
 CASE c WHEN 0 THEN p_size::DOUBLE END AS quantity, CASE c WHEN 0 THEN 'ea' END AS unit, CASE c WHEN 1 THEN 7::INT END AS lead_time_days, NULL::DOUBLE AS weight,
 CASE WHEN c IN (0, 1) THEN 'user_asserted' END AS provenance, CASE c WHEN 5 THEN '"checked"' END AS note FROM p WHERE c <> 2
UNION ALL SELECT p_brand, 'new', 'organization', 'Maker ' || key, 'user_asserted', NULL, 'maker', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '"by ' || key || '"' FROM p WHERE c = 3
UNION ALL SELECT DISTINCT p_brand, 'root', 'product', p_brand, 'directly_supported', 'none', NULL, NULL, NULL, NULL, NULL::DOUBLE, NULL, NULL::INT, NULL::DOUBLE, NULL, NULL FROM p""",
)
def mutation_nodes(spark, sf):
    """Every node after the batches, patched fields and all."""
    return brand_mutation(spark, sf).nodes.select(
        "graph_id", F.when(F.startswith("id", F.lit("nd_")), "new").otherwise(F.col("id")).alias("ref"), "kind", "label", "status", "container",
        "canonical_name", F.array_join("aliases", ",").alias("aliases"), F.col("external_ids.mpn").alias("mpn"), F.col("external_ids.sku").alias("sku"),
        "operational.quantity", "operational.unit", "operational.lead_time_days", "operational.weight",
        F.col("custom.operational_provenance.support_label").alias("provenance"), F.col("custom.note.value").alias("note"))


@query(
    "mutation_edges",
    f"""{MUTATED_SQL} SELECT p_brand AS graph_id, CASE c WHEN 7 THEN 'new' ELSE 'e:' || key END AS ref, 'pt:' || key AS subject, 'root' AS object, 'PART_OF' AS predicate,
 CASE WHEN c IN (6, 7) THEN 'product' ELSE 'generic' END AS scope_type, CASE WHEN c IN (6, 7) THEN 'root' END AS product_node_id,
 CASE WHEN c = 7 THEN 'user_asserted' WHEN p_partkey % 16 = 6 THEN CASE c WHEN 6 THEN 'user_asserted' ELSE 'unresolved' END ELSE 'weakly_inferred' END AS support_label,
 CASE WHEN c <> 7 THEN p_size::INT END AS size, CASE WHEN c IN (6, 7) THEN 1 ELSE 0 END AS added_claims, CASE c WHEN 4 THEN 2.5::DOUBLE END AS quantity,
 CASE c WHEN 4 THEN '[2]' END AS note, NULL::VARCHAR AS lot FROM p WHERE c <> 2
UNION ALL SELECT p_brand, 'new', 'new', 'pt:' || key, 'PRODUCES', 'product', 'root', 'user_asserted', NULL, 2, NULL, NULL, '12' FROM p WHERE c = 3""",
)
def mutation_edges(spark, sf):
    """Every edge after the batches: joined, made, cut and patched."""
    made = lambda c, tag: F.when(F.startswith(c, F.lit(tag)), "new").otherwise(F.col(c))
    return brand_mutation(spark, sf).edges.select(
        "graph_id", made("id", "ed_").alias("ref"), made("source_node_id", "nd_").alias("subject"), F.col("target_node_id").alias("object"), "predicate",
        "scope_type", "product_node_id", "support_label", F.col("size").cast("int").alias("size"), F.coalesce(F.size("claim_ids"), F.lit(0)).alias("added_claims"),
        "operational.quantity", F.col("custom.note.value").alias("note"), F.col("custom.lot.value").alias("lot"))


@query(
    "mutation_outcomes",
    """WITH p AS (SELECT p_brand AS graph_id, p_partkey % 8 AS c, p_partkey * 10 AS s FROM part), n AS (
 SELECT graph_id, sum(CASE c WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 4 END)::BIGINT AS ops, min(s + 1) FILTER (c IN (2, 7)) AS lost FROM p GROUP BY ALL)
SELECT graph_id, CASE WHEN graph_id = 'Brand#3' THEN 'revision_conflict' WHEN graph_id = 'Brand#2' AND lost IS NOT NULL THEN 'target_missing' END AS reason,
 CASE WHEN graph_id = 'Brand#3' THEN 0 WHEN graph_id = 'Brand#2' THEN lost END AS seq,
 CASE WHEN graph_id <> 'Brand#3' AND (graph_id <> 'Brand#2' OR lost IS NULL) THEN 5 END AS revision, CASE WHEN graph_id <> 'Brand#3' AND (graph_id <> 'Brand#2' OR lost IS NULL) THEN ops END AS ops FROM n""",
)
def mutation_outcomes(spark, sf):
    """One row per batch: the new revision, or the first operation that voids it and why."""
    done = brand_mutation(spark, sf)
    return done.rejected.join(done.revisions, "graph_id", "full").select(
        "graph_id", "reason", "seq", F.col("revision_after").alias("revision"), "ops")


# every part breaks one rule, by its key
BAD_OPS = {
    0: [op_struct(0, "add_node", kind="'component'", patch="""map('label', '"x"', 'tier', '1')""")],
    1: [op_struct(0, "update_node", target_id="node", patch="map('status', '1')")],
    2: [op_struct(0, "update_node", target_id="node", patch="map('data.operational.weight', '1.5')")],
    3: [op_struct(0, "update_edge", target_id="edge", patch="map('data.market.price', '1')")],
    4: [op_struct(0, "rename", target_id="node")],
    5: [op_struct(0, "add_node", temp_id="concat('t', key)", kind="'material'", patch="""map('label', '"x"')"""), op_struct(1, "add_node", temp_id="concat('t', key)", kind="'material'", patch="""map('label', '"y"')""")],
    6: [op_struct(0, "add_edge", source_id="concat('late', key)", object_id="node", predicate="'INPUT_TO'", scope_type="'generic'"),
        op_struct(1, "add_node", temp_id="concat('late', key)", kind="'material'", patch="""map('label', '"x"')""")],
    7: [op_struct(0, "add_edge", source_id="node", object_id="node", predicate="'PART_OF'", scope_type="'generic'")],
    8: [op_struct(0, "add_edge", source_id="node", object_id="'root'", predicate="'LOCATED_IN'", scope_type="'generic'")],
    9: [op_struct(0, "add_edge", source_id="node", object_id="'root'", predicate="'PART_OF'", scope_type="'company'")],
    10: [op_struct(0, "add_edge", source_id="node", object_id="'root'", predicate="'MAKES'", scope_type="'generic'")],
    11: [op_struct(0, "remove_node", target_id="'root'")],
    12: [op_struct(0, "remove_edge", target_id="edge"), op_struct(1, "remove_edge", target_id="edge")],
    13: [op_struct(0, "update_node", target_id="node", patch="""map('label', '"new"')""")],
    14: [op_struct(0, "remove_node", target_id="node")],
    15: [op_struct(0, "annotate", target_id="'nowhere'", note_key="'a'", note_value="'1'")],
}


@query(
    "mutation_violations",
    """SELECT p_brand AS graph_id, p_partkey * 10 + u.step AS seq, reason FROM part JOIN (VALUES (0, 0, 'managed_field'), (1, 0, 'immutable_field'), (1, 0, 'evidence_identity'), (2, 0, 'invalid_value'), (3, 0, 'computed_layer'),
 (4, 0, 'unknown_operation'), (5, 1, 'temp_id_reused'), (6, 0, 'endpoint_missing'), (7, 0, 'self_relation'), (8, 0, 'not_a_place'), (9, 0, 'organization_missing'), (10, 0, 'invalid_value'), (11, 0, 'root_removed'), (12, 1, 'target_missing'),
 (13, 0, 'evidence_identity'), (14, 0, 'has_relations'), (15, 0, 'target_missing')) u(c, step, reason) ON p_partkey % 16 = u.c""",
)
def mutation_violations(spark, sf):
    """Every violating operation with its reason."""
    nodes, edges = frame(spark, sf, PATCH_NODES), frame(spark, sf, PATCH_EDGES)
    ops = brand_ops(spark, sf, case_by(16, BAD_OPS))
    claims = frame(spark, sf, "SELECT p_brand AS graph_id, concat('pt:', CAST(p_partkey AS STRING)) AS subject_id, 'root' AS object_id, 'directly_supported' AS support_label FROM {part} WHERE p_partkey % 16 IN (1, 13)")
    roots = nodes.select("graph_id").distinct().withColumn("root_id", F.lit("root"))
    return mu.mutation_violations(ops, nodes, edges, roots, mu.evidence_identities(claims))


# per brand: replace its first part, cut its second, add a supplier to the third, and one bad edit
FIRSTS = "SELECT p_brand AS graph_id, concat(min_by(p_name, p_partkey), ' ', CAST(min(p_partkey) AS STRING)) AS first_label, concat(max_by(p_name, p_partkey), ' ', CAST(max(p_partkey) AS STRING)) AS last_label FROM {part} GROUP BY p_brand"
EDITS = f"""SELECT graph_id, CAST(1 AS BIGINT) AS seq, 'replace_node' AS op, upper(first_label) AS label, {NO} AS kind, 'Substitute' AS new_label, {NO} AS new_kind, {NO} AS object_label, {NO} AS object_kind, {NO} AS predicate FROM ({FIRSTS}) a
UNION ALL SELECT graph_id, 2, 'remove_edge', last_label, {NO}, {NO}, {NO}, graph_id, {NO}, 'PART_OF' FROM ({FIRSTS}) b
UNION ALL SELECT graph_id, 3, 'add_edge', 'Acme Supply', 'organization', {NO}, {NO}, 'substitute', {NO}, 'SUPPLIES' FROM ({FIRSTS}) c
UNION ALL SELECT graph_id, 4, 'remove_node', first_label, {NO}, {NO}, {NO}, {NO}, {NO}, {NO} FROM ({FIRSTS}) d"""


@query(
    "scenario_replace",
    """WITH b AS (SELECT p_brand AS graph_id, count(*) AS parts FROM part GROUP BY ALL)
SELECT graph_id, parts + 2 AS nodes, parts AS edges, 2::BIGINT AS asserted, 1::BIGINT AS skipped FROM b""",
)
def scenario_replace(spark, sf):
    none = F.lit(None).cast("string")
    nodes = frame(spark, sf, BRAND_NODES).select(
        "*",
        F.array().cast("array<string>").alias("aliases"),
        none.alias("mpn"),
        none.alias("manufacturer"),
        F.lit("directly_supported").alias("status"),
    )
    edges = frame(spark, sf, BRAND_EDGES).select(
        "graph_id", "source_node_id", "target_node_id", "predicate",
        F.lit("product").alias("scope_type"), F.lit("directly_supported").alias("support_label"),
    )
    roots = nodes.select("graph_id").distinct().withColumn("root_id", F.lit("root"))
    nodes, edges, results = rv.apply_edits(nodes, edges, frame(spark, sf, EDITS), roots)
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("graph_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("support_label") == "user_asserted").alias("asserted")
    )
    s = results.groupBy("graph_id").agg(F.count("reason").alias("skipped"))
    return n.join(e, "graph_id").join(s, "graph_id")
