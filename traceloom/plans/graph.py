"""Queries over the node and edge tables."""

from pyspark.sql import functions as F

from ..functions.exact import exact_sums
from ..operators import traverse as tr
from ..session import materialize
from .catalog import query
from .lens import LENS, duck, frame, lens, table

ROOT = "pr:root"

# parts form a tree of four children per part under one root product; suppliers produce parts,
# supply customers and sit in nations
LENS["node"] = f"""
SELECT '{ROOT}' AS id, 'product' AS kind, 'Assembled product' AS label, '' AS mpn
UNION ALL SELECT concat('pt:', CAST(p_partkey AS STRING)), CASE WHEN p_type = 'ECONOMY' THEN 'material' ELSE 'component' END,
  concat(p_name, ' p', CAST(p_partkey AS STRING)), concat('MP', CAST(p_partkey AS STRING)) FROM {{part}}
UNION ALL SELECT concat('su:', CAST(s_suppkey AS STRING)), 'organization', s_name, '' FROM {{supplier}}
UNION ALL SELECT concat('cu:', CAST(c_custkey AS STRING)), 'organization', c_name, '' FROM {{customer}}
UNION ALL SELECT concat('na:', CAST(n_nationkey AS STRING)), 'geography', n_name, '' FROM {{nation}}"""

LENS["part_edge"] = f"""
SELECT concat('e:', CAST(p_partkey AS STRING)) AS edge_id, concat('pt:', CAST(p_partkey AS STRING)) AS source_node_id,
  CASE WHEN p_partkey < 16 THEN '{ROOT}' ELSE concat('pt:', CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING)) END AS target_node_id,
  CASE WHEN p_type = 'ECONOMY' THEN 'INPUT_TO' ELSE 'PART_OF' END AS predicate,
  CASE WHEN p_partkey % 7 = 6 THEN 'company' WHEN p_partkey % 3 = 0 THEN 'generic' ELSE 'product' END AS scope_type,
  '{ROOT}' AS scope_product_id,
  CASE p_partkey % 5 WHEN 0 THEN 'directly_supported' WHEN 1 THEN 'strongly_inferred' WHEN 2 THEN 'weakly_inferred'
    WHEN 3 THEN 'user_asserted' ELSE 'disputed' END AS support_label,
  CASE WHEN p_size % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS quantity,
  'ea' AS unit, p_size > 40 AS operational_provenance
FROM {{part}}"""

LENS["edge"] = f"""
SELECT source_node_id, target_node_id, predicate, support_label FROM ({LENS["part_edge"]})
UNION ALL SELECT concat('su:', CAST(l_suppkey AS STRING)), concat('pt:', CAST(l_partkey AS STRING)), 'PRODUCES',
  CASE WHEN max(l_discount) < 0.05 THEN 'directly_supported' ELSE 'weakly_inferred' END FROM {{lineitem}} GROUP BY l_suppkey, l_partkey
UNION ALL SELECT concat('su:', CAST(l_suppkey AS STRING)), concat('cu:', CAST(o_custkey AS STRING)), 'SUPPLIES',
  CASE WHEN max(l_discount) < 0.05 THEN 'directly_supported' ELSE 'weakly_inferred' END
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey
UNION ALL SELECT concat('su:', CAST(s_suppkey AS STRING)), concat('na:', CAST(s_nationkey AS STRING)), 'LOCATED_IN', 'directly_supported' FROM {{supplier}}"""

TIERS_SQL = f"""ed AS ({duck("edge")}), nd AS ({duck("node")}),
 walk AS (SELECT '{ROOT}' AS id, 0 AS tier UNION SELECT e.source_node_id, w.tier + 1 FROM walk w JOIN ed e ON e.target_node_id = w.id
   WHERE e.predicate <> 'LOCATED_IN' AND w.tier < 40),
 tr AS (SELECT id, min(tier) AS tier FROM walk GROUP BY id),
 nt AS (SELECT nd.*, tr.tier FROM nd LEFT JOIN tr USING (id))"""


def root(spark, sf):
    return lens(spark, sf, "node").where(F.col("id") == ROOT).select("id")


def tiered_nodes(spark, sf):
    return tr.tiers(lens(spark, sf, "node"), lens(spark, sf, "edge"), root(spark, sf))


def tiered_graph(spark, sf):
    """Nodes with tiers and the edges, which are folded and written once for the walk and what follows it."""
    edges = materialize(lens(spark, sf, "edge"))
    return tr.tiers(lens(spark, sf, "node"), edges, root(spark, sf), stored=True), edges


@query("tiers", f"WITH RECURSIVE {TIERS_SQL} SELECT id, kind, tier FROM nt")
def tiers(spark, sf):
    return tiered_nodes(spark, sf).select("id", "kind", "tier")


@query(
    "graph_stats",
    f"""WITH RECURSIVE {TIERS_SQL} SELECT support_label, count(*) AS edges, (SELECT count(*) FROM nt) AS node_count,
 (SELECT max(tier) FROM nt) AS max_tier, (SELECT count(*) FROM ed) AS edge_count FROM ed GROUP BY ALL""",
)
def graph_stats(spark, sf):
    return tr.graph_stats(*tiered_graph(spark, sf))


@query(
    "graph_view_tier_max",
    f"""WITH RECURSIVE {TIERS_SQL}, k AS (SELECT id, tier FROM nt WHERE tier <= 3),
 ke AS (SELECT ed.* FROM ed WHERE source_node_id IN (SELECT id FROM k) AND target_node_id IN (SELECT id FROM k))
SELECT support_label, count(*) AS edges, (SELECT count(*) FROM k) AS node_count, (SELECT max(tier) FROM k) AS max_tier,
 (SELECT count(*) FROM ke) AS edge_count FROM ke GROUP BY ALL""",
)
def graph_view_tier_max(spark, sf):
    nodes, edges = tr.tier_view(*tiered_graph(spark, sf), 3)
    return tr.graph_stats(nodes, edges)


@query(
    "node_degree",
    f"""WITH ed AS ({duck("edge")}) SELECT id, CAST(sum(i) AS BIGINT) AS in_edges, CAST(sum(o) AS BIGINT) AS out_edges FROM
 (SELECT source_node_id AS id, 0 AS i, 1 AS o FROM ed UNION ALL SELECT target_node_id, 1, 0 FROM ed) GROUP BY ALL""",
)
def node_degree(spark, sf):
    return tr.degrees(lens(spark, sf, "edge"))


@query(
    "neighborhood",
    f"""WITH ed AS ({duck("edge")}) SELECT source_node_id AS id, target_node_id AS neighbour_id FROM ed
 UNION SELECT target_node_id, source_node_id FROM ed""",
)
def neighborhood(spark, sf):
    return tr.neighbours(lens(spark, sf, "edge"))


CLAIM_ENDS = """SELECT concat('su:', CAST(l_suppkey AS STRING)) AS subject_id,
 concat('pt:', CAST(l_partkey AS STRING)) AS object_id FROM {lineitem}"""


@query(
    "node_detail",
    f"""WITH ed AS ({duck("edge")}), nd AS ({duck("node")}), c AS ({duck(CLAIM_ENDS)}),
 d AS (SELECT id, sum(i) AS i, sum(o) AS o, sum(c) AS c FROM (SELECT source_node_id AS id, 0 AS i, 1 AS o, 0 AS c FROM ed
  UNION ALL SELECT target_node_id, 1, 0, 0 FROM ed UNION ALL SELECT subject_id, 0, 0, 1 FROM c UNION ALL SELECT object_id, 0, 0, 1 FROM c) GROUP BY ALL)
SELECT nd.id, kind, label, CAST(coalesce(i, 0) AS BIGINT) AS in_edges, CAST(coalesce(o, 0) AS BIGINT) AS out_edges, CAST(coalesce(c, 0) AS BIGINT) AS claims
FROM nd LEFT JOIN d USING (id)""",
)
def node_detail(spark, sf):
    nodes = lens(spark, sf, "node").drop("mpn")
    return tr.node_detail(nodes, lens(spark, sf, "edge"), frame(spark, sf, CLAIM_ENDS))


DETAIL_EDGES = """SELECT DISTINCT concat(CAST(l_suppkey AS STRING), '>', CAST(l_partkey AS STRING)) AS edge_id FROM {lineitem}"""


@query(
    "edge_detail",
    f"""WITH c AS ({duck("claim")}), k AS (SELECT subject_id, object_id, count(*) FILTER (support_type = 'contradicts') AS against FROM c GROUP BY ALL)
SELECT concat(CAST(subject_id AS STRING), '>', CAST(object_id AS STRING)) AS edge_id, claim_id, status, support_label, support_type, against
FROM c JOIN k USING (subject_id, object_id)""",
)
def edge_detail(spark, sf):
    claims = lens(spark, sf, "claim").select(
        "claim_id", "subject_id", "object_id", "status", "support_label", "support_type"
    )
    pair = F.concat(F.col("subject_id").cast("string"), F.lit(">"), F.col("object_id").cast("string"))
    links = claims.select(pair.alias("edge_id"), "claim_id")
    edges = links.select("edge_id").distinct()
    return tr.edge_detail(edges, links, claims, ["subject_id", "object_id"]).drop(
        "subject_id", "object_id"
    )


@query(
    "research_depth",
    f"""WITH RECURSIVE {TIERS_SQL}, nb AS (SELECT source_node_id AS id, target_node_id AS n FROM ed UNION SELECT target_node_id, source_node_id FROM ed),
 near AS (SELECT nb.id, min(t.tier) AS t FROM nb JOIN nt t ON nb.n = t.id WHERE t.tier IS NOT NULL GROUP BY ALL)
SELECT nt.id, kind, CASE WHEN kind IN ('product', 'component', 'material') THEN nt.tier WHEN kind = 'geography' THEN NULL ELSE near.t + 1 END AS depth
FROM nt LEFT JOIN near USING (id)""",
)
def research_depth(spark, sf):
    return tr.research_depth(*tiered_graph(spark, sf)).select("id", "kind", "depth")


@query(
    "branches",
    f"""WITH RECURSIVE ed AS ({duck("edge")}), w AS (SELECT source_node_id AS id, source_node_id AS b, 1 AS t FROM ed WHERE target_node_id = '{ROOT}'
 UNION SELECT e.source_node_id, w.b, w.t + 1 FROM w JOIN ed e ON e.target_node_id = w.id WHERE e.predicate <> 'LOCATED_IN' AND w.t < 40),
 m AS (SELECT id, min(t) AS t FROM w GROUP BY id)
SELECT w.id, min(w.b) AS branch_id FROM w JOIN m ON w.id = m.id AND w.t = m.t GROUP BY ALL UNION ALL SELECT '{ROOT}', 'root'""",
)
def branches(spark, sf):
    return tr.branches(lens(spark, sf, "node"), lens(spark, sf, "edge"), root(spark, sf))


@query(
    "unanswered_relations",
    f"""WITH ed AS ({duck("edge")}), nd AS ({duck("node")}),
 r(kind, relation) AS (VALUES ('product','upstream_inputs'),('product','manufacturer_or_facility'),('component','upstream_inputs'),
  ('component','manufacturer_or_facility'),('material','material_origin'),('material','supplier'),('organization','location'),('organization','supplier'),('facility','location')),
 a(relation, predicate) AS (VALUES ('upstream_inputs','INPUT_TO'),('upstream_inputs','PART_OF'),('manufacturer_or_facility','MANUFACTURES'),
  ('manufacturer_or_facility','PRODUCES'),('material_origin','PROCESSED_BY'),('material_origin','PRODUCES'),('supplier','SUPPLIES'),('location','LOCATED_IN'),('location','OPERATES'))
SELECT nd.id, r.relation FROM nd JOIN r USING (kind) WHERE NOT EXISTS (SELECT 1 FROM ed JOIN a USING (predicate)
 WHERE ed.target_node_id = nd.id AND a.relation = r.relation AND ed.support_label = 'directly_supported')""",
)
def unanswered_relations(spark, sf):
    return tr.unanswered_relations(lens(spark, sf, "node"), lens(spark, sf, "edge"))


PARENTS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1
  WHEN p_partkey % 30 = 0 THEN p_partkey + 9 WHEN p_partkey % 70 = 0 THEN -1 - p_partkey END AS parent_id FROM {part}"""


@query(
    "parent_cycles",
    f"""WITH RECURSIVE p AS ({duck(PARENTS)}), w AS (SELECT id, parent_id AS ptr, 0 AS n FROM p
 UNION ALL SELECT w.id, p.parent_id, n + 1 FROM w JOIN p ON w.ptr = p.id WHERE n < 12)
SELECT id, CASE WHEN max(n) >= 12 THEN 'cycle' ELSE 'dangling' END AS fault FROM w
GROUP BY id HAVING max(n) >= 12 OR bool_or(ptr IS NOT NULL AND ptr NOT IN (SELECT id FROM p))""",
)
def parent_cycles(spark, sf):
    return tr.parent_faults(frame(spark, sf, PARENTS))


BOM_SQL = f"""el AS (SELECT e.*, s.kind AS kind, s.label AS name FROM ({duck("part_edge")}) e JOIN nd s ON s.id = e.source_node_id JOIN nd t ON t.id = e.target_node_id
   WHERE e.scope_type = 'product' OR (e.scope_type = 'generic' AND t.kind <> 'product')),
 bw AS (SELECT '{ROOT}' AS id, 0 AS tier UNION SELECT el.source_node_id, tier + 1 FROM bw JOIN el ON el.target_node_id = bw.id WHERE tier < 40),
 bd AS (SELECT id, min(tier) AS tier FROM bw GROUP BY id),
 bom AS (SELECT el.source_node_id AS node_id, el.name, el.kind, d.tier, el.target_node_id AS parent_node_id, el.edge_id, el.quantity, el.unit,
  CASE WHEN el.quantity IS NOT NULL THEN CASE WHEN el.operational_provenance THEN 'user_asserted' ELSE el.support_label END END AS quantity_support_label,
  el.support_label, el.scope_type FROM el JOIN bd d ON d.id = el.source_node_id JOIN bd p ON p.id = el.target_node_id)"""
BOM_HEAD = f"WITH RECURSIVE nd AS ({duck('node')}), {BOM_SQL}"


def bom(spark, sf):
    return tr.bom_view(lens(spark, sf, "part_edge"), lens(spark, sf, "node"), ROOT)


@query("bom_view", f"{BOM_HEAD} SELECT * FROM bom")
def bom_view(spark, sf):
    return tr.bom_order(bom(spark, sf))


@query(
    "bom_coverage",
    f"""{BOM_HEAD} SELECT count(*) AS rows, round(coalesce(100.0::DOUBLE * count(*) FILTER (support_label = 'directly_supported') / count(*), 0), 6) AS coverage_pct FROM bom""",
)
def bom_coverage(spark, sf):
    return tr.bom_coverage(bom(spark, sf)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query(
    "bom_filter",
    f"{BOM_HEAD} SELECT node_id, name, tier FROM bom WHERE kind = 'component' AND contains(lower(name), 'anvil')",
)
def bom_filter(spark, sf):
    return tr.bom_filter(bom(spark, sf), "component", "Anvil").select("node_id", "name", "tier")


@query(
    "node_search",
    f"""WITH ed AS ({duck("edge")}), nd AS ({duck("node")}), h AS (SELECT id FROM nd WHERE (kind = 'component' AND contains(lower(concat(label, ' ', mpn)), 'mp12')) OR id = '{ROOT}'),
 nb AS (SELECT target_node_id AS id FROM ed WHERE source_node_id IN (SELECT id FROM h) UNION SELECT source_node_id FROM ed WHERE target_node_id IN (SELECT id FROM h))
SELECT nd.id, kind, label, nd.id IN (SELECT id FROM h) AS hit FROM nd WHERE nd.id IN (SELECT id FROM h UNION SELECT id FROM nb)""",
)
def node_search(spark, sf):
    nodes = lens(spark, sf, "node").select(
        "id",
        "kind",
        "label",
        F.array().cast("array<string>").alias("aliases"),
        F.create_map(F.lit("mpn"), F.col("mpn")).alias("external_ids"),
    )
    found = tr.node_search(nodes, lens(spark, sf, "edge"), "mp12", "component", ROOT)
    return found.select("id", "kind", "label", "hit")


STAT_NODES = "SELECT p_brand AS graph_id, p_partkey AS id, CAST(p_size % 6 AS INT) AS tier FROM {part}"
STAT_EDGES = "SELECT p_brand AS graph_id, CASE p_size % 3 WHEN 0 THEN 'directly_supported' WHEN 1 THEN 'user_asserted' ELSE 'unresolved' END AS support_label FROM {part} WHERE p_brand NOT IN ('Brand#5', 'Brand#11')"


@query(
    "graph_stats_by_graph",
    f"""WITH n AS (SELECT graph_id, count(*) AS node_count, max(tier) AS max_tier FROM ({duck(STAT_NODES)}) GROUP BY ALL), e AS (SELECT graph_id, support_label, count(*) AS edges FROM ({duck(STAT_EDGES)}) GROUP BY ALL)
SELECT n.graph_id, support_label, coalesce(edges, 0) AS edges, node_count, max_tier, CAST(coalesce(sum(edges) OVER (PARTITION BY n.graph_id), 0) AS BIGINT) AS edge_count FROM n LEFT JOIN e ON n.graph_id = e.graph_id""",
)
def graph_stats_by_graph(spark, sf):
    """Statistics of every graph at once; two of them have no edges."""
    return tr.graph_stats(frame(spark, sf, STAT_NODES), frame(spark, sf, STAT_EDGES), ["graph_id"])


@query(
    "exact_totals",
    """SELECT l_suppkey, CAST(sum(round(l_discount * 100)::BIGINT * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)) AS DOUBLE) / 64 AS discounts, count(*) AS lines FROM lineitem GROUP BY ALL""",
)
def exact_totals(spark, sf):
    """Exact sums of numbers of very different size that cancel: every line adds and takes 1e17."""
    rows = table(spark, sf, "lineitem").withColumn("sign", F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0))
    small = F.round(F.col("l_discount") * 100) * F.col("sign") / 64
    terms = rows.select("l_suppkey", F.explode(F.array(small, F.lit(1e17), F.lit(-1e17))).alias("x"))
    sums = exact_sums(terms, ["l_suppkey"], "x", "discounts")
    return sums.join(rows.groupBy("l_suppkey").agg(F.count("*").alias("lines")), "l_suppkey")
