"""Queries over entity resolution and places."""

from pyspark.sql import functions as F

from ..functions.text import native_label_key
from ..operators import resolution as rs
from .catalog import query
from .lens import duck, frame

# parts are the known entities; aliases repeat across parts, so some names are ambiguous
ENTITIES = """SELECT concat('pt:', CAST(p_partkey AS STRING)) AS id, 'component' AS kind,
  concat(p_brand, ' ', p_name, ' p', CAST(p_partkey AS STRING)) AS label, p_name AS alias,
  concat('MP', CAST(p_partkey AS STRING)) AS mpn, p_brand AS manufacturer FROM {part}"""
# every line item mentions its part in one of seven ways
MENTIONS = """SELECT 'component' AS kind, CASE l_linenumber
  WHEN 1 THEN upper(concat(p_brand, '  ', p_name, ' p', CAST(p_partkey AS STRING)))
  WHEN 2 THEN concat(p_name, ' p', CAST(p_partkey AS STRING))
  WHEN 3 THEN concat('mp', CAST(p_partkey AS STRING))
  WHEN 4 THEN concat('module ', CAST(p_partkey AS STRING))
  WHEN 5 THEN concat(p_brand, ' ', p_name, ' p', CAST(p_partkey AS STRING))
  WHEN 6 THEN p_name ELSE concat('unknown ', CAST(l_suppkey AS STRING)) END AS label,
  CASE l_linenumber WHEN 4 THEN concat('MP', CAST(p_partkey AS STRING)) WHEN 5 THEN 'MP-other' END AS part_number,
  CASE l_linenumber WHEN 2 THEN p_brand WHEN 4 THEN lower(p_brand) WHEN 5 THEN CASE WHEN l_returnflag = 'R' THEN 'Rival' ELSE p_brand END END AS manufacturer
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def entities(spark, sf):
    nodes = frame(spark, sf, ENTITIES)
    return nodes.withColumn("aliases", F.array("alias")).drop("alias")


KEY_SQL = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
LABEL_K, MAKER_K = KEY_SQL.format("label"), KEY_SQL.format("manufacturer")


@query(
    "resolve_entities",
    f"""WITH n AS (SELECT *, {KEY_SQL.format("label")} AS lk, {KEY_SQL.format("alias")} AS ak, {KEY_SQL.format("mpn")} AS pk, {MAKER_K} AS mk FROM ({duck(ENTITIES)})),
 nk AS (SELECT DISTINCT id, mpn, mk, unnest([lk, ak, pk, replace(lk, mk || ' ', ''), mk || ' ' || lk, mk || ' ' || ak, mk || ' ' || pk]) AS k FROM n),
 f AS (SELECT DISTINCT *, {LABEL_K} AS lk, {MAKER_K} AS mk FROM ({duck(MENTIONS)})),
 fk AS (SELECT *, lk AS k FROM f UNION SELECT *, substring(lk, length(mk) + 2) FROM f WHERE mk <> '' AND starts_with(lk, mk || ' ')),
 c AS (SELECT fk.label, fk.part_number, fk.manufacturer, nk.id FROM fk JOIN nk USING (k)
   UNION SELECT f.label, f.part_number, f.manufacturer, n.id FROM f JOIN n ON n.mpn = f.part_number AND n.mk = f.mk),
 g AS (SELECT label, part_number, manufacturer, count(DISTINCT id) AS c, min(id) AS id FROM c GROUP BY ALL)
SELECT 'component' AS kind, f.label, f.part_number, f.manufacturer,
 CASE WHEN g.c = 1 AND NOT x THEN g.id END AS node_id, CASE WHEN g.c > 1 THEN 'ambiguous_match' WHEN g.c = 1 AND x THEN 'identifier_conflict' END AS reason
FROM f LEFT JOIN g ON f.label = g.label AND f.part_number IS NOT DISTINCT FROM g.part_number AND f.manufacturer IS NOT DISTINCT FROM g.manufacturer
 LEFT JOIN n ON n.id = g.id, LATERAL (SELECT coalesce((f.part_number IS NOT NULL AND n.mpn <> f.part_number) OR (f.mk <> '' AND n.mk <> f.mk), false) AS x)""",
)
def resolve_entities(spark, sf):
    return rs.resolve(frame(spark, sf, MENTIONS), entities(spark, sf))


@query(
    "manufacturer_conflicts",
    f"""WITH n AS (SELECT *, {LABEL_K} AS lk, {KEY_SQL.format("alias")} AS ak, {MAKER_K} AS mk FROM ({duck(ENTITIES)})),
 f AS (SELECT DISTINCT *, {LABEL_K} AS lk, {MAKER_K} AS mk FROM ({duck(MENTIONS)}) WHERE manufacturer IS NOT NULL)
SELECT 'component' AS kind, label, part_number, manufacturer, node_id FROM (
 SELECT f.label, f.part_number, f.manufacturer, n.id AS node_id FROM f JOIN n ON n.mpn = f.part_number AND n.mk <> f.mk
 UNION SELECT f.label, f.part_number, f.manufacturer, n.id FROM f JOIN n ON n.lk = f.lk AND n.mk <> f.mk
 UNION SELECT f.label, f.part_number, f.manufacturer, n.id FROM f JOIN n ON n.ak = f.lk AND n.mk <> f.mk)""",
)
def manufacturer_conflicts(spark, sf):
    return rs.manufacturer_conflicts(frame(spark, sf, MENTIONS), entities(spark, sf))


NEAR = """SELECT concat('pt:', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_type = 'ECONOMY' THEN 'material' ELSE 'component' END AS kind,
  CASE WHEN p_partkey % 9 = 0 THEN p_name WHEN p_partkey % 9 = 1 THEN concat('rev', CAST(CAST(floor(p_partkey / 6) AS BIGINT) AS STRING))
   ELSE concat('alloy ', p_name, ' rev', CAST(CAST(floor(p_partkey / 6) AS BIGINT) AS STRING), CASE WHEN p_size > 25 THEN concat(' mk', CAST(p_size AS STRING)) ELSE '' END) END AS label_key FROM {part}"""
TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(label_key, '[a-z0-9]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+$')))"


@query(
    "near_duplicates",
    f"""WITH l AS (SELECT DISTINCT kind, label_key FROM ({duck(NEAR)})), t AS (SELECT kind, label_key, unnest({TOKENS_SQL}) AS token FROM l),
 s AS (SELECT kind, token, count(*) AS members FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT kind, label_key, 'token:' || token AS via, members FROM t JOIN s USING (kind, token)
UNION ALL SELECT a.kind, a.label_key, 'contains:' || b.label_key, 1 FROM l a JOIN l b ON a.kind = b.kind AND a.label_key <> b.label_key
 AND contains(' ' || a.label_key || ' ', ' ' || b.label_key || ' ') WHERE length(b.label_key) >= 3""",
)
def near_duplicates(spark, sf):
    labels = frame(spark, sf, NEAR)
    groups = rs.token_groups(labels).select(
        "kind", "label_key", F.concat(F.lit("token:"), "token").alias("via"), "members"
    )
    inside = rs.contained_labels(labels).select(
        "kind", "label_key", F.concat(F.lit("contains:"), "inner_key"), F.lit(1).cast("long")
    )
    return groups.union(inside)


TREE = """SELECT concat('pt:', CAST(p_partkey AS STRING)) AS source_node_id,
  concat('pt:', CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING)) AS target_node_id FROM {part} WHERE p_partkey >= 4"""
# a new label per part, seeking its place under the part above it
WANTED = f"""SELECT id AS request_id, kind, concat('new ', label_key) AS label_key,
  concat('pt:', CAST(CAST(floor(CAST(substring(id, 4) AS BIGINT) / 4) AS BIGINT) AS STRING)) AS anchor_id FROM ({NEAR}) x"""
WORDS_SQL = "list_distinct(list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda t: t NOT IN ('the','and','for','with','of','a','an','in','on','to')))"


@query(
    "resolution_candidates",
    f"""WITH n AS (SELECT id AS node_id, kind, label_key AS node_key, {TOKENS_SQL} AS toks FROM ({duck(NEAR)})), e AS ({duck(TREE)}),
 a AS (SELECT *, {TOKENS_SQL} AS toks FROM ({duck(WANTED)})),
 nt AS (SELECT node_id, kind, unnest(toks) AS t FROM n), atk AS (SELECT request_id, kind, unnest(toks) AS t FROM a),
 c AS (SELECT request_id, node_id, 3 AS p FROM atk JOIN nt USING (kind, t)
  UNION ALL SELECT request_id, node_id, 3 FROM a JOIN n ON a.kind = n.kind AND length(node_key) >= 3 AND contains(' ' || label_key || ' ', ' ' || node_key || ' ')
  UNION ALL SELECT request_id, source_node_id, 2 FROM a JOIN e ON anchor_id = target_node_id
  UNION ALL SELECT request_id, e.source_node_id, 1 FROM a JOIN e w ON anchor_id = w.source_node_id JOIN e ON e.target_node_id = w.target_node_id),
 m AS (SELECT request_id, node_id, max(p) AS priority FROM c GROUP BY ALL),
 s AS (SELECT m.*, length(list_intersect({WORDS_SQL.format("label_key")}, {WORDS_SQL.format("node_key")})) AS shared FROM m JOIN a USING (request_id) JOIN n USING (node_id)
  WHERE a.kind = n.kind AND node_key <> label_key AND node_id <> anchor_id)
SELECT request_id, node_id, CAST(priority AS INT) AS priority, CAST(shared AS INT) AS shared, row_number() OVER (PARTITION BY request_id ORDER BY priority DESC, shared DESC, node_id) AS rank FROM s QUALIFY rank <= 12""",
)
def resolution_candidates(spark, sf):
    out = rs.resolution_candidates(
        frame(spark, sf, WANTED), frame(spark, sf, NEAR), frame(spark, sf, TREE)
    )
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "record_identity",
    f"""WITH f AS (SELECT l_partkey, l_linenumber, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL)
SELECT concat('pt:', p_partkey) AS id, CASE WHEN bool_or(l_linenumber = 2) THEN 'mx' || p_partkey ELSE 'old ' || p_name || ' assembly of the main line' END AS label,
 CASE WHEN bool_or(l_linenumber = 3) THEN 'MP' || p_partkey END AS mpn,
 CAST(count(DISTINCT CASE WHEN l_linenumber IS NULL THEN NULL WHEN l_linenumber = 1 THEN 'a' WHEN l_linenumber = 2 THEN 'b' ELSE 'c' END) AS INT) AS aliases
FROM part LEFT JOIN f ON l_partkey = p_partkey GROUP BY p_partkey, p_name""",
)
def record_identity(spark, sf):
    nodes = frame(
        spark,
        sf,
        "SELECT concat('pt:', CAST(p_partkey AS STRING)) AS id, concat('old ', p_name, ' assembly of the main line') AS label, CAST(NULL AS STRING) AS mpn, CAST(NULL AS STRING) AS manufacturer FROM {part}",
    ).withColumn("aliases", F.array().cast("array<string>"))
    matched = frame(
        spark,
        sf,
        """SELECT concat('pt:', CAST(l_partkey AS STRING)) AS node_id, CASE l_linenumber WHEN 1 THEN concat('part ', p_name, ' with a long description')
         WHEN 2 THEN concat('mx', CAST(l_partkey AS STRING)) ELSE concat('plain ', p_name, ' long described item here') END AS label,
         CASE WHEN l_linenumber = 3 THEN concat(' MP', CAST(l_partkey AS STRING), ' ') END AS part_number, CAST(NULL AS STRING) AS manufacturer, l_orderkey AS ord
         FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    )
    out = rs.record_identity(nodes, matched)
    return out.select("id", "label", "mpn", F.size("aliases").alias("aliases"))
