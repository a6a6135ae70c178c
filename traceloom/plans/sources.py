"""Queries over readers and sinks, on files Spark writes from the given tables first."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import readers, sinks
from .catalog import query
from .lens import duck, frame


# every part is a row of an uploaded bill of materials; some quantities and kinds are broken
BOM_ROWS = """SELECT CASE WHEN p_size = 7 THEN '' ELSE concat(p_name, ', "', CAST(p_partkey AS STRING), '"') END AS `Part Name`,
 CASE WHEN p_size % 5 = 0 THEN 'many' WHEN p_size % 5 = 1 THEN '' ELSE CAST(p_size AS STRING) END AS Qty, 'ea' AS Unit,
 CASE WHEN p_size = 9 THEN 'gadget' WHEN p_type = 'ECONOMY' THEN 'material' ELSE 'component' END AS Kind FROM {part}"""


@query(
    "bom_csv_rows",
    """WITH r AS (SELECT p_name || ', "' || p_partkey || '"' AS label, p_size, CASE WHEN p_type = 'ECONOMY' THEN 'material' ELSE 'component' END AS kind FROM part)
SELECT label, kind, CASE WHEN p_size % 5 IN (0, 1) THEN NULL ELSE p_size::DOUBLE END AS quantity, 'ea' AS unit, CASE WHEN p_size % 5 = 0 THEN 'quantity_invalid' WHEN p_size % 5 = 1 THEN 'quantity_unknown' END AS warning, NULL::VARCHAR AS reason FROM r WHERE p_size NOT IN (7, 9)
UNION ALL SELECT CASE p_size WHEN 7 THEN '' ELSE label END, NULL, NULL, NULL, NULL, CASE p_size WHEN 7 THEN 'label_empty' ELSE 'kind' END FROM r WHERE p_size IN (7, 9)""",
)
def bom_csv_rows(spark, sf):
    path = scratch_path(spark, "bom")
    frame(spark, sf, BOM_ROWS).write.option("header", True).option("escape", '"').csv(path)
    rows, rejects, warnings = readers.read_bom_csv(spark, path)
    told = rows.join(warnings.select("label", "warning"), "label", "left")
    none = lambda t: F.lit(None).cast(t)
    return told.select("label", "kind", "quantity", "unit", "warning", none("string").alias("reason")).union(
        rejects.select("label", none("string"), none("double"), none("string"), none("string"), "reason")
    )


# a customer's orders of one block of a hundred order numbers are the items of an estimate
ESTIMATE_ROWS = """SELECT concat('est', CAST(o_custkey AS STRING), '-', CAST(CAST(floor(o_orderkey / 100) AS BIGINT) AS STRING)) AS id, 'completed' AS status, 'Widget' AS product, concat('i', CAST(o_orderkey AS STRING)) AS item, o_orderpriority AS name,
 CASE WHEN o_orderkey % 11 = 0 THEN concat('i', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 13 = 0 THEN 'i-lost' END AS parent, CASE WHEN o_orderkey % 17 = 0 THEN 's-lost' ELSE 's1' END AS source FROM {orders}"""


@query(
    "estimate_violations",
    f"""WITH r AS ({duck(ESTIMATE_ROWS)}) SELECT id AS estimate_id, item AS id, CASE WHEN parent = item THEN 'parent_cycle' ELSE 'parent_dangling' END AS reason FROM r WHERE parent IS NOT NULL
UNION ALL SELECT id, item, 'source_missing' FROM r WHERE source = 's-lost'""",
)
def estimate_violations(spark, sf):
    rows = frame(spark, sf, ESTIMATE_ROWS)
    ref = F.array(F.struct(F.lit("web_page").alias("type"), F.col("source").alias("source_id")))
    item = F.struct(F.col("item").alias("id"), "name", F.col("parent").alias("parent_item_id"), ref.alias("sources"))
    source = F.array(F.struct(F.lit("s1").alias("id"), F.lit("https://a.example.org/").alias("url")))
    path = scratch_path(spark, "estimates")
    # a block has a hundred order numbers, so no document lists more items than that
    documents = rows.groupBy("id", "status").agg(F.collect_list(item).alias("items"))
    documents.select("id", "status", F.struct(F.lit("Widget").alias("name")).alias("product"), "items", source.alias("sources")).write.json(path)
    return readers.estimate_violations(*readers.read_estimates(spark, path, multi_line=False))


FACILITIES = """SELECT concat('su:', CAST(s_suppkey AS STRING)) AS id, 'facility' AS kind, s_name AS label, n_name AS country_iso2, CASE WHEN s_acctbal > 0 THEN CAST(n_nationkey AS DOUBLE) END AS lat, CAST(n_regionkey AS DOUBLE) AS lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@query(
    "geojson_features",
    f"""SELECT id AS node_id, country_iso2, lat, lon, 2::BIGINT AS claims FROM ({duck(FACILITIES)}) WHERE lat IS NOT NULL""",
)
def geojson_features(spark, sf):
    nodes = frame(spark, sf, FACILITIES)
    claims = nodes.select(F.col("id").alias("node_id"), F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("claim_id"), F.lit("directly_supported").alias("support_label"))
    path = scratch_path(spark, "geojson")
    sinks.write_geojson(sinks.facility_features(nodes, claims), path)
    lines = spark.read.schema(
        "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<node_id:string,country_iso2:string,claim_count:long>"
    ).json(path)
    return lines.select(
        "properties.node_id", "properties.country_iso2", F.col("geometry.coordinates")[1].alias("lat"), F.col("geometry.coordinates")[0].alias("lon"), F.col("properties.claim_count").alias("claims")
    )
