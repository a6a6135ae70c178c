"""The driver's synthetic tables seen as evidence-graph tables.

Each lens is a plain projection in SQL that Spark and DuckDB both accept, so a query and its oracle
start from the same rows. The meaning given to the synthetic columns is invented: an order is a
source, a line item is a claim that a supplier produces a part, and so on.
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

CLAIM_ID = """md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING),
    CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING),
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING),
    CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING),
    CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING), l_returnflag, l_linestatus,
    CAST(CAST(l_shipdate AS DATE) AS STRING)))"""

LENS = {}

LENS["claim"] = f"""
SELECT {CLAIM_ID} AS claim_id, l_suppkey AS subject_id, l_partkey AS object_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'company' ELSE 'product' END AS scope_type,
  CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN round(l_discount * 100) >= 10 THEN 'disputed'
       ELSE 'accepted' END AS status,
  CASE l_linenumber % 5 WHEN 0 THEN 'directly_supported' WHEN 1 THEN 'strongly_inferred'
       WHEN 2 THEN 'weakly_inferred' WHEN 3 THEN 'user_asserted' ELSE 'unresolved' END AS support_label,
  l_shipdate AS observed_at, l_orderkey AS source_id,
  CASE WHEN round(l_tax * 100) >= 8 THEN 'contradicts' ELSE 'supports' END AS support_type,
  CASE WHEN l_quantity = 13 THEN ' ' ELSE concat('line ', CAST(l_linenumber AS STRING)) END AS span,
  NOT (l_quantity = 50 AND l_linenumber = 7) AS claim_found
FROM {{lineitem}}"""

LENS["source"] = """
SELECT o_orderkey AS source_id, concat('family-', CAST(o_custkey % 50 AS STRING)) AS family,
  concat(CAST(CAST(o_orderdate AS DATE) AS STRING), '|', o_orderpriority) AS content_hash,
  CASE WHEN o_orderstatus = 'P' THEN 'upload' ELSE 'web' END AS kind, o_orderdate AS published_at,
  concat('https://s', CAST(o_custkey % 50 AS STRING), '.example.org/', CAST(o_orderkey AS STRING)) AS url
FROM {orders} WHERE o_orderkey % 97 <> 0"""

# supplier PRODUCES part; every evidence row with its source record, if there is one
LENS["lineage"] = f"""
SELECT c.*, s.source_id IS NOT NULL AS source_found, s.family, s.content_hash, s.kind,
  s.published_at, s.url
FROM ({LENS["claim"]}) c LEFT JOIN ({LENS["source"]}) s ON c.source_id = s.source_id"""

# supplier MANUFACTURES brand: the same evidence folded to a coarse edge with many claims
LENS["brand_lineage"] = f"""
SELECT x.claim_id, x.subject_id, p.p_brand AS brand, x.scope_type, x.status, x.support_label,
  x.observed_at, x.source_id, x.support_type, x.span, x.claim_found, x.source_found, x.family,
  x.content_hash, x.kind, x.published_at, x.url
FROM ({LENS["lineage"]}) x JOIN {{part}} p ON x.object_id = p.p_partkey"""

# country production of a brand, by year; returned goods stand for the unallocated quantity
LENS["production"] = """
SELECT p.p_brand AS commodity, CAST(year(l.l_shipdate) AS INT) AS year, n.n_name AS country,
  CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE CAST(l.l_quantity AS BIGINT) END AS quantity,
  CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END AS unallocated
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {part} p ON l.l_partkey = p.p_partkey"""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frame(spark, sf_dir, sql):
    """Run lens SQL over the parquet tables of `sf_dir`."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def lens(spark, sf_dir, name):
    return frame(spark, sf_dir, LENS[name])


def duck(name_or_sql):
    """The same lens as text for DuckDB."""
    sql = LENS.get(name_or_sql, name_or_sql)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
