"""Queries over production shares, distributions and sites."""

from pyspark.sql import functions as F

from ..functions import sites as st
from ..functions.text import native_label_key
from ..operators import shares as sh
from .catalog import ORACLES, query
from .lens import duck, frame, lens

BY = ["commodity", "year"]

TOTALS_SQL = f"""t AS (SELECT commodity, year, country, CAST(sum(quantity) AS BIGINT) AS q, CAST(sum(unallocated) AS BIGINT) AS u
 FROM ({duck("production")}) GROUP BY ALL)"""

CONCENTRATION_SQL = f"""WITH {TOTALS_SQL}, s AS (SELECT commodity, year, CAST(sum(q) AS BIGINT) AS a, sum(q + u)::DOUBLE AS total FROM t GROUP BY ALL)
SELECT t.commodity, t.year, round(sum((q / total) * (q / total)), 6) AS hhi, round(max(q / total), 6) AS top_share,
 arg_min(t.country, (-q, t.country)) AS top_country, round(100.0::DOUBLE * any_value(a) / any_value(total), 6) AS coverage_pct
FROM t JOIN s USING (commodity, year) GROUP BY ALL"""


def totals(spark, sf):
    return sh.country_totals(lens(spark, sf, "production"), BY)


@query("hhi_by_brand_year", CONCENTRATION_SQL)
def hhi_by_brand_year(spark, sf):
    out = sh.concentration(totals(spark, sf), BY)
    return out.select(
        *BY,
        F.round("hhi", 6).alias("hhi"),
        F.round("top_share", 6).alias("top_share"),
        "top_country",
        F.round("coverage_pct", 6).alias("coverage_pct"),
    )


@query(
    "top_share",
    f"""WITH {TOTALS_SQL} SELECT commodity, year, country, round(q / sum(q + u) OVER w, 6) AS share,
 row_number() OVER (w ORDER BY q DESC, country) AS rank FROM t WINDOW w AS (PARTITION BY commodity, year)""".replace(
        "OVER (w ORDER", "OVER (PARTITION BY commodity, year ORDER"
    ),
)
def top_share(spark, sf):
    return sh.country_shares(totals(spark, sf), BY).withColumn("share", F.round("share", 6))


@query(
    "country_features",
    f"""WITH {TOTALS_SQL}, m AS (SELECT commodity, max(year) AS year FROM t GROUP BY ALL)
SELECT t.country, t.commodity, t.year, round(q / total, 6) AS share FROM t JOIN m USING (commodity, year)
 JOIN (SELECT commodity, year, sum(q + u)::DOUBLE AS total FROM t GROUP BY ALL) USING (commodity, year)""",
)
def country_features(spark, sf):
    """Shares of each commodity's latest year, by country."""
    shares = sh.country_shares(totals(spark, sf), BY)
    latest = shares.groupBy("commodity").agg(F.max("year").alias("year"))
    return shares.join(latest, BY, "left_semi").select(
        "country", *BY, F.round("share", 6).alias("share")
    )


DATASETS = """SELECT DISTINCT p.p_name AS commodity, CAST(year(l.l_shipdate) AS INT) AS year,
  CASE WHEN l.l_linestatus = 'F' THEN 'mine' ELSE 'refinery' END AS stage
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey"""


@query(
    "production_match",
    f"""WITH d AS ({duck(DATASETS)}), b AS (SELECT lower(commodity) AS k, max(year * 10 + CASE stage WHEN 'mine' THEN 1 ELSE 0 END) AS v FROM d GROUP BY ALL)
SELECT p_partkey AS node_id, p_name AS commodity, CAST(b.v // 10 AS INT) AS year, CASE b.v % 10 WHEN 1 THEN 'mine' ELSE 'refinery' END AS stage
FROM part JOIN b ON lower(p_name) = b.k WHERE p_type = 'ECONOMY'""",
)
def production_match(spark, sf):
    materials = frame(
        spark, sf, "SELECT p_partkey AS node_id, p_name FROM {part} WHERE p_type = 'ECONOMY'"
    )
    labels = materials.select("node_id", native_label_key("p_name").alias("label_key"))
    datasets = frame(spark, sf, DATASETS).withColumn("name_key", native_label_key("commodity"))
    return sh.match_production(labels, datasets).drop("label_key")


@query(
    "commodity_reference",
    f"""SELECT commodity, array_to_string(list_sort(list(DISTINCT CAST(year AS STRING))), ',') AS years,
 array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM ({duck(DATASETS)}) GROUP BY ALL""",
)
def commodity_reference(spark, sf):
    return sh.commodity_reference(frame(spark, sf, DATASETS))


MAKER_EDGES = """SELECT l.l_suppkey AS source_node_id, p.p_brand AS target_node_id,
  CASE WHEN l.l_suppkey % 25 = 0 THEN CAST(round(avg(l.l_discount), 4) AS DOUBLE) END AS weight
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY l.l_suppkey, p.p_brand"""

# whole cents over a power of two: sums of such weights are exact in any order
MAKER_EDGES = MAKER_EDGES.replace(
    "CAST(round(avg(l.l_discount), 4) AS DOUBLE)",
    "CAST(sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS DOUBLE) / 32768",
)
SUPPLY_EDGES = """SELECT l.l_suppkey AS source_node_id, o.o_custkey AS target_node_id,
  CASE WHEN l.l_suppkey % 5 = 0 THEN CAST(sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS DOUBLE) / 1024 END AS weight
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_suppkey, o.o_custkey"""


def distribution_sql(edges):
    return f"""WITH e AS ({duck(edges)}), t AS (SELECT target_node_id, coalesce(sum(weight), 0) AS s, count(*) FILTER (weight IS NULL) AS n FROM e GROUP BY ALL)
SELECT e.source_node_id, e.target_node_id, round(e.weight, 6) AS weight, CASE WHEN weight IS NULL THEN 'uniform_prior' ELSE 'stated' END AS basis,
 CASE WHEN weight IS NULL THEN round(greatest(0, 1 - s) / n, 4) END AS share_estimate, round(least(1, s), 4) AS stated_total, round(greatest(0, 1 - s), 4) AS unassigned
FROM e JOIN t USING (target_node_id)"""


@query("maker_distribution", distribution_sql(MAKER_EDGES))
def maker_distribution(spark, sf):
    out = sh.distribution(frame(spark, sf, MAKER_EDGES))
    return out.withColumn("weight", F.round("weight", 6))


@query("supplier_distribution", distribution_sql(SUPPLY_EDGES))
def supplier_distribution(spark, sf):
    out = sh.distribution(frame(spark, sf, SUPPLY_EDGES))
    return out.withColumn("weight", F.round("weight", 6))


# suppliers are plants; ten suppliers form one operating organization; both make brands
SITE_NODES = """SELECT concat('fa:', CAST(s_suppkey AS STRING)) AS id, 'facility' AS kind, s_name AS label,
  CASE WHEN s_acctbal > 0 THEN n_name END AS country,
  CASE WHEN s_acctbal > 0 THEN CAST(n_nationkey AS DOUBLE) END AS lat,
  CASE WHEN s_acctbal > 0 THEN CAST(n_regionkey AS DOUBLE) END AS lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT concat('og:', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)), 'organization',
  concat('Operator ', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)),
  CASE WHEN CAST(floor(s_suppkey / 10) AS BIGINT) % 3 = 0 THEN 'HQ' END,
  CASE WHEN CAST(floor(s_suppkey / 10) AS BIGINT) % 3 = 0 THEN 1.0 END,
  CASE WHEN CAST(floor(s_suppkey / 10) AS BIGINT) % 3 = 0 THEN 2.0 END FROM {supplier}
UNION ALL SELECT DISTINCT p_brand, 'product', p_brand, CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {part}"""
SITE_EDGES = """SELECT concat('og:', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)) AS source_node_id,
  concat('fa:', CAST(s_suppkey AS STRING)) AS target_node_id, 'OPERATES' AS predicate, CAST(NULL AS DOUBLE) AS weight
FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL SELECT concat('fa:', CAST(s_suppkey AS STRING)), concat('og:', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)),
  'OWNED_BY', CAST(NULL AS DOUBLE) FROM {supplier} WHERE s_suppkey % 2 = 1
UNION ALL SELECT concat('fa:', CAST(l_suppkey AS STRING)), p_brand, 'MANUFACTURES', CAST(NULL AS DOUBLE)
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag <> 'A' GROUP BY l_suppkey, p_brand
UNION ALL SELECT concat('og:', CAST(CAST(floor(l_suppkey / 10) AS BIGINT) AS STRING)), p_brand, 'MANUFACTURES',
  CASE WHEN max(l_quantity) >= 50 THEN 0.0625 END
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY CAST(floor(l_suppkey / 10) AS BIGINT), p_brand"""


@query(
    "sites",
    f"""WITH n AS ({duck(SITE_NODES)}), e AS ({duck(SITE_EDGES)}), mk AS (SELECT * FROM e WHERE predicate = 'MANUFACTURES'),
 t AS (SELECT target_node_id, coalesce(sum(weight), 0) AS s, count(*) FILTER (weight IS NULL) AS c FROM mk GROUP BY ALL),
 d AS (SELECT source_node_id AS maker, target_node_id, predicate, coalesce(weight, round(greatest(0, 1 - s) / c, 4)) AS share,
   CASE WHEN weight IS NULL THEN 'uniform_prior' ELSE 'stated' END AS basis FROM mk JOIN t USING (target_node_id)),
 loc AS (SELECT id, kind FROM n WHERE lat IS NOT NULL AND kind IN ('facility', 'organization')),
 own AS (SELECT id AS node_id, target_node_id, predicate, share, basis AS share_basis, NULL::VARCHAR AS via_organization_id FROM d JOIN loc ON maker = id),
 op AS (SELECT source_node_id AS org, target_node_id AS plant FROM e WHERE predicate = 'OPERATES' UNION ALL
   SELECT target_node_id, source_node_id FROM e WHERE predicate = 'OWNED_BY'),
 cnt AS (SELECT org, count(*) AS c FROM op JOIN n ON plant = id WHERE country IS NOT NULL GROUP BY ALL),
 inh AS (SELECT plant AS node_id, d.target_node_id, d.predicate, CASE WHEN coalesce(c, 1) > 1 THEN round(share / c, 4) ELSE share END AS share,
   CASE WHEN coalesce(c, 1) > 1 THEN basis || '_over_plants' ELSE basis END AS share_basis, op.org AS via_organization_id
   FROM op JOIN loc ON op.plant = loc.id LEFT JOIN cnt ON op.org = cnt.org JOIN d ON d.maker = op.org WHERE loc.kind = 'facility')
SELECT * FROM own UNION ALL SELECT * FROM inh ANTI JOIN own USING (node_id, target_node_id, predicate)""",
)
def sites(spark, sf):
    return sh.site_makes(frame(spark, sf, SITE_NODES), frame(spark, sf, SITE_EDGES))


@query(
    "site_summary",
    f"""WITH n AS ({duck(SITE_NODES)}), e AS ({duck(SITE_EDGES)}),
 op AS (SELECT source_node_id AS org, target_node_id AS plant FROM e WHERE predicate = 'OPERATES' UNION ALL
   SELECT target_node_id, source_node_id FROM e WHERE predicate = 'OWNED_BY'),
 mk AS (SELECT DISTINCT source_node_id AS maker, target_node_id FROM e WHERE predicate = 'MANUFACTURES'),
 al AS (SELECT id AS node_id, target_node_id FROM n JOIN mk ON maker = id UNION
   SELECT id, target_node_id FROM n JOIN op ON plant = id JOIN mk ON maker = org),
 m AS (SELECT node_id, count(*) AS makes FROM al GROUP BY ALL), o AS (SELECT plant, count(*) AS operators FROM op GROUP BY ALL)
SELECT id AS node_id, CASE kind WHEN 'facility' THEN 'plant' ELSE 'organization' END AS role, label, country, coalesce(makes, 0) AS makes, coalesce(operators, 0) AS operators
FROM n LEFT JOIN m ON id = node_id LEFT JOIN o ON id = plant WHERE lat IS NOT NULL AND kind <> 'product' AND (makes > 0 OR operators > 0)""",
)
def site_summary(spark, sf):
    nodes, edges = frame(spark, sf, SITE_NODES), frame(spark, sf, SITE_EDGES)
    return sh.site_summary(nodes, sh.site_makes(nodes, edges), sh.operator_plants(edges, nodes))


SUMMARY_SQL = ORACLES["site_summary"]


@query(
    "site_totals",
    f"""SELECT count(*) AS sites, count(*) FILTER (role = 'organization') AS organizations, count(*) FILTER (role = 'plant') AS plants,
 count(DISTINCT country) AS countries, CAST(sum(makes) AS BIGINT) AS connections FROM ({SUMMARY_SQL})""",
)
def site_totals(spark, sf):
    return sh.site_totals(site_summary(spark, sf))


# every customer is a site with an address of one of five shapes
CARDS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'organization' ELSE 'plant' END AS role, n_name AS country_name,
 CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS admin1, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'address' ELSE 'city' END AS precision,
 CASE c_custkey % 5 WHEN 0 THEN concat('5509 N.W. Parker, Camas ', c_mktsegment, ', WA, 98607') WHEN 1 THEN concat('Old Mill Road, Town, ', n_name) WHEN 2 THEN 'Machinery' WHEN 3 THEN n_name END AS address,
 CASE c_custkey % 2 WHEN 0 THEN 'PRODUCES' ELSE 'OWNED_BY' END AS predicate, c_name AS label, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 100 AS DOUBLE) / 128 END AS share, CASE c_custkey % 3 WHEN 0 THEN 'stated' ELSE 'uniform_prior' END AS basis
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query(
    "site_cards",
    f"""WITH c AS (SELECT *, CASE id % 5 WHEN 0 THEN 'Camas ' || (SELECT c_mktsegment FROM customer WHERE c_custkey = id) WHEN 1 THEN 'Town' WHEN 2 THEN 'Machinery' ELSE coalesce(admin1, country_name) END AS city FROM ({duck(CARDS)}))
SELECT id, city, CASE WHEN role = 'plant' THEN 'Plant' ELSE 'Company office' END || ' in ' || city || CASE WHEN admin1 IS NOT NULL AND lower(admin1) <> lower(city) THEN ', ' || admin1 ELSE '' END || ', ' || country_name || '. '
 || CASE WHEN id % 11 = 0 THEN 'Operated by Acme, Zed; no relation to a part is verified yet.' WHEN id % 13 = 0 THEN 'Located; no relation to a part is verified yet.'
  ELSE 'It ' || CASE predicate WHEN 'PRODUCES' THEN 'produces' ELSE 'owned_by' END || ' ' || label || CASE WHEN share IS NULL THEN '' WHEN basis = 'stated' THEN ' (' || CAST(floor(share * 100 + 0.5) AS BIGINT) || '% stated)' ELSE ' (~' || CAST(floor(share * 100 + 0.5) AS BIGINT) || '%, prior)' END || '.' END
 || ' ' || CASE precision WHEN 'address' THEN 'Address stated in the source' ELSE 'City centre from the reference gazetteer' END || '.' AS detail FROM c""",
)
def site_cards(spark, sf):
    rows = frame(spark, sf, CARDS)
    make = F.struct("predicate", "label", "share", F.col("basis").alias("share_basis"))
    silent = (F.col("id") % 11 == 0) | (F.col("id") % 13 == 0)
    rows = rows.withColumn("makes", F.when(~silent, F.array(make)).otherwise(F.slice(F.array(make), 1, 0)))
    names = F.array(F.lit("Acme"), F.lit("Zed"))
    rows = rows.withColumn("operators", F.when(F.col("id") % 11 == 0, names).otherwise(F.slice(names, 1, 0)))
    rows = rows.withColumn("candidates", st.place_candidates("address", "country_name"))
    rows = rows.withColumn("city", st.short_city("candidates", "admin1", "country_name", "precision"))
    rows = rows.withColumn("region", st.short_region("admin1", "city"))
    detail = st.describe_site("role", "city", "region", "country_name", "makes", "operators", "precision")
    return rows.select("id", "city", detail.alias("detail"))
