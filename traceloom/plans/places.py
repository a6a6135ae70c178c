"""Queries over places and enrichment."""

from pyspark.sql import functions as F

from ..functions.text import native_label_key
from ..operators import places as pl
from .catalog import query
from .lens import duck, frame
from .shares import DATASETS

# nations are countries AA..YY, regions belong to their first nation, customers' towns are cities
COUNTRIES = "SELECT n_nationkey AS pos, concat(chr(65 + n_nationkey), chr(65 + n_nationkey)) AS code, n_name AS name, CAST(n_nationkey AS DOUBLE) AS lat, 1.5 AS lon FROM {nation}"
REGIONS = "SELECT r_regionkey AS pos, r_name AS name, concat(chr(65 + min(n_nationkey)), chr(65 + min(n_nationkey))) AS country, CAST(r_regionkey AS DOUBLE) AS lat, 2.5 AS lon FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name"
CITIES = "SELECT c_custkey AS pos, concat('Town ', CAST(c_custkey % 400 AS STRING)) AS name, '' AS admin1, concat(chr(65 + c_nationkey), chr(65 + c_nationkey)) AS country, CAST(c_custkey AS DOUBLE) AS lat, 3.5 AS lon FROM {customer}"
# every order names a place in one of six ways
PLACES = """SELECT CASE o_orderkey % 6 WHEN 0 THEN concat('Town ', CAST(o_custkey % 500 AS STRING), ', NATION_', CAST(o_orderkey % 25 AS STRING))
  WHEN 1 THEN concat('North Town ', CAST(o_custkey % 500 AS STRING), ' plant (AFRICA)') WHEN 2 THEN concat('nation_', CAST(o_orderkey % 30 AS STRING), ' province')
  WHEN 3 THEN 'Nowhere' WHEN 4 THEN concat('Town ', CAST(o_custkey % 500 AS STRING)) ELSE concat('ASIA campus near Town ', CAST(o_custkey % 500 AS STRING), ' works') END AS label,
  CASE WHEN o_orderkey % 6 = 3 THEN concat(chr(CAST(65 + o_custkey % 26 AS INT)), chr(CAST(65 + o_custkey % 26 AS INT))) WHEN o_orderkey % 12 = 4 THEN concat('Nation_', CAST(o_custkey % 25 AS STRING)) END AS hint FROM {orders}"""


def with_aliases(df):
    return df.withColumn("aliases", F.array().cast("array<string>"))


def gazetteer(spark, sf):
    return [with_aliases(frame(spark, sf, q)) for q in (COUNTRIES, REGIONS, CITIES)]


@query(
    "gazetteer_match",
    f"""WITH co AS ({duck(COUNTRIES)}), re AS ({duck(REGIONS)}), ci AS ({duck(CITIES)}), a AS (SELECT DISTINCT label, hint FROM ({duck(PLACES)})),
 p AS (SELECT label, hint, unnest(regexp_split_to_array(label, '\\s*(?:,|;|/|\\(|\\)|\\bin\\b|\\bnear\\b)\\s*')) AS t, generate_subscripts(regexp_split_to_array(label, '\\s*(?:,|;|/|\\(|\\)|\\bin\\b|\\bnear\\b)\\s*'), 1) AS part FROM a),
 w AS (SELECT label, hint, part, list_filter(string_split_regex(regexp_replace(lower(t), '\\b(facility|plant|factory|site|campus|province|city|state)\\b', '', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM p),
 ph AS (SELECT label, hint, part, i AS phrase, array_to_string(ws[i:], ' ') AS k FROM w, range(1, 20) r(i) WHERE i <= length(ws)
  UNION ALL SELECT label, hint, part, 100 - n, array_to_string(ws[1:n], ' ') FROM w, range(1, 20) r(n) WHERE n < length(ws)),
 nc AS (SELECT label, hint, arg_min(code, (part, phrase)) AS c FROM ph JOIN co ON lower(name) = k GROUP BY ALL),
 nr AS (SELECT label, hint, arg_min(country, (part, phrase)) AS c FROM ph JOIN re ON lower(name) = k GROUP BY ALL),
 x AS (SELECT a.label, a.hint, coalesce(h.code, h2.code, nc.c, nr.c) AS country FROM a LEFT JOIN co h ON upper(a.hint) = h.code LEFT JOIN co h2 ON lower(a.hint) = lower(h2.name)
  LEFT JOIN nc ON a.label = nc.label AND a.hint IS NOT DISTINCT FROM nc.hint LEFT JOIN nr ON a.label = nr.label AND a.hint IS NOT DISTINCT FROM nr.hint),
 bc AS (SELECT ph.label, ph.hint, arg_min(ci, (part, phrase, pos)) AS e FROM ph JOIN x ON ph.label = x.label AND ph.hint IS NOT DISTINCT FROM x.hint JOIN ci ON lower(ci.name) = k AND (x.country IS NULL OR ci.country = x.country) GROUP BY ALL),
 br AS (SELECT ph.label, ph.hint, arg_min(re, (part, phrase, pos)) AS e FROM ph JOIN x ON ph.label = x.label AND ph.hint IS NOT DISTINCT FROM x.hint JOIN re ON lower(re.name) = k AND (x.country IS NULL OR re.country = x.country) GROUP BY ALL)
SELECT x.label, x.hint, coalesce(bc.e.country, br.e.country, co.code) AS country_iso2, CASE WHEN bc.e IS NULL THEN br.e.name END AS admin1, bc.e.name AS city,
 CAST(coalesce(bc.e.lat, br.e.lat, co.lat) AS DOUBLE) AS lat, CASE WHEN bc.e IS NOT NULL THEN 'city' WHEN br.e IS NOT NULL THEN 'region' WHEN co.code IS NOT NULL THEN 'country' END AS precision
FROM x LEFT JOIN bc ON x.label = bc.label AND x.hint IS NOT DISTINCT FROM bc.hint LEFT JOIN br ON x.label = br.label AND x.hint IS NOT DISTINCT FROM br.hint LEFT JOIN co ON co.code = x.country""",
)
def gazetteer_match(spark, sf):
    return pl.resolve_places(frame(spark, sf, PLACES), *gazetteer(spark, sf)).drop("lon")


# suppliers are facilities in their nation; a claim places them in some nation
LOCATED_NODES = """SELECT concat('su:', CAST(s_suppkey AS STRING)) AS id, 'facility' AS kind, concat('N', CAST(s_nationkey AS STRING)) AS country_iso2, CAST(NULL AS STRING) AS iso2 FROM {supplier}
UNION ALL SELECT concat('na:', CAST(n_nationkey AS STRING)), 'geography', NULL, concat('N', CAST(n_nationkey AS STRING)) FROM {nation}"""
LOCATION_CLAIMS = """SELECT concat('c', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(CAST(l_quantity AS BIGINT) AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS claim_id,
 concat('su:', CAST(l_suppkey AS STRING)) AS subject_id, concat('na:', CAST(l_partkey % 50 AS STRING)) AS object_id, 'LOCATED_IN' AS predicate,
 CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted' END AS status, 'directly_supported' AS support_label, CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END AS evidence FROM {lineitem} WHERE l_linenumber = 7 AND l_discount > 0.06"""
EVIDENCED_SQL = f"""SELECT c.subject_id AS node_id, c.claim_id, c.support_label, n.country_iso2 FROM ({duck(LOCATION_CLAIMS)}) c JOIN ({duck(LOCATED_NODES)}) n ON c.subject_id = n.id
 JOIN ({duck(LOCATED_NODES)}) g ON c.object_id = g.id AND g.kind = 'geography' AND g.iso2 = n.country_iso2 WHERE c.status = 'accepted' AND c.evidence > 0"""


def evidenced(spark, sf):
    return pl.evidenced_locations(frame(spark, sf, LOCATED_NODES), frame(spark, sf, LOCATION_CLAIMS))


@query("evidenced_locations", EVIDENCED_SQL)
def evidenced_locations(spark, sf):
    return evidenced(spark, sf)


@query(
    "unlocated_facilities",
    f"SELECT id FROM ({duck(LOCATED_NODES)}) WHERE kind = 'facility' AND id NOT IN (SELECT node_id FROM ({EVIDENCED_SQL}))",
)
def unlocated_facilities(spark, sf):
    return pl.unlocated_facilities(frame(spark, sf, LOCATED_NODES), evidenced(spark, sf))


SUBJECTS = "SELECT concat('su:', CAST(s_suppkey AS STRING)) AS id, 'facility' AS kind, CASE WHEN s_suppkey % 3 = 0 THEN concat('N', CAST(s_nationkey AS STRING)) END AS country_iso2, CAST(NULL AS STRING) AS admin1, CAST(NULL AS STRING) AS city, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CASE WHEN s_suppkey % 3 = 0 THEN 'region' END AS precision FROM {supplier}"
OFFERED = """SELECT concat('su:', CAST(l_suppkey AS STRING)) AS subject_id, min(l_orderkey) AS ord, concat('c', CAST(min(l_orderkey) AS STRING)) AS claim_id, concat('N', CAST(l_partkey % 5 AS STRING)) AS country_iso2,
 CAST(NULL AS STRING) AS admin1, CAST(NULL AS STRING) AS city, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,
 CASE WHEN l_partkey % 100 = 0 THEN 'address' WHEN l_linenumber < 3 THEN 'city' WHEN l_linenumber < 5 THEN 'region' ELSE 'country' END AS precision
FROM {lineitem} GROUP BY l_suppkey, l_partkey % 5, CASE WHEN l_partkey % 100 = 0 THEN 'address' WHEN l_linenumber < 3 THEN 'city' WHEN l_linenumber < 5 THEN 'region' ELSE 'country' END"""


@query(
    "place_inheritance",
    f"""WITH o AS ({duck(OFFERED)}), l AS (SELECT id AS subject_id, NULL AS claim_id, -1 AS ord, country_iso2, precision FROM ({duck(SUBJECTS)}) WHERE country_iso2 IS NOT NULL UNION ALL SELECT subject_id, claim_id, ord, country_iso2, precision FROM o),
 b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY CASE precision WHEN 'address' THEN 0 WHEN 'city' THEN 1 WHEN 'region' THEN 2 ELSE 3 END, ord, country_iso2) = 1)
SELECT b.*, (SELECT count(DISTINCT o.claim_id) FROM o WHERE o.subject_id = b.subject_id AND o.ord > b.ord AND o.country_iso2 = b.country_iso2) AS later_claims FROM b""",
)
def place_inheritance(spark, sf):
    out = pl.inherit_places(frame(spark, sf, SUBJECTS), frame(spark, sf, OFFERED))
    return out.select(
        "subject_id", "claim_id", "ord", "country_iso2", "precision", "later_claims"
    )


ENRICHED = "SELECT concat('pt:', CAST(p_partkey AS STRING)) AS node_id, CASE WHEN p_size = 50 THEN NULL WHEN p_type = 'ECONOMY' THEN 'material' ELSE 'component' END AS kind, p_name FROM {part}"


@query(
    "enrichment_outcomes",
    f"""WITH n AS ({duck(ENRICHED)}), d AS (SELECT DISTINCT commodity FROM ({duck(DATASETS)})),
 x AS (SELECT node_id, kind, p_name, unnest(['concentration', 'geography', 'market']) AS layer FROM n)
SELECT node_id, layer, CASE WHEN kind IS NULL THEN 'unresolved' WHEN layer = 'concentration' AND kind <> 'material' THEN 'skipped'
  WHEN layer = 'concentration' AND p_name IN (SELECT commodity FROM d) THEN 'filled' WHEN layer = 'market' AND kind = 'material' AND p_name IN ('red bolt', 'old rod') THEN 'filled' ELSE 'unresolved' END AS outcome,
 CASE WHEN kind IS NULL THEN 'node_removed' WHEN layer = 'concentration' AND kind <> 'material' THEN 'not_a_material' WHEN layer = 'concentration' THEN CASE WHEN p_name IN (SELECT commodity FROM d) THEN NULL ELSE 'no_dataset' END
  WHEN layer = 'geography' THEN 'no_evidenced_location' WHEN kind = 'material' AND p_name IN ('red bolt', 'old rod') THEN NULL ELSE 'no_instrument' END AS reason FROM x""",
)
def enrichment_outcomes(spark, sf):
    nodes = frame(spark, sf, ENRICHED).withColumn("label_key", native_label_key("p_name"))
    data = frame(spark, sf, DATASETS)
    names = data.select(native_label_key("commodity").alias("label_key")).distinct()
    production = nodes.where("kind = 'material'").join(names, "label_key", "left_semi")
    none = nodes.where("node_id is null")
    out = pl.enrichment_outcomes(
        nodes.drop("p_name"), ["concentration", "geography", "market"], production, none,
        {"red bolt": "inst_a", "old rod": "inst_b"},
    )
    return out


@query(
    "job_status",
    """SELECT p_brand AS job_id, CASE WHEN bool_or(p_size = 50) OR bool_or(p_type <> 'ECONOMY') THEN 'partial' ELSE 'completed' END AS status, 2 * count(*) AS results FROM part GROUP BY p_brand""",
)
def job_status(spark, sf):
    """A job per brand that asks for concentration and market layers of every part."""
    nodes = frame(
        spark, sf,
        "SELECT p_brand AS job_id, p_partkey AS node_id, CASE WHEN p_size = 50 THEN NULL WHEN p_type = 'ECONOMY' THEN 'material' ELSE 'component' END AS kind, 'tin' AS label_key FROM {part}",
    )
    data = nodes.where("kind = 'material'")
    out = pl.enrichment_outcomes(nodes.drop("job_id"), ["concentration", "market"], data, data.where("false"))
    return pl.job_status(out.join(nodes.select("node_id", "job_id"), "node_id"), ["job_id"])
