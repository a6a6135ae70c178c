"""Queries over claims, sources and edge scores."""

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import reviews as rw
from .catalog import query
from .lens import LENS, duck, frame, lens

EDGE = ["subject_id", "object_id"]
BRAND_EDGE = ["subject_id", "brand"]

RANK_SQL = """CASE support_label WHEN 'directly_supported' THEN 0 WHEN 'strongly_inferred' THEN 1
 WHEN 'weakly_inferred' THEN 2 WHEN 'user_asserted' THEN 3 WHEN 'unresolved' THEN 4 END"""


def label_sql(claims, keys):
    return f"""SELECT {keys}, CASE WHEN bool_or(status = 'disputed' OR support_label = 'disputed') THEN 'disputed'
 ELSE coalesce(['directly_supported','strongly_inferred','weakly_inferred','user_asserted','unresolved'][
   CAST(min(CASE WHEN status = 'accepted' THEN {RANK_SQL} END) + 1 AS BIGINT)], 'unresolved') END AS support_label
 FROM ({claims}) GROUP BY {keys}"""


@query("edge_support_label", label_sql(duck("claim"), "subject_id, object_id"))
def edge_support_label(spark, sf):
    return ev.edge_support_labels(lens(spark, sf, "claim"), EDGE)


@query(
    "evidence_summary",
    f"""SELECT subject_id, brand,
 CAST(count(DISTINCT source_id) FILTER (source_found) AS BIGINT) AS source_count,
 CAST(count(DISTINCT family) FILTER (source_found) AS BIGINT) AS independent_family_count,
 strftime(max(published_at), '%Y-%m-%d') AS latest_published_at,
 bool_or(status = 'disputed' OR support_label = 'disputed' OR support_type = 'contradicts') AS has_contradiction
FROM ({duck("brand_lineage")}) GROUP BY ALL""",
)
def evidence_summary(spark, sf):
    out = ev.evidence_summary(lens(spark, sf, "brand_lineage"), BRAND_EDGE)
    return out.withColumn(
        "latest_published_at", F.date_format("latest_published_at", "yyyy-MM-dd")
    )


@query(
    "edge_sources",
    f"""SELECT subject_id, brand, source_id, bool_or(source_found) AS source_found,
 array_to_string(list_sort(list(DISTINCT support_type)), ',') AS support_types
FROM ({duck("brand_lineage")}) WHERE claim_found AND status <> 'rejected' GROUP BY ALL""",
)
def edge_sources(spark, sf):
    return ev.edge_sources(lens(spark, sf, "brand_lineage"), BRAND_EDGE)


WEB_SQL = """claim_found AND status <> 'rejected' AND source_found AND support_type = 'supports'
 AND trim(span) <> '' AND kind <> 'upload'"""


def groups_sql(rows, keys):
    """Group count per edge by closure over shared family or document hash."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    cols = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    plain = ", ".join(keys)
    return f"""pairs AS (SELECT DISTINCT {plain}, family, content_hash FROM ({rows}) WHERE {WEB_SQL}),
 links AS (SELECT DISTINCT {cols("a")}, a.family AS f, b.family AS g FROM pairs a JOIN pairs b
   ON {on("a", "b")} AND a.content_hash = b.content_hash),
 reach AS (SELECT DISTINCT {plain}, family AS f0, family AS f FROM pairs
   UNION SELECT {cols("r")}, r.f0, l.g FROM reach r JOIN links l ON {on("r", "l")} AND r.f = l.f),
 grp AS (SELECT {plain}, CAST(count(DISTINCT root) AS BIGINT) AS groups FROM
   (SELECT {plain}, f0, min(f) AS root FROM reach GROUP BY {plain}, f0) GROUP BY {plain})"""


@query(
    "independent_groups",
    f"WITH RECURSIVE {groups_sql(duck('brand_lineage'), BRAND_EDGE)} SELECT * FROM grp",
)
def independent_groups(spark, sf):
    return ev.independent_groups(lens(spark, sf, "brand_lineage"), BRAND_EDGE)


SCORE_SQL = f"""WITH RECURSIVE rows_ AS ({duck("lineage")}), {groups_sql("SELECT * FROM rows_", EDGE)},
lab AS ({label_sql("SELECT * FROM rows_ WHERE claim_found", "subject_id, object_id")}),
agg AS (SELECT subject_id, object_id,
  bool_or(NOT claim_found) AS lost_claim,
  bool_or(claim_found AND status <> 'rejected' AND NOT source_found) AS lost_source,
  max(observed_at) FILTER (claim_found AND status <> 'rejected') AS observed,
  bool_or(claim_found AND status <> 'rejected' AND (support_type = 'contradicts' OR status = 'disputed')) AS contradicted,
  bool_or(claim_found AND status <> 'rejected' AND source_found AND support_type = 'supports' AND trim(span) <> '') AS supported,
  coalesce(bool_or({WEB_SQL}), false) AS web
 FROM rows_ GROUP BY ALL),
pub AS (SELECT r.subject_id, r.object_id, max(r.published_at) AS published FROM rows_ r
  JOIN agg a ON r.subject_id = a.subject_id AND r.object_id = a.object_id
  WHERE {WEB_SQL} AND published_at <= a.observed GROUP BY ALL),
f AS (SELECT a.*, coalesce(lab.support_label, 'unresolved') AS support_label, pub.published, coalesce(grp.groups, 0) AS groups,
  (coalesce(lab.support_label, '') = 'disputed' OR coalesce(a.contradicted, false)) AS disputed,
  date_diff('second', pub.published, a.observed)::DOUBLE / 31557600 AS age
 FROM agg a LEFT JOIN lab USING (subject_id, object_id) LEFT JOIN pub USING (subject_id, object_id)
 LEFT JOIN grp USING (subject_id, object_id)),
g AS (SELECT *, CASE WHEN NOT coalesce(supported, false) THEN 0.0::DOUBLE ELSE least(CASE WHEN web THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END,
  CASE support_label WHEN 'directly_supported' THEN 0.70::DOUBLE WHEN 'strongly_inferred' THEN 0.50::DOUBLE WHEN 'weakly_inferred' THEN 0.30::DOUBLE
   WHEN 'disputed' THEN 0.70::DOUBLE WHEN 'user_asserted' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) END AS base,
  least(2, greatest(0, groups - 1))::DOUBLE * 0.10::DOUBLE AS corroboration,
  CASE WHEN NOT web THEN 0.0::DOUBLE WHEN published IS NULL THEN -0.05::DOUBLE WHEN age > 5 THEN -0.20::DOUBLE WHEN age > 2 THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END AS freshness,
  CASE WHEN disputed THEN -0.45::DOUBLE ELSE 0.0::DOUBLE END AS contradiction FROM f)
SELECT subject_id, object_id, support_label,
 CASE WHEN NOT coalesce(supported, false) OR lost_claim OR lost_source THEN 0.0::DOUBLE ELSE
  floor(greatest(0.0::DOUBLE, least(CASE WHEN disputed THEN 0.25::DOUBLE ELSE 0.95::DOUBLE END, base + corroboration + freshness + contradiction))
   * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE END AS confidence,
 base, corroboration, freshness, contradiction, groups AS supporting_families,
 strftime(observed, '%Y-%m-%d') AS date, strftime(observed, '%H:%M:%S.') || '000Z' AS time
FROM g"""


@query("edge_confidence", SCORE_SQL)
def edge_confidence(spark, sf):
    return ev.score_edges(scored_rows(spark, sf), EDGE)


def scored_rows(spark, sf):
    return (
        lens(spark, sf, "lineage")
        .withColumn("extracted_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("retrieved_at", F.lit(None).cast("timestamp_ntz"))
    )


@query(
    "missing_lineage",
    f"""WITH c AS ({duck("claim")}), s AS ({duck("source")})
SELECT subject_id, object_id, CAST(count(*) FILTER (what = 'claim') AS BIGINT) AS missing_claims,
 CAST(count(*) FILTER (what = 'source') AS BIGINT) AS missing_sources FROM (
 SELECT subject_id, object_id, 'claim' AS what FROM c WHERE NOT claim_found
 UNION ALL SELECT DISTINCT subject_id, object_id, 'source' || source_id FROM c WHERE false
 UNION ALL SELECT subject_id, object_id, 'source' FROM (SELECT DISTINCT subject_id, object_id, source_id FROM c
   WHERE claim_found AND status <> 'rejected' AND source_id NOT IN (SELECT source_id FROM s)))
GROUP BY ALL""",
)
def missing_lineage(spark, sf):
    listed = lens(spark, sf, "claim")
    stored = listed.where("claim_found").select("claim_id")
    lost = ev.missing_claims(listed, stored, EDGE).select(
        *EDGE, F.lit(1).alias("c"), F.lit(0).alias("s")
    )
    active = listed.where("claim_found and status <> 'rejected'").select(*EDGE, "source_id")
    uncited = (
        ev.missing_sources(active, lens(spark, sf, "source"))
        .distinct()
        .select(*EDGE, F.lit(0).alias("c"), F.lit(1).alias("s"))
    )
    return (
        lost.union(uncited)
        .groupBy(*EDGE)
        .agg(F.sum("c").alias("missing_claims"), F.sum("s").alias("missing_sources"))
    )


REVIEWS = f"""SELECT c.claim_id, CASE WHEN l.toxic = 1 THEN 'dispute' WHEN l.quality = 0 THEN 'reject'
  ELSE 'accept' END AS verdict, l.doc_id AS created_at
FROM ({duck("claim").replace("lineitem", "{lineitem}")}) c JOIN {{labels}} l ON c.source_id = l.doc_id"""


@query(
    "claim_review",
    f"""WITH c AS ({duck("claim")}), r AS ({duck(REVIEWS)}),
 n AS (SELECT c.* EXCLUDE (status), CASE r.verdict WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected'
   WHEN 'dispute' THEN 'disputed' ELSE c.status END AS status, r.verdict IS NOT NULL AS reviewed
   FROM c LEFT JOIN (SELECT DISTINCT claim_id, verdict FROM r) r ON c.claim_id = r.claim_id),
 t AS (SELECT DISTINCT subject_id, object_id FROM n WHERE reviewed),
 b AS ({label_sql("SELECT c.* FROM c SEMI JOIN t ON c.subject_id = t.subject_id AND c.object_id = t.object_id", "subject_id, object_id")}),
 a AS ({label_sql("SELECT n.* FROM n SEMI JOIN t ON n.subject_id = t.subject_id AND n.object_id = t.object_id", "subject_id, object_id")})
SELECT subject_id, object_id, b.support_label AS label_before, a.support_label AS label_after FROM b JOIN a USING (subject_id, object_id)""",
)
def claim_review(spark, sf):
    claims = lens(spark, sf, "claim")
    reviewed = ev.apply_reviews(claims, frame(spark, sf, REVIEWS))
    return ev.relabel_reviewed_edges(claims, reviewed, EDGE)


# a graph per supplier; a few sources' claims are reviewed, some of them twice
SCORE_REVIEWS = f"""SELECT concat(c.claim_id, '-', CAST(k.n AS STRING)) AS review_id, c.claim_id, CASE (c.source_id + k.n) % 3 WHEN 0 THEN 'dispute' WHEN 1 THEN 'reject' ELSE 'accept' END AS verdict,
 'seen' AS note, CAST(c.source_id * 2 + k.n AS BIGINT) AS created_at FROM (SELECT DISTINCT claim_id, source_id FROM ({LENS["claim"]}) x WHERE source_id % 50 = 7) c CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) k
 WHERE k.n = 0 OR c.source_id % 100 = 7"""
LATEST_SQL = f"(SELECT claim_id, arg_max(verdict, created_at) AS verdict, count(*) AS n FROM ({duck(SCORE_REVIEWS)}) GROUP BY ALL)"
VERDICT_SQL = "CASE v.verdict WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'dispute' THEN 'disputed' ELSE x.status END"


def reviewed_sql(body):
    """The score of every edge before and after the reviews, both from scratch."""
    before = SCORE_SQL.replace("WITH RECURSIVE ", "", 1)
    rows = f"SELECT x.* EXCLUDE (status), {VERDICT_SQL} AS status FROM ({duck('lineage')}) x LEFT JOIN {LATEST_SQL} v ON x.claim_id = v.claim_id"
    after = before.replace(f"rows_ AS ({duck('lineage')})", f"rows_ AS ({rows})", 1)
    return f"WITH b AS (WITH RECURSIVE {before}), a AS (WITH RECURSIVE {after}), t AS (SELECT DISTINCT x.subject_id, x.object_id FROM ({duck('lineage')}) x JOIN {LATEST_SQL} v ON x.claim_id = v.claim_id WHERE x.status <> {VERDICT_SQL}) {body}"


def reviewed(spark, sf):
    rows = scored_rows(spark, sf).withColumn("graph_id", F.col("subject_id"))
    graphs = rows.select("graph_id").distinct().withColumn("revision", F.lit(3))
    return rw.review(rows, None, frame(spark, sf, SCORE_REVIEWS), graphs, EDGE, hot_rows=500)


@query("review_scores", reviewed_sql("SELECT a.* FROM a"))
def review_scores(spark, sf):
    """The whole score view after the reviews, touched edges rescored only."""
    return reviewed(spark, sf).scores


@query("review_changes", reviewed_sql("""SELECT subject_id, object_id, b.support_label AS label_before, a.support_label AS label_after, b.confidence AS confidence_before,
 a.confidence AS confidence_after FROM t JOIN a USING (subject_id, object_id) JOIN b USING (subject_id, object_id)"""))
def review_changes(spark, sf):
    """Touched edges with label and score before and after."""
    return reviewed(spark, sf).changes


@query("review_label_counts", reviewed_sql("""SELECT graph_id, support_label, CAST(sum(n) AS BIGINT) AS change FROM (SELECT subject_id AS graph_id, support_label, 1 AS n FROM a
 UNION ALL SELECT subject_id, support_label, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0"""))
def review_label_counts(spark, sf):
    """Change of each graph's edge counts per label."""
    return reviewed(spark, sf).labels


@query(
    "review_revisions",
    f"""SELECT subject_id AS graph_id, review_id, r.claim_id, verdict, 2 + row_number() OVER w AS revision_before, 3 + row_number() OVER w AS revision_after
FROM (SELECT DISTINCT claim_id, subject_id FROM ({duck("claim")})) c JOIN ({duck(SCORE_REVIEWS)}) r ON c.claim_id = r.claim_id WINDOW w AS (PARTITION BY subject_id ORDER BY created_at, review_id)""",
)
def review_revisions(spark, sf):
    """One revision per graph and review."""
    return reviewed(spark, sf).revisions


@query(
    "review_notes",
    f"""SELECT r.claim_id, any_value(c.status) AS status_before, CASE arg_max(verdict, created_at) WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'disputed' END AS status,
 string_agg(created_at || ' user ' || verdict || ': seen', ';' ORDER BY created_at) AS notes FROM ({duck(SCORE_REVIEWS)}) r JOIN (SELECT DISTINCT claim_id, status FROM ({duck("claim")})) c ON c.claim_id = r.claim_id GROUP BY ALL""",
)
def review_notes(spark, sf):
    """Reviewed claims with their status and notes."""
    return reviewed(spark, sf).claims.withColumn("notes", F.array_join("notes", ";"))


@query(
    "contradictions",
    f"""WITH c AS ({duck("claim")}), k AS (SELECT subject_id, object_id, scope_type,
  count(*) FILTER (support_type = 'supports') AS p, count(*) FILTER (support_type = 'contradicts') AS n FROM c GROUP BY ALL)
SELECT c.subject_id, c.object_id, c.scope_type, c.claim_id,
 CAST(CASE WHEN k.p = 0 THEN 0 WHEN c.support_type = 'contradicts' THEN k.p ELSE k.n END AS BIGINT) AS contradiction_count,
 CASE WHEN k.p > 0 AND k.n > 0 THEN 'disputed' ELSE c.status END AS status_after, k.p > 0 AS has_edge
FROM c JOIN k USING (subject_id, object_id, scope_type)""",
)
def contradictions(spark, sf):
    return ev.contradiction_state(lens(spark, sf, "claim"), EDGE + ["scope_type"])
