"""Claims, sources and the deterministic evidence score of an edge.

The operators take a *lineage* table: one row per (edge, claim, evidence) with the claim and the
source record joined in. `keys` names the columns that identify an edge; they stay in their native
type so that billions of rows are never re-keyed as text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import values
from ..session import materialize
from .components import count_groups

RANK_LABEL = {i: label for i, label in enumerate(model.SUPPORT_ORDER)}
LABEL_RANK = {label: i for i, label in RANK_LABEL.items()}


def lineage(edge_claims, claims, evidence, sources, keys) -> DataFrame:
    """Edge, claim, evidence and source joined, missing records kept and flagged."""
    rows = edge_claims.select(*keys, "claim_id").join(
        claims.drop(*[k for k in keys if k in claims.columns]).withColumn("claim_found", F.lit(True)),
        "claim_id",
        "left",
    )
    rows = rows.join(evidence, "claim_id", "left")
    rows = rows.join(sources.withColumn("source_found", F.lit(True)), "source_id", "left")
    return rows.withColumn("claim_found", F.coalesce("claim_found", F.lit(False))).withColumn(
        "source_found", F.coalesce("source_found", F.lit(False))
    )


def _disputed_claim():
    return (F.col("status") == "disputed") | (F.col("support_label") == "disputed")


def _label_aggregates(found=None):
    found = F.lit(True) if found is None else found
    rank = model.lookup(F.col("support_label"), LABEL_RANK)
    return [
        F.coalesce(F.bool_or(found & _disputed_claim()), F.lit(False)).alias("__disputed"),
        F.min(F.when(found & (F.col("status") == "accepted"), rank)).alias("__best"),
    ]


def _label():
    best = model.lookup(F.col("__best"), RANK_LABEL)
    return F.when(F.col("__disputed"), "disputed").otherwise(F.coalesce(best, F.lit("unresolved")))


def edge_support_labels(claims: DataFrame, keys) -> DataFrame:
    """Support label per edge: disputed if any claim is, else the best accepted label."""
    return (
        claims.groupBy(*keys)
        .agg(*_label_aggregates())
        .select(*keys, _label().alias("support_label"))
    )


def evidence_summary(rows: DataFrame, keys) -> DataFrame:
    """Distinct sources, independent families, latest publication and contradiction per edge.

    Sources collapse per edge before families are counted, so both distinct counts come from
    combinable aggregations instead of an expanded input.
    """
    contradicted = _disputed_claim() | (F.col("support_type") == "contradicts")
    group = F.when(
        F.col("source_found"), F.coalesce(F.col("family"), F.col("source_id").cast("string"))
    )
    # a source has one family, so it can be a grouping key: a maximum of text would sort instead
    # of hash
    per_source = (
        rows.withColumn("family", group)
        .groupBy(*keys, "source_id", "family")
        .agg(
            F.bool_or("source_found").alias("source_found"),
            F.max("published_at").alias("published_at"),
            F.bool_or(contradicted).alias("contradicted"),
        )
    )
    per_family = per_source.groupBy(*keys, "family").agg(
        F.count_if("source_found").alias("sources"),
        F.max("published_at").alias("published_at"),
        F.bool_or("contradicted").alias("contradicted"),
    )
    return per_family.groupBy(*keys).agg(
        F.sum("sources").alias("source_count"),
        F.count("family").alias("independent_family_count"),
        F.max("published_at").alias("latest_published_at"),
        F.coalesce(F.bool_or("contradicted"), F.lit(False)).alias("has_contradiction"),
    )


def edge_sources(rows: DataFrame, keys) -> DataFrame:
    """Sources of an edge's active claims with their sorted support types; a source without a
    record is kept with `source_found` false."""
    active = rows.where(F.col("claim_found") & (F.col("status") != "rejected"))
    return (
        active.groupBy(*keys, "source_id")
        .agg(
            F.bool_or("source_found").alias("source_found"),
            F.sort_array(F.collect_set("support_type")).alias("types"),
        )
        .select(*keys, "source_id", "source_found", F.array_join("types", ",").alias("support_types"))
    )


def missing_claims(edge_claims, claims, keys) -> DataFrame:
    """Claim ids an edge lists that have no claim record."""
    return edge_claims.join(claims.select("claim_id"), "claim_id", "left_anti").select(
        *keys, "claim_id"
    )


def missing_sources(evidence, sources) -> DataFrame:
    """Source ids cited by evidence that have no source record."""
    return evidence.join(sources.select("source_id"), "source_id", "left_anti")


def web_support():
    """Row predicate: usable support from a source that is not the user's own upload."""
    return _usable_support() & (F.coalesce(F.col("kind"), F.lit("other")) != "upload")


def _active():
    return F.col("claim_found") & (F.coalesce(F.col("status"), F.lit("")) != "rejected")


def _usable_support():
    return (
        _active()
        & F.col("source_found")
        & (F.col("support_type") == "supports")
        & (F.trim(F.coalesce(F.col("span"), F.lit(""))) != "")
    )


def source_pairs(rows: DataFrame, keys) -> DataFrame:
    """Distinct (family, document hash) pairs of an edge's web support."""
    return (
        rows.where(web_support())
        .select(
            *keys,
            F.coalesce("family", F.lit("unknown_family")).alias("family"),
            F.coalesce("content_hash", F.lit("unknown_content")).alias("content_hash"),
        )
        .distinct()
    )


def independent_groups(rows: DataFrame, keys) -> DataFrame:
    """Independent source groups per edge: copies and one publisher's pages count once."""
    return count_groups(materialize(source_pairs(rows, keys)), keys, "family", "content_hash")


def score_edges(rows: DataFrame, keys, created_at=None) -> DataFrame:
    """Evidence score, its factors and the observation time per edge.

    One pass folds the lineage to a row per (edge, publication, family, document) with a combinable
    aggregation; that rollup is written once and read by the label, grouping and freshness steps.
    """
    keys = list(keys)
    created = F.lit(created_at) if created_at is not None else F.lit(None).cast("timestamp_ntz")
    web = F.coalesce(web_support(), F.lit(False))
    marked = (
        rows.withColumn("web", web)
        .withColumn("active", F.coalesce(_active(), F.lit(False)))
        .withColumn("usable", F.coalesce(_usable_support(), F.lit(False)))
    )
    rollup = materialize(
        marked.groupBy(
            *keys,
            "web",
            F.when(F.col("web"), F.coalesce("family", F.lit("unknown_family"))).alias("family"),
            F.when(F.col("web"), F.coalesce("content_hash", F.lit("unknown_content"))).alias(
                "content_hash"
            ),
            F.when(F.col("web"), F.col("published_at")).alias("published_at"),
        ).agg(
            *_label_aggregates(F.col("claim_found")),
            F.bool_or(~F.col("claim_found")).alias("lost_claim"),
            F.bool_or(
                F.col("active") & F.col("source_id").isNotNull() & ~F.col("source_found")
            ).alias("lost_source"),
            F.max(F.when(F.col("active"), F.greatest("observed_at", "extracted_at"))).alias("seen"),
            F.max(F.when(F.col("active") & F.col("source_found"), F.col("retrieved_at"))).alias(
                "retrieved"
            ),
            F.bool_or(
                F.col("active") & ((F.col("support_type") == "contradicts") | _disputed_claim())
            ).alias("contradicted"),
            F.bool_or("usable").alias("supported"),
        )
    )
    edges = rollup.groupBy(*keys).agg(
        F.bool_or("__disputed").alias("__disputed"),
        F.min("__best").alias("__best"),
        F.bool_or("lost_claim").alias("lost_claim"),
        F.bool_or("lost_source").alias("lost_source"),
        F.coalesce(F.max("seen"), F.max("retrieved"), created).alias("observed"),
        F.bool_or("contradicted").alias("contradicted"),
        F.bool_or("supported").alias("supported"),
        F.bool_or("web").alias("web"),
    )
    published = (
        rollup.where(F.col("web") & F.col("published_at").isNotNull())
        .groupBy(*keys, "published_at")
        .agg(F.lit(1).alias("one"))
        .join(edges.select(*keys, "observed"), keys)
        .where(F.col("published_at") <= F.col("observed"))
        .groupBy(*keys)
        .agg(F.max("published_at").alias("published"))
    )
    pairs = rollup.where("web").select(*keys, "family", "content_hash").distinct()
    groups = count_groups(pairs, keys, "family", "content_hash")
    return _score(edges.join(published, keys, "left").join(groups, keys, "left"), keys)


def _score(edges, keys):
    zero = F.lit(0.0)
    label = _label()
    disputed = (label == "disputed") | F.coalesce("contradicted", F.lit(False))
    supported = F.coalesce("supported", F.lit(False))
    web = F.coalesce("web", F.lit(False))
    base = F.when(supported, model.lookup(F.col("support_label"), model.SCORE_BASE)).otherwise(zero)
    age = values.age_years("observed", "published")
    staged = (
        edges.withColumn("support_label", label)
        .withColumn("disputed", disputed)
        .withColumn("base", base)
        .withColumn(
            "base",
            F.when(web, F.col("base")).otherwise(
                F.least("base", F.lit(model.SCORE_BASE["user_asserted"]))
            ),
        )
        .withColumn("groups", F.coalesce("groups", F.lit(0)).cast("long"))
        .withColumn(
            "corroboration",
            F.least(F.lit(2), F.greatest(F.lit(0), F.col("groups") - 1)).cast("double") * F.lit(0.10),
        )
        .withColumn(
            "freshness",
            F.when(~web, zero)
            .when(F.col("published").isNull() | F.col("observed").isNull(), F.lit(-0.05))
            .when(age > 5, F.lit(-0.20))
            .when(age > 2, F.lit(-0.10))
            .otherwise(zero),
        )
        .withColumn("contradiction", F.when(F.col("disputed"), F.lit(-0.45)).otherwise(zero))
        .withColumn("incomplete", ~supported | F.col("lost_claim") | F.col("lost_source"))
    )
    total = F.col("base") + F.col("corroboration") + F.col("freshness") + F.col("contradiction")
    cap = F.when(F.col("disputed"), F.lit(model.SCORE_DISPUTED_CAP)).otherwise(
        F.lit(model.SCORE_MAX)
    )
    bounded = F.greatest(zero, F.least(cap, total))
    return staged.select(
        *keys,
        "support_label",
        F.when(F.col("incomplete"), zero)
        .otherwise(values.round_half_up_3(bounded))
        .alias("confidence"),
        "base",
        "corroboration",
        "freshness",
        "contradiction",
        F.col("groups").alias("supporting_families"),
        values.stamp_date("observed").alias("date"),
        values.stamp_time("observed").alias("time"),
    )


# ---------------------------------------------------------------- review and contradiction
def apply_reviews(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims with the status of their latest review (`verdict` accept, reject or dispute)."""
    latest = reviews.groupBy("claim_id").agg(
        F.max_by("verdict", F.struct("created_at", "verdict")).alias("verdict")
    )
    status = model.lookup(
        F.col("verdict"), {"accept": "accepted", "reject": "rejected", "dispute": "disputed"}
    )
    return (
        claims.join(latest, "claim_id", "left")
        .withColumn("status", F.coalesce(status, F.col("status")))
        .withColumn("reviewed", F.col("verdict").isNotNull())
        .drop("verdict")
    )


def relabel_reviewed_edges(claims: DataFrame, reviewed: DataFrame, keys) -> DataFrame:
    """Labels before and after review, for the edges a review touched only."""
    touched = reviewed.where("reviewed").select(*keys).distinct()
    before = edge_support_labels(claims.join(touched, list(keys), "left_semi"), keys)
    after = edge_support_labels(reviewed.join(touched, list(keys), "left_semi"), keys)
    return before.withColumnRenamed("support_label", "label_before").join(
        after.withColumnRenamed("support_label", "label_after"), list(keys)
    )


def contradiction_state(claims: DataFrame, keys) -> DataFrame:
    """Opposing-claim state of each claim within its relation key.

    A claim's contradicting claims are the ones of the same key and the other polarity, so the
    counts and the key identify them without listing pairs.
    """
    sides = claims.groupBy(*keys).agg(
        F.count_if(F.col("support_type") == "supports").alias("positives"),
        F.count_if(F.col("support_type") == "contradicts").alias("negatives"),
    )
    rows = claims.join(sides, list(keys))
    opposed = F.col("positives").cast("boolean") & F.col("negatives").cast("boolean")
    opposing = F.when(F.col("positives") == 0, F.lit(0)).when(
        F.col("support_type") == "contradicts", F.col("positives")
    ).otherwise(F.col("negatives"))
    return rows.select(
        *keys,
        "claim_id",
        opposing.cast("long").alias("contradiction_count"),
        F.when(opposed, "disputed").otherwise(F.col("status")).alias("status_after"),
        (F.col("positives") > 0).alias("has_edge"),
    )
