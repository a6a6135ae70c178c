"""Production concentration, maker and supplier distributions, and located sites."""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .. import model
from .running import top_per_key


# ---------------------------------------------------------------- production
def country_totals(rows: DataFrame, by) -> DataFrame:
    """Quantity and unallocated quantity per dataset and country."""
    return rows.groupBy(*by, "country").agg(
        F.sum("quantity").alias("quantity"), F.sum("unallocated").alias("unallocated")
    )


def concentration(totals: DataFrame, by) -> DataFrame:
    """HHI (a lower bound), top share and coverage per dataset, from country totals.

    Sums and sums of squares are enough, so no country row is ever revisited.
    """
    quantity = F.col("quantity").cast("double")
    sums = totals.groupBy(*by).agg(
        F.sum("quantity").alias("allocated"),
        F.sum("unallocated").alias("unallocated"),
        F.sum(quantity * quantity).alias("squares"),
        F.max("quantity").alias("largest"),
        F.min_by("country", F.struct(-F.col("quantity"), F.col("country"))).alias("top_country"),
    )
    total = (F.col("allocated") + F.col("unallocated")).cast("double")
    return sums.where(F.col("allocated") > 0).select(
        *by,
        (F.col("squares") / (total * total)).alias("hhi"),
        (F.col("largest") / total).alias("top_share"),
        "top_country",
        (F.lit(100.0) * F.col("allocated") / total).alias("coverage_pct"),
    )


def country_shares(totals: DataFrame, by) -> DataFrame:
    """Share rows per dataset, ranked by share then country.

    The window runs over country totals, so a partition holds at most one row per country.
    """
    dataset = W.partitionBy(*by)
    total = F.sum(F.col("quantity") + F.col("unallocated")).over(dataset)
    ranked = totals.withColumn("total", total).withColumn(
        "rank", F.row_number().over(dataset.orderBy(F.col("quantity").desc(), "country"))
    )
    return ranked.select(
        *by,
        "country",
        (F.col("quantity").cast("double") / F.col("total")).alias("share"),
        F.col("rank").cast("long").alias("rank"),
    )


def invalid_production(rows: DataFrame) -> DataFrame:
    """Production datasets that break a rule, with the first reason."""
    code_ok = F.coalesce(F.col("country"), F.lit("")).rlike("^[A-Z]{2}$")
    per = rows.groupBy("commodity", "year", "stage").agg(
        F.bool_or(~code_ok).alias("bad_code"),
        F.bool_or(F.col("quantity") < 0).alias("negative"),
        F.sum("quantity").alias("total"),
        F.count_distinct("dataset_id").alias("datasets"),
    )
    reason = (
        F.when(F.col("datasets") > 1, "duplicate_dataset")
        .when(F.col("bad_code"), "country_code")
        .when(F.col("negative"), "negative_quantity")
        .when(F.col("total") <= 0, "total_not_positive")
    )
    return per.select("commodity", "year", "stage", reason.alias("reason")).where("reason is not null")


def match_production(labels: DataFrame, datasets: DataFrame, year=None, stage=None) -> DataFrame:
    """Best production dataset per material label: the latest year, then the mine stage.

    `labels` has `label_key`; `datasets` has `name_key` (commodity or alias), `commodity`, `year`
    and `stage`. Datasets fold to one row per name before the join, so a popular label stays cheap.
    """
    if year is not None:
        datasets = datasets.where(F.col("year") == year)
    if stage is not None:
        datasets = datasets.where(F.col("stage") == stage)
    best = datasets.groupBy("name_key").agg(
        F.max_by(
            F.struct("commodity", "year", "stage"),
            F.struct("year", (F.col("stage") == "mine").cast("int").alias("mine"), "commodity", "stage"),
        ).alias("d")
    )
    return labels.join(best, labels.label_key == best.name_key).select(
        *labels.columns, "d.commodity", "d.year", "d.stage"
    )


def commodity_reference(datasets: DataFrame) -> DataFrame:
    """Years and stages available per commodity (both sets are small by nature)."""
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return datasets.groupBy("commodity").agg(
        join(F.col("year").cast("string")).alias("years"), join("stage").alias("stages")
    )


# ---------------------------------------------------------------- distributions
def distribution(edges: DataFrame, target="target_node_id") -> DataFrame:
    """Each source's share of a target: stated, or a uniform prior over what is unassigned.

    `edges` has one row per source, target and predicate with a nullable `weight`.
    """
    totals = edges.groupBy(target).agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("__stated"),
        F.count_if(F.col("weight").isNull()).alias("__unstated"),
    )
    unassigned = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("__stated"))
    return edges.join(totals, target).select(
        *edges.columns,
        F.when(F.col("weight").isNotNull(), "stated").otherwise("uniform_prior").alias("basis"),
        F.when(
            F.col("weight").isNull(), F.round(unassigned / F.col("__unstated"), 4)
        ).alias("share_estimate"),
        F.round(F.least(F.lit(1.0), F.col("__stated")), 4).alias("stated_total"),
        F.round(unassigned, 4).alias("unassigned"),
    )


def graph_distributions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Maker and supplier distributions of a graph's nodes, with the family of each."""
    kinds = nodes.select(F.col("id").alias("target_node_id"), F.col("kind").alias("__kind"))
    joined = edges.join(kinds, "target_node_id")
    makers = F.col("predicate").isin(*model.MAKER_PREDICATES) & F.col("__kind").isin(
        "product", "component", "material"
    )
    suppliers = (F.col("predicate") == "SUPPLIES") & F.col("__kind").isin("organization", "facility")
    family = F.when(makers, "makers").when(suppliers, "suppliers")
    rows = joined.withColumn("family", family).where("family is not null").drop("__kind")
    keyed = rows.withColumn("__target", F.struct("target_node_id", "family"))
    return distribution(keyed, "__target").drop("__target")


# ---------------------------------------------------------------- sites
def operator_plants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(organization, plant) pairs: OPERATES as stated, OWNED_BY reversed, plants only."""
    org_plant = edges.where(F.col("predicate") == "OPERATES").select(
        F.col("source_node_id").alias("organization_id"), F.col("target_node_id").alias("plant_id")
    )
    owned = edges.where(F.col("predicate") == "OWNED_BY").select(
        F.col("target_node_id").alias("organization_id"), F.col("source_node_id").alias("plant_id")
    )
    plants = nodes.where(F.col("kind") == "facility").select(F.col("id").alias("plant_id"))
    return org_plant.union(owned).join(plants, "plant_id", "left_semi")


def site_makes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What each located facility or organization makes or supplies, with its share.

    A plant inherits its operators' rows, split over the operator's located plants, unless it has
    the same (target, predicate) itself or from an earlier operator. Rows, not lists: one site may
    make anything.
    """
    located = nodes.where(
        F.col("kind").isin("facility", "organization")
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
    ).select(F.col("id").alias("node_id"), F.col("kind").alias("site_kind"))
    shares = graph_distributions(edges, nodes).select(
        F.col("source_node_id").alias("maker_id"),
        "target_node_id",
        "predicate",
        F.coalesce("weight", "share_estimate").alias("share"),
        "basis",
    )
    own = shares.join(located, shares.maker_id == located.node_id).select(
        "node_id",
        "target_node_id",
        "predicate",
        "share",
        F.col("basis").alias("share_basis"),
        F.lit(None).cast(nodes.schema["id"].dataType).alias("via_organization_id"),
    )
    pairs = operator_plants(edges, nodes)
    with_place = nodes.where(F.col("country").isNotNull()).select(F.col("id").alias("plant_id"))
    counts = (
        pairs.join(with_place, "plant_id", "left_semi")
        .groupBy("organization_id")
        .agg(F.count("*").alias("n"))
    )
    plants = located.where(F.col("site_kind") == "facility").select(F.col("node_id").alias("plant_id"))
    inherited = (
        pairs.join(plants, "plant_id", "left_semi")
        .join(counts, "organization_id", "left")
        .join(shares, F.col("organization_id") == F.col("maker_id"))
    )
    split = F.coalesce("n", F.lit(1)) > 1
    inherited = inherited.select(
        F.col("plant_id").alias("node_id"),
        "target_node_id",
        "predicate",
        F.when(split, F.round(F.col("share") / F.col("n"), 4)).otherwise(F.col("share")).alias("share"),
        F.when(split, F.concat("basis", F.lit("_over_plants")))
        .otherwise(F.col("basis"))
        .alias("share_basis"),
        F.col("organization_id").alias("via_organization_id"),
    )
    key = ["node_id", "target_node_id", "predicate"]
    first = inherited.groupBy(*key).agg(
        F.min_by(F.struct("share", "share_basis"), "via_organization_id").alias("r"),
        F.min("via_organization_id").alias("via_organization_id"),
    )
    first = first.select(*key, "r.share", "r.share_basis", "via_organization_id")
    return own.unionByName(first.join(own.select(*key), key, "left_anti"))


def site_summary(nodes: DataFrame, makes: DataFrame, operators: DataFrame) -> DataFrame:
    """One row per pin worth showing: a located site with something made or a known operator."""
    made = makes.groupBy("node_id").agg(F.count("*").alias("makes"))
    run = operators.groupBy(F.col("plant_id").alias("node_id")).agg(F.count("*").alias("operators"))
    located = nodes.where(
        F.col("kind").isin("facility", "organization")
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
    )
    return (
        located.join(made, located.id == made.node_id, "left")
        .drop("node_id")
        .join(run, located.id == run.node_id, "left")
        .select(
            F.col("id").alias("node_id"),
            F.when(F.col("kind") == "facility", "plant").otherwise("organization").alias("role"),
            "label",
            "country",
            F.coalesce("makes", F.lit(0)).alias("makes"),
            F.coalesce("operators", F.lit(0)).alias("operators"),
        )
        .where("makes > 0 or operators > 0")
    )


def pins(summary: DataFrame, anchor_label=None) -> DataFrame:
    """Pins in display order: plants before organizations, then by label, without the anchor."""
    if anchor_label is not None:
        summary = summary.where(F.lower("label") != anchor_label.lower())
    return summary.orderBy(F.when(F.col("role") == "plant", 0).otherwise(1), "label")


def site_totals(summary: DataFrame) -> DataFrame:
    """Counts over the pins shown."""
    return summary.agg(
        F.count("*").alias("sites"),
        F.count_if(F.col("role") == "organization").alias("organizations"),
        F.count_if(F.col("role") == "plant").alias("plants"),
        F.count_distinct("country").alias("countries"),
        F.coalesce(F.sum("makes"), F.lit(0)).alias("connections"),
    )


def leading_makes(makes: DataFrame, k=3) -> DataFrame:
    """The first `k` makes per site by share, for a one-line description."""
    return top_per_key(
        makes, ["node_id"], [F.col("share").desc_nulls_last(), "target_node_id", "predicate"], k
    )
