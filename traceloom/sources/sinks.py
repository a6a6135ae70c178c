"""Writers: graph snapshots, exports, GeoJSON and append-only logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import public
from ..operators.revisions import export_index


def save_revision(rows: DataFrame, path):
    """Write immutable snapshot rows partitioned by graph and revision. A retried write replaces the
    partitions of its revision instead of doubling them; other revisions are not touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "graph_id", "revision").parquet(path)


def append_events(events: DataFrame, path):
    events.write.mode("append").json(path)


def write_export(tables, path):
    """One JSON folder per entity of a graph export, private fields removed."""
    for name, df in tables.items():
        public(df).write.mode("overwrite").json(f"{path}/{name}")


def write_bundle(path, graph, sites, bills, events, runs):
    """Export bundle of a graph: its tables, sites, bills and events per run, and the run index.

    Bills and events are partitioned by run, so one job writes every run; the index keeps the latest
    entry of each run.
    """
    write_export(graph, f"{path}/graph")
    public(sites).write.mode("overwrite").json(f"{path}/sites")
    for name, df in (("bom", bills), ("events", events)):
        public(df).write.mode("overwrite").partitionBy("run_id").json(f"{path}/{name}")
    export_index(runs).write.mode("overwrite").json(f"{path}/index")


def facility_features(nodes: DataFrame, evidenced: DataFrame) -> DataFrame:
    """GeoJSON point features of facilities with an evidenced location and coordinates."""
    claims = evidenced.groupBy("node_id").agg(
        F.min_by("support_label", "claim_id").alias("support_label"), F.count("*").alias("claim_count")
    )
    rows = nodes.where("kind = 'facility' and lat is not null and lon is not null")
    rows = rows.join(claims, rows.id == claims.node_id)
    return rows.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                F.struct(
                    F.lit("facility").alias("feature_kind"),
                    F.col("id").alias("node_id"),
                    F.col("kind").alias("node_kind"),
                    "label",
                    "country_iso2",
                    "support_label",
                    "claim_count",
                ).alias("properties"),
            )
        ).alias("value")
    )


def country_features(shares: DataFrame) -> DataFrame:
    """GeoJSON features of country shares, one per country and material: always the same shape, and no
    list that grows with a country's materials."""
    properties = F.struct(
        F.lit("country").alias("feature_kind"), F.col("country").alias("country_iso2"), "material_node_id",
        "commodity", "share", "year")
    return shares.select(
        F.to_json(
            F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("geometry"), properties.alias("properties")),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def write_geojson(features: DataFrame, path):
    """One feature per line (newline-delimited GeoJSON)."""
    features.select("value").write.mode("overwrite").text(path)
