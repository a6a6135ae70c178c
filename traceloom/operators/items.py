"""Estimated bills of materials: composed items with code-decided provenance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.text import native_label_key
from ..session import materialize
from .running import HOT_ROWS, top_per_key

FIELDS = ("quantity", "unit", "material", "manufacturer", "part_number", "notes")


def _kept_names(rows, max_items):
    first = rows.groupBy("request_id", "name_key").agg(F.min("ordinal").alias("first"))
    if max_items is None:
        return first
    return top_per_key(first, ["request_id"], ["first"], max_items).select("request_id", "name_key", "first")


def _filled(columns, order="ordinal"):
    """First non-NULL value of each field in order."""
    return [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns
    ]


def project_items(raw: DataFrame, registry: DataFrame, max_items=None, key=native_label_key, by_request=False, hot_rows=HOT_ROWS):
    """Merge composed rows into items: (items, sources, unknown ids).

    `raw` has request_id, ordinal, name, category, the optional fields, parent_name, evidence_ids,
    general_knowledge and confidence; `registry` request_id, evidence_id, ref_type and ref. All names
    are kept unless `max_items` asks for the first ones only. Rows of one name merge; basis and confidence come from the best-supported row, earliest first. An item's
    sources stay rows of their own table, since nothing bounds how many there are. The looked-up
    rows are written once for all tables, or with `by_request`, for callers that ask for one of them, dealt
    once by request and not written; requests of more than `hot_rows` rows then go by what they cite and by name.
    """
    rows = raw.withColumn("name_key", key(F.col("name")))
    rows = rows.where("request_id is not null and name_key is not null")
    if max_items is not None:
        rows = rows.join(_kept_names(rows, max_items), ["request_id", "name_key"]).drop("first")
    if not by_request:
        return _projected(rows, registry, key, keep=materialize)
    hot = materialize(rows.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("request_id"))
    if hot.isEmpty():
        return _projected(rows.repartition("request_id"), registry, key)
    rest = _projected(rows.join(hot, "request_id", "left_anti").repartition("request_id"), registry, key)
    some = _projected(rows.join(hot, "request_id", "left_semi"), registry, key, keep=materialize)
    return tuple(a.unionByName(b) for a, b in zip(rest, some))


def _projected(rows, registry, key, keep=lambda df: df):
    # rows that cite alike are looked up once, by what they cite: ordinals do not travel with each citation
    cited = rows.select("request_id", "evidence_ids").distinct()
    cited = cited.select("request_id", "evidence_ids", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    cited = cited.join(registry.select("request_id", "evidence_id", "ref_type", "ref"), ["request_id", "evidence_id"], "left")
    known = F.col("ref_type").isNotNull()
    cited = cited.groupBy("request_id", "evidence_ids").agg(
        F.bool_or(F.when(known, F.col("ref_type") == "web_page")).alias("web"),
        F.count_if(known).alias("refs"),
        F.collect_list(F.when(known, F.struct("ref_type", "ref"))).alias("found"),
        F.collect_list(F.when(~known, F.struct("evidence_id"))).alias("lost"),
    )
    rows = keep(rows.join(cited, ["request_id", "evidence_ids"], "left"))
    unknown = rows.select("request_id", F.explode("lost").alias("l"), "ordinal").select("request_id", "l.evidence_id", "ordinal")
    refs = rows.select("request_id", "name_key", F.explode("found").alias("f"), "ordinal").select(
        "request_id", "name_key", "f.ref_type", "f.ref", "ordinal")
    basis = F.when(F.col("web"), "evidenced").when(F.col("refs") > 0, "inferred").otherwise("guessed")
    rows = rows.withColumn("basis", basis)
    rows = rows.withColumn(
        "confidence",
        F.when((F.col("basis") == "guessed") & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence")),
    )
    rows = rows.withColumn(
        "own_knowledge",
        F.when(F.coalesce("refs", F.lit(0)) == 0, "no_source").when(F.col("general_knowledge"), "some_fields"),
    )
    rank = model.lookup(F.col("basis"), model.BASIS_RANK)
    items = rows.groupBy("request_id", "name_key").agg(
        F.min("ordinal").alias("first"),
        F.min_by(F.struct(F.trim("name").alias("name"), "category", "parent_name"), "ordinal").alias("h"),
        F.min_by(F.struct("basis", "confidence"), F.struct((-rank).alias("r"), "ordinal")).alias("b"),
        *_filled(FIELDS),
    )
    items = items.select(
        "request_id", "name_key", "first", "h.name", "h.category", "b.basis", "b.confidence", *FIELDS, key(F.col("h.parent_name")).alias("parent_key")
    )
    wholes = items.select("request_id", F.col("name_key").alias("parent_key"), F.lit(True).alias("has_parent"))
    items = items.join(wholes, ["request_id", "parent_key"], "left").withColumn(
        "parent_key", F.when(F.col("has_parent") & (F.col("parent_key") != F.col("name_key")), F.col("parent_key"))
    ).drop("has_parent")
    sources = refs.select("request_id", "name_key", "ref_type", "ref", "ordinal").unionByName(
        rows.where("own_knowledge is not null").select(
            "request_id", "name_key", F.lit("model_knowledge").alias("ref_type"), F.col("own_knowledge").alias("ref"), "ordinal"
        )
    )
    sources = sources.groupBy("request_id", "name_key", "ref_type", "ref").agg(F.min("ordinal").alias("ordinal"))
    return items, sources, unknown


def fallback_items(evidence: DataFrame, max_items=None, key=native_label_key) -> DataFrame:
    """Items straight from raw evidence when nothing was composed: never a guess."""
    rows = evidence.where(
        (F.coalesce("name", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != "")
    ).withColumn("name_key", key(F.col("name")))
    rows = rows.join(_kept_names(rows, max_items), ["request_id", "name_key"])
    web = F.bool_or(F.col("ref_type") == "web_page")
    fields = [F.min_by(c, "ordinal").alias(c) for c in ("name", "category", *FIELDS)]
    return rows.groupBy("request_id", "name_key").agg(
        F.min("ordinal").alias("first"),
        *fields,
        F.when(web, "evidenced").otherwise("inferred").alias("basis"),
        F.when(web, "medium").otherwise("low").alias("confidence"),
        F.count_distinct("ref").alias("sources"),
    )


def curated_items(documents: DataFrame, components: DataFrame) -> DataFrame:
    """Items of the curated set that documents support: a component whose span is in the text,
    composed with high confidence because the quote was located.

    `documents` has request_id, product, url, body; `components` product, label, span, rationale.
    """
    rows = documents.join(components, "product").where(F.contains("body", F.col("span")))
    return rows.select(
        "request_id",
        F.col("label").alias("name"),
        F.lit("component").alias("category"),
        F.col("rationale").alias("notes"),
        F.col("span").alias("quote"),
        "url",
        F.lit("high").alias("confidence"),
    )


def cited_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Source metadata of each imported item's citations."""
    refs = items.select("request_id", "item_id", F.explode("source_ids").alias("source_id")).distinct()
    return refs.join(sources, ["request_id", "source_id"])
