"""Readers for bills of materials, estimates, production tables, gazetteers and curated documents.

Each reader validates with DataFrame operations and returns its rejects as tables beside the rows.
"""

import csv
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.text import native_label_key
from ..functions.values import canonical_json
from ..operators.traverse import parent_faults

# ---------------------------------------------------------------- fixed values
LABEL_COLUMNS = ("component", "part", "part_name", "name", "material", "description")
# ---------------------------------------------------------------- end of fixed values

GAZETTEER = "gazetteer.json"  # our own small table, shipped with the package


def _header(spark, path):
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        raise ValueError("the first line of the CSV has no column names")
    names = next(csv.reader([first[0][0].lstrip("﻿")]))
    names = [n.strip().lower().replace(" ", "_") for n in names]
    if any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError("a column name of the CSV is empty or stands twice")
    if not any(n in names for n in LABEL_COLUMNS):
        raise ValueError("no label column in the CSV; one of these is needed: " + ", ".join(LABEL_COLUMNS))
    return names


def read_bom_csv(spark, path):
    """Bill-of-materials CSV: (rows, rejects, warnings).

    Rows carry label, kind, quantity, unit and the canonical JSON span; rejects hold the reason;
    warnings tell which quantities are unknown. Size caps of an upload form are left to the caller.
    """
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("escape", '"')
        .csv(path)
    )
    label_column = next(c for c in LABEL_COLUMNS if c in names)
    cells = {n: F.trim(F.coalesce(F.col(n), F.lit(""))) for n in names}
    raw = raw.withColumns(cells)
    quantity = "quantity" if "quantity" in names else "qty" if "qty" in names else None
    text = F.col(quantity) if quantity else F.lit("")
    number = text.try_cast("double")
    finite = (number >= 0) & (number < F.lit(float("inf"))) & ~F.isnan(number)
    kind = F.col("kind") if "kind" in names else F.lit("material" if label_column == "material" else "component")
    unit = F.nullif(F.col("unit"), F.lit("")) if "unit" in names else F.lit(None).cast("string")
    rows = raw.select(
        F.col(label_column).alias("label"),
        kind.alias("kind"),
        F.when(finite, number).alias("quantity"),
        unit.alias("unit"),
        text.alias("raw_quantity"),
        F.col("_corrupt"),
        # every column is read, or the parser would not see ragged rows
        F.length(F.concat(*names)).alias("read"),
    )
    span = canonical_json(F.col("label").alias("component"), "kind", "quantity", "unit")
    rows = rows.withColumn("span", span)
    reason = (
        F.when(F.col("_corrupt").isNotNull() | (F.col("read") < 0), "ragged_row")
        .when(F.col("label") == "", "label_empty")
        .when(~F.col("kind").isin("component", "material"), "kind")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null")
    warning = F.when(F.col("raw_quantity") == "", "quantity_unknown").when(F.col("quantity").isNull(), "quantity_invalid")
    return (
        good.select("label", "kind", "quantity", "unit", "span"),
        rows.where("reason is not null").select("label", "reason"),
        good.select("label", "raw_quantity", warning.alias("warning")).where("warning is not null"),
    )


REF = (
    "struct<type:string,source_id:string,url:string,title:string,quote:string,locator:string,"
    "claimed_quote:string,snippet:string,query:string,field:string,note:string>"
)
ITEM = (
    "struct<id:string,name:string,category:string,quantity:double,unit:string,material:string,"
    "manufacturer:string,part_number:string,parent_item_id:string,notes:string,basis:string,"
    f"confidence:string,sources:array<{REF}>>"
)
ESTIMATE = (
    f"id string, status string, product struct<name:string,brand:string>, items array<{ITEM}>, "
    "sources array<struct<id:string,url:string>>"
)


def read_estimates(spark, path, multi_line=True):
    """Imported bill-of-materials estimates: (items, sources) with one row each and estimate_id.

    `multi_line` reads one document per file; otherwise one per line, which splits over tasks.
    """
    raw = spark.read.schema(ESTIMATE).option("multiLine", multi_line).json(path)
    items = raw.select(F.col("id").alias("estimate_id"), "status", F.col("product.name").alias("product"), F.explode("items").alias("i"))
    items = items.select("estimate_id", "status", "product", "i.*")
    sources = raw.select(F.col("id").alias("estimate_id"), F.posexplode("sources").alias("pos", "s")).select(
        "estimate_id", "pos", "s.id", "s.url"
    )
    return items, sources


def product_mismatches(items: DataFrame, requests: DataFrame, key=native_label_key) -> DataFrame:
    """Requests (estimate_id, product) whose product is not the estimate's own."""
    own = items.select("estimate_id", F.col("product").alias("estimated")).distinct()
    return requests.join(own, "estimate_id").where(key(F.col("product")) != key(F.col("estimated")))


def estimate_violations(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(estimate_id, id, reason) of every rule an imported estimate breaks."""
    twice = lambda df, reason: df.groupBy("estimate_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("estimate_id", "id", F.lit(reason).alias("reason"))
    key = lambda c: F.struct(F.col("estimate_id").alias("e"), F.col(c).alias("i"))
    links = items.dropDuplicates(["estimate_id", "id"]).select(
        key("id").alias("id"), F.when(F.col("parent_item_id").isNotNull(), key("parent_item_id")).alias("parent_id")
    )
    faults = parent_faults(links).select(
        F.col("id.e").alias("estimate_id"), F.col("id.i").alias("id"), F.concat(F.lit("parent_"), "fault").alias("reason")
    )
    cited = items.select("estimate_id", "id", F.explode("sources").alias("ref"))
    lost = (
        cited.where("ref.source_id is not null")
        .join(sources.select("estimate_id", F.col("id").alias("sid")), (cited.estimate_id == sources.estimate_id) & (F.col("ref.source_id") == F.col("sid")), "left_anti")
        .select("estimate_id", "id", F.lit("source_missing"))
        .distinct()
    )
    private = cited.where(F.col("ref.url").isNotNull() & ~urls.public_url("ref.url")).select("estimate_id", "id", F.lit("source_not_public")).distinct()
    return twice(items, "item_id_repeated").union(twice(sources, "source_id_repeated")).union(faults).union(lost).union(private)


PRODUCTION = (
    "commodity string, aliases array<string>, year int, stage string, unit string, url string, title string, "
    "publisher string, locator string, production map<string,double>, unallocated_production double, notes array<string>"
)


def read_production(spark, path) -> DataFrame:
    """Production datasets as one row per country, the unallocated quantity on one row of each."""
    raw = spark.read.schema(PRODUCTION).option("multiLine", True).json(path)
    raw = raw.withColumn("dataset_id", F.sha2(F.to_json(F.struct("commodity", "year", "stage", "url", "locator")), 256))
    rows = raw.select("dataset_id", "commodity", "aliases", "year", "stage", "unit", F.coalesce("unallocated_production", F.lit(0.0)).alias("u"), F.posexplode("production").alias("n", "country", "quantity"))
    return rows.withColumn("unallocated", F.when(F.col("n") == 0, F.col("u")).otherwise(0.0)).drop("u", "n")


def production_names(rows: DataFrame, key=native_label_key) -> DataFrame:
    """Commodity and alias keys of each dataset, for matching material labels."""
    names = F.concat(F.array("commodity"), F.coalesce("aliases", F.array().cast("array<string>")))
    named = rows.select("commodity", "year", "stage", F.explode(names).alias("name")).distinct()
    return named.withColumn("name_key", key(F.col("name"))).drop("name")


def read_gazetteer(spark, path=None):
    """(countries, regions, cities) of a gazetteer file, each with its entry order.

    Without a path the package's own table is used. It lies with the driver's code, where executors
    do not reach, so the driver reads it and hands it on as a literal.
    """
    schema = (
        "countries map<string,struct<name:string,aliases:array<string>,lat:double,lon:double>>, "
        "regions array<struct<name:string,aliases:array<string>,country:string,lat:double,lon:double>>, "
        "cities array<struct<name:string,aliases:array<string>,admin1:string,country:string,lat:double,lon:double>>"
    )
    if path is None:
        text = resources.files(__package__).joinpath(GAZETTEER).read_text(encoding="utf-8")
        raw = spark.range(1).select(F.from_json(F.lit(text), schema).alias("g")).select("g.*")
    else:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    countries = raw.select(F.posexplode("countries").alias("pos", "code", "e")).select("pos", "code", "e.*")
    regions = raw.select(F.posexplode("regions").alias("pos", "e")).select("pos", "e.*")
    cities = raw.select(F.posexplode("cities").alias("pos", "e")).select("pos", "e.*")
    return countries, regions, cities


CURATED = (
    "product string, aliases array<string>, company string, notes array<string>, components array<struct<label:string,kind:string,"
    "predicate:string,url:string,title:string,publisher:string,span:string,locator:string,rationale:string,part_number:string,"
    "manufacturer:string>>, deep_documents array<struct<target:string,url:string,title:string,publisher:string,body:string,"
    "findings array<struct<subject:string,subject_kind:string,predicate:string,object:string,object_kind:string,span:string,"
    "rationale:string,part_number:string,manufacturer:string>>>>"
).replace("findings array", "findings:array")


def read_curated(spark, path):
    """Curated products: (documents, findings). A component is a page of its own span; a deep
    document carries findings between named entities."""
    raw = spark.read.schema(CURATED).option("multiLine", True).json(path)
    parts = raw.select("product", F.posexplode("components").alias("n", "c"))
    parted = F.coalesce(F.size("components"), F.lit(0)).alias("parts")
    deep = raw.select("product", parted, F.posexplode("deep_documents").alias("n", "d"))
    seq = F.col("n").cast("long")
    # deep documents are numbered after the product's components
    deep_seq = (F.col("n") + F.col("parts")).cast("long")
    none = F.lit(None).cast("string")
    shallow_docs = parts.select("product", seq.alias("document_seq"), "c.url", "c.title", "c.publisher", F.col("c.span").alias("body"), F.lit("component").alias("depth"))
    deep_docs = deep.select("product", deep_seq.alias("document_seq"), "d.url", "d.title", "d.publisher", "d.body", F.lit("deep").alias("depth"))
    shallow = parts.select(
        "product", seq.alias("document_seq"), F.lit(0).cast("long").alias("ordinal"), "c.url", "c.kind", "c.label", "c.predicate",
        none.alias("object_kind"), none.alias("object_label"), F.lit("product").alias("scope_type"), "c.span", "c.rationale",
        F.lit("directly_supported").alias("support_label"), "c.part_number", "c.manufacturer", none.alias("target_label"),
    )
    deeper = deep.select("product", deep_seq.alias("document_seq"), F.col("d.url").alias("url"), F.col("d.target").alias("target_label"), F.posexplode("d.findings").alias("o", "f"))
    deeper = deeper.select(
        "product", "document_seq", F.col("o").cast("long").alias("ordinal"), "url", F.col("f.subject_kind").alias("kind"), F.col("f.subject").alias("label"),
        "f.predicate", "f.object_kind", F.col("f.object").alias("object_label"), F.lit("product").alias("scope_type"), "f.span", "f.rationale",
        F.lit("directly_supported").alias("support_label"), "f.part_number", "f.manufacturer", "target_label",
    )
    return shallow_docs.unionByName(deep_docs), shallow.unionByName(deeper)


def curated_findings(pages: DataFrame, documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the curated set that fetched pages support: a component whose span is in a page
    of its product, and all findings of a deep document with the page's exact body.

    Pages are joined per product (`pages` has product, url, body), so no page meets another
    product's findings.
    """
    shallow = findings.where("target_label is null").drop("url", "document_seq")
    spans = pages.join(shallow, "product").where(F.contains("body", F.col("span"))).drop("body")
    hashed = documents.where("depth = 'deep'").select("product", "document_seq", F.sha2("body", 256).alias("h"))
    deep = pages.withColumn("h", F.sha2("body", 256)).join(hashed, ["product", "h"]).select("product", "url", "document_seq")
    exact = deep.join(findings.drop("url"), ["product", "document_seq"]).drop("document_seq")
    return spans.unionByName(exact, allowMissingColumns=True)


def extract_findings(pages: DataFrame, extractor, schema) -> DataFrame:
    """Extension hook: `extractor(iterator of pandas frames)` yields finding frames per batch."""
    return pages.mapInPandas(extractor, schema)


# ---------------------------------------------------------------- ledger
def ledger_scan(ledger: DataFrame, workspace, kind, parent_id=None, status=None) -> DataFrame:
    """Records of one workspace and kind, newest first; partition pruning applies to both."""
    rows = ledger.where((F.col("workspace") == workspace) & (F.col("kind") == kind))
    if parent_id is not None:
        rows = rows.where(F.col("parent_id") == parent_id)
    if status is not None:
        rows = rows.where(F.variant_get("data", "$.status", "string") == status)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
