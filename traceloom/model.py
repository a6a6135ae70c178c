"""Table shapes and the fixed vocabulary of the evidence graph."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
NODE_KINDS = ("product", "component", "material", "organization", "facility", "geography")

# predicate: (subject kinds, object kinds); direction is literal, the part is the subject
RELATION_RULES = {
    "INPUT_TO": (("component", "material"), ("product", "component", "material")),
    "PART_OF": (("component", "material", "facility"), ("product", "component", "facility")),
    "MANUFACTURES": (("organization", "facility"), ("product", "component")),
    "PRODUCES": (("organization", "facility"), ("product", "component", "material")),
    "OPERATES": (("organization",), ("facility",)),
    "LOCATED_IN": (("facility", "organization"), ("geography",)),
    "SUPPLIES": (("organization", "facility"), ("organization", "facility")),
    "OWNED_BY": (("organization", "facility"), ("organization",)),
    "PROCESSED_BY": (("material", "component"), ("organization", "facility")),
}
DEPENDENCY_PREDICATES = (
    "INPUT_TO",
    "PART_OF",
    "MANUFACTURES",
    "PRODUCES",
    "PROCESSED_BY",
    "SUPPLIES",
)
GENERIC_PREDICATES = ("LOCATED_IN", "OPERATES", "OWNED_BY")
MAKER_PREDICATES = ("MANUFACTURES", "PRODUCES")
NON_DEPENDENCY_KINDS = ("organization", "facility", "geography")

SUPPORT_ORDER = (
    "directly_supported",
    "strongly_inferred",
    "weakly_inferred",
    "user_asserted",
    "unresolved",
)
SCORE_BASE = {
    "directly_supported": 0.70,
    "strongly_inferred": 0.50,
    "weakly_inferred": 0.30,
    "disputed": 0.70,
    "user_asserted": 0.25,
    "unresolved": 0.0,
}
SCORE_MAX = 0.95
SCORE_DISPUTED_CAP = 0.25
SECONDS_PER_YEAR = 365.25 * 24 * 60 * 60

SCOPE_STRENGTH = {"generic": 0, "company": 1, "product": 2}
PRECISION_RANK = {"address": 3, "city": 2, "region": 1, "country": 0}
BASIS_RANK = {"evidenced": 2, "inferred": 1, "guessed": 0}

RELATIONS_BY_KIND = {
    "product": ("upstream_inputs", "manufacturer_or_facility"),
    "component": ("upstream_inputs", "manufacturer_or_facility"),
    "material": ("material_origin", "supplier"),
    "organization": ("location", "supplier"),
    "facility": ("location",),
}
ANSWERING_PREDICATES = {
    "upstream_inputs": ("INPUT_TO", "PART_OF"),
    "manufacturer_or_facility": ("MANUFACTURES", "PRODUCES"),
    "material_origin": ("PROCESSED_BY", "PRODUCES"),
    "supplier": ("SUPPLIES",),
    "location": ("LOCATED_IN", "OPERATES"),
}
TERMINAL_RUN = ("completed", "partial", "failed", "cancelled")
TERMINAL_JOB = ("completed", "partial", "failed")

MAX_SPAN = 600
MAX_SOURCES_PER_RELATION = 4
MAX_CANDIDATES = 12
# ---------------------------------------------------------------- end of fixed values


def lookup(column, table, default=None):
    """`table[column]` as a literal CASE chain, so a tiny fixed table never needs a join."""
    items = list(table.items())
    expr = F.when(column == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        expr = expr.when(column == key, F.lit(value))
    return expr if default is None else expr.otherwise(F.lit(default))


FINDING = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("document_seq", T.LongType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object_kind", T.StringType()),
        T.StructField("object_label", T.StringType()),
        T.StructField("scope_type", T.StringType()),
        T.StructField("span", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("support_label", T.StringType()),
        T.StructField("part_number", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("country_iso2", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("share", T.DoubleType()),
    ]
)

NODE = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("mpn", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
