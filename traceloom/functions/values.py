"""Time, rounding, hashing and layered-value functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

COMPUTED_LAYERS = ("concentration", "market", "geography")


# ---------------------------------------------------------------- time
def parse_time(value):
    """ISO-8601 text to a timestamp; naive text is UTC under a UTC session, junk is NULL."""
    return F.try_to_timestamp(col(value))


def stamp(moment):
    """UTC text with milliseconds and a trailing Z."""
    return F.date_format(col(moment), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamp_date(moment):
    return F.substring(stamp(moment), 1, 10)


def stamp_time(moment):
    return F.substring(stamp(moment), 12, 13)


def _micros(moment):
    return F.unix_micros(col(moment).cast("timestamp"))


def age_years(later, earlier):
    """Age in years of 365.25 days."""
    seconds = (_micros(later) - _micros(earlier)) / F.lit(1e6)
    return seconds / F.lit(365.25 * 24 * 60 * 60)


# ---------------------------------------------------------------- numbers
def round_half_up_3(value):
    return F.floor(col(value) * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(1000.0)


def clamp(value, low, high):
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


def cost_minor(input_tokens, output_tokens, searches, rate_in, rate_out, rate_search):
    """Run cost in minor units; NULL when any rate is unknown."""
    return F.ceil(
        col(input_tokens) * col(rate_in) / F.lit(1e6)
        + col(output_tokens) * col(rate_out) / F.lit(1e6)
        + col(searches) * col(rate_search)
    ).cast("long")


# ---------------------------------------------------------------- JSON and layers
def canonical_json(*columns):
    """Compact JSON object of the columns in the order given, NULLs kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def digest(value):
    return F.sha2(col(value), 256)


def excerpt(value, limit=None):
    """JSON of a value, its first `limit` characters if given."""
    text = F.to_json(col(value), {"ignoreNullFields": "false"})
    return text if limit is None else F.left(text, F.lit(limit))


def _public_type(expr, dtype):
    if isinstance(dtype, T.StructType):
        kept = [f for f in dtype.fields if not f.name.startswith("_")]
        changed = len(kept) != len(dtype.fields)
        parts = []
        for field in kept:
            child = expr.getField(field.name)
            inner, touched = (
                (child, False) if field.name == "custom" else _public_type(child, field.dataType)
            )
            changed = changed or touched
            parts.append(inner.alias(field.name))
        if not changed or not parts:
            return expr, False
        return F.when(expr.isNotNull(), F.struct(*parts)), True
    if isinstance(dtype, T.ArrayType) and isinstance(
        dtype.elementType, (T.StructType, T.ArrayType)
    ):
        if not _has_private(dtype.elementType):
            return expr, False
        return F.transform(expr, lambda x: _public_type(x, dtype.elementType)[0]), True
    return expr, False


def _has_private(dtype):
    if isinstance(dtype, T.StructType):
        return any(
            f.name.startswith("_") or (f.name != "custom" and _has_private(f.dataType))
            for f in dtype.fields
        )
    return isinstance(dtype, T.ArrayType) and _has_private(dtype.elementType)


def public(df):
    """Drop every field whose name begins with `_`, at any depth, except below `custom`."""
    columns = []
    for field in df.schema.fields:
        if field.name.startswith("_"):
            continue
        expr = F.col(f"`{field.name}`")
        if field.name != "custom":
            expr = _public_type(expr, field.dataType)[0]
        columns.append(expr.alias(field.name))
    return df.select(*columns)


def merge_patch(base, patch, dtype):
    """Recursive overlay of a sparse patch struct on a base struct: a field absent (NULL) in the
    patch keeps the base value."""
    base, patch = col(base), col(patch)
    if isinstance(dtype, T.StructType):
        merged = F.struct(
            *[
                merge_patch(base.getField(f.name), patch.getField(f.name), f.dataType).alias(f.name)
                for f in dtype.fields
            ]
        )
        return F.when(patch.isNull(), base).otherwise(merged)
    if isinstance(dtype, T.MapType):
        return (
            F.when(patch.isNull(), base)
            .when(base.isNull(), patch)
            .otherwise(
                F.map_concat(
                    F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch
                )
            )
        )
    return F.coalesce(patch, base)


def user_layer_violation(layer_names):
    """Reason when a user edit touches a layer only enrichment may fill, else NULL."""
    blocked = F.array_intersect(col(layer_names), F.array(*[F.lit(n) for n in COMPUTED_LAYERS]))
    return F.when(F.size(blocked) > 0, F.lit("computed_layer"))


def user_custom(custom):
    """Wrap each user value with the label that marks it as an assertion."""
    return F.transform_values(
        col(custom),
        lambda _, v: F.struct(v.alias("value"), F.lit("user_asserted").alias("support_label")),
    )
