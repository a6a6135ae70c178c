"""Connected components of shared-value pairs, and of general edge lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

FOLD_LIMIT = 256


def _fold(pairs, keys, left, right):
    """Merge a bounded list of (left, right) pairs into groups inside one row."""
    item = F.struct(F.col(left).alias("l"), F.col(right).alias("r"))
    empty = F.expr("cast(array() as array<struct<l:array<string>,r:array<string>>>)")

    def touches(group, pair):
        return F.array_contains(group["l"], pair["l"]) | F.array_contains(group["r"], pair["r"])

    def add(groups, pair):
        hit = F.filter(groups, lambda g: touches(g, pair))
        merged = F.struct(
            F.array_union(F.flatten(F.transform(hit, lambda g: g["l"])), F.array(pair["l"])).alias("l"),
            F.array_union(F.flatten(F.transform(hit, lambda g: g["r"])), F.array(pair["r"])).alias("r"),
        )
        return F.concat(F.filter(groups, lambda g: ~touches(g, pair)), F.array(merged))

    listed = pairs.groupBy(*keys).agg(F.collect_list(item).alias("__items"))
    folded = F.size(F.aggregate("__items", empty, add))
    groups = F.when(F.size("__items") == 1, F.lit(1)).otherwise(folded)
    return listed.select(*keys, groups.cast("long").alias("groups"))


def _fingerprint(edges):
    """Number and hash sum of a set of edges: equal sets are told by two numbers, not by a join."""
    hashed = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed)).first())


def connected_components(edges: DataFrame, u="u", v="v") -> DataFrame:
    """(node, root) of every node that is not its own root, by alternating star contraction.

    Each step replaces edges by edges to smaller neighbours; the number of steps grows with the
    logarithm of the graph, and every step is a combinable minimum and an equi join.
    """
    current = materialize(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    )
    state = _fingerprint(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        down = large.where("u <> v").distinct().select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(root, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(root.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = materialize(small)
        seen, state = state, _fingerprint(following)
        if seen == state:
            return following.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = following


def _contract(pairs, keys, left, right):
    side = lambda tag, value: F.struct(
        *keys, F.lit(tag).alias("side"), F.col(value).alias("value")
    )
    links = pairs.select(side(0, left).alias("u"), side(1, right).alias("v"))
    merged = connected_components(links)
    vertices = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    total = vertices.groupBy(*[F.col(f"node.{k}").alias(k) for k in keys]).agg(
        F.count("*").alias("__n")
    )
    below = merged.groupBy(*[F.col(f"node.{k}").alias(k) for k in keys]).agg(
        F.count("*").alias("__below")
    )
    return total.join(below, list(keys), "left").select(
        *keys, (F.col("__n") - F.coalesce("__below", F.lit(0))).alias("groups")
    )


def count_groups(pairs: DataFrame, keys, left, right, fold_limit=FOLD_LIMIT) -> DataFrame:
    """Independent groups per key: pairs that share `left` or `right`, transitively, are one group.

    `pairs` must be distinct and string valued. Keys with at most `fold_limit` pairs are folded
    inside one row; any larger key goes through star contraction, so no key's pairs are ever
    collected without a bound.
    """
    keys = list(keys)
    large = materialize(
        pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > fold_limit).select(*keys)
    )
    if large.isEmpty():
        return _fold(pairs, keys, left, right)
    folded = _fold(pairs.join(large, keys, "left_anti"), keys, left, right)
    return folded.unionByName(_contract(pairs.join(large, keys, "left_semi"), keys, left, right))
