"""Connected groups from buckets of candidates, without pairing all members of a bucket."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialize, release

ROUNDS = 6  # most rounds of pivots


def _labelled(members, labels):
    if labels is None:
        return members.withColumn("label", F.col("id"))
    return members.join(labels, F.col("id") == F.col("node"), "left").withColumn(
        "label", F.coalesce("root", "id")).drop("node", "root")


def _open(rows):
    """Members of the buckets that hold more than one group, with the bucket's most common label."""
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.count("*").alias("groups"), F.max_by("label", F.struct("n", "label")).alias("common"))
    return rows.join(mixed.where("groups > 1").select("bucket", "common"), "bucket")


def _hooked(labels, links):
    """Labels after each linked id took the smallest label next to it: ids of equal label are connected."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is None:
        near = ends.groupBy("a").agg(F.min("b").alias("near"))
        return materialize(near.select(F.col("a").alias("node"), F.least("a", "near").alias("root")))
    far = ends.join(labels, F.col("b") == F.col("node"), "left").select("a", F.coalesce("root", "b").alias("near"))
    near = far.groupBy("a").agg(F.min("near").alias("near"))
    both = labels.join(near, F.col("node") == F.col("a"), "full")
    return materialize(both.select(
        F.coalesce("node", "a").alias("node"), F.least(F.coalesce("root", "a"), "near").alias("root")))


def _pairs(frame, a, b):
    return frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def linked_groups(buckets: DataFrame, verify, rounds=ROUNDS, close=None,
                  marks=None, not_far=None) -> DataFrame:
    """(node, root) of every id that is not its group's smallest; groups are connected by links.

    `buckets` has distinct (bucket, id, sig). `close` is a condition on two `sig` columns; any two ids
    with a link meet it in at least one bucket that they share. `marks` has (id, mark), and `not_far`
    is a condition on two sigs and two marks that every link meets too. `verify` takes (a, b) pairs and
    returns those that are links.

    In rounds, while they find links, each bucket that holds several groups tries its members against
    one of them, its pivot, another one in each round: as many pairs as members. A bucket of near copies
    becomes one group that way. Then every pair that could still join two groups is tried: the members outside a
    bucket's most common group against all of its members of other groups. Pairs inside one group are
    never formed, and none that could matter is left out.
    """
    members, links, labels = materialize(buckets), None, None
    near = close or (lambda a, b: F.lit(True))
    sig = F.col("sig") if "sig" in members.columns else F.lit(0).alias("sig")
    turn, pivoting = 0, rounds > 0
    while True:
        rows = materialize(_open(_labelled(members, labels)))
        if pivoting:
            mark = F.xxhash64("id") if turn == 0 else F.xxhash64("id", "bucket", F.lit(turn))
            pivot = rows.groupBy("bucket").agg(
                F.min_by(F.struct("id", "label", sig), F.struct(mark, F.col("id"))).alias("pivot"))
            tried = rows.join(pivot, "bucket").where("label <> pivot.label").where(
                near(sig, F.col("pivot.sig")))
            pairs = _pairs(tried, F.col("id"), F.col("pivot.id"))
        else:
            every = rows.withColumn("mark", F.lit(0)) if marks is None else rows.join(marks, "id")
            few = every.where("label <> common").select(
                "bucket", F.col("id").alias("few"), F.col("label").alias("few_label"), sig.alias("few_sig"),
                F.col("mark").alias("few_mark"))
            tried = every.join(few, "bucket").where("label <> few_label").where(near(sig, F.col("few_sig")))
            if not_far:
                tried = tried.where(not_far(sig, F.col("few_sig"), F.col("mark"), F.col("few_mark")))
            pairs = _pairs(tried, F.col("id"), F.col("few"))
        found = materialize(verify(pairs))
        release(rows)
        none = found.isEmpty()
        if none and turn == 0 and members.isEmpty():
            break
        if not none:
            links = found if links is None else links.unionByName(found)
        if not pivoting:
            labels = labels if none else connected_components(links, "a", "b")
            break
        turn += 1
        pivoting = not none and turn < rounds
        if pivoting:
            labels = _hooked(labels, found)
        elif links is not None:
            labels = connected_components(links, "a", "b")
    if labels is None:
        kind = members.schema["id"].dataType.simpleString()
        return members.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return labels
