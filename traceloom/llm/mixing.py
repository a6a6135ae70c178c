"""Mixing sources to target weights by Pareto order sampling."""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, unit_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SLICES = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh `weights` in turn and
    share `share` of all sizes; a target stops at `most` times its source's size and the excess goes
    to the others by weight until none is above.

    With sources sorted by most * size / weight the capped ones are a prefix, so the common level is
    found by one running sum over the table of sources. Only that table, a row per source, is sorted in
    one task; once a source stays below its room, the levels that follow only fall, so the highest
    level of such a source is the common one.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    each = each.select("source", "source_size", F.row_number().over(by_name).alias("rank"))
    each = each.withColumn("weight", cycle[(F.col("rank") - 1) % len(weights)])
    each = each.withColumn("room", F.lit(float(most)) * F.col("source_size"))
    fill = W.orderBy(F.col("room") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(F.col("room") / F.col("weight"), "rank").rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("room").over(fill), F.lit(0.0))
    each = each.withColumn("level", left / F.sum("weight").over(rest))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("room"), F.col("level"))
    each = each.withColumn("level", F.max(open_).over(everything))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("room")), F.col("room"))
    return each.select("source", "source_size", target.alias("target"))


def mix_rows(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed=9,
             weights=WEIGHTS, share=SHARE, most=MOST, carry=()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and `carry` columns.

    A source whose target is r times its size takes floor(r) whole copies of each document for
    certain. The rest is a fixed-size Pareto sample: a document's odds of inclusion are those of the
    fraction r - floor(r), raised for short documents by (mean size / size) ** 0.5, and documents are
    ranked by random odds over inclusion odds. The sample ends where its words reach what is left of
    the target; one further document of the source, the nearest in size to what is still missing,
    closes it if that brings the sum nearer (rows that repeat that document close together).

    Ranks are never sorted whole: words are summed per source and slice of the rank, and only the
    slice in which the target falls is ordered. The random number hangs on id and text, so reruns
    agree. Null text has size 0 and null source is a source of its own, weighed last. Rows that
    repeat an id and a text are documents of their own that draw the same number. Empty tables give
    no rows. Names of other columns do not matter.
    """
    counted = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), counted.alias("size"),
        unit_hash(F.col(doc_id), F.coalesce(F.col(text), F.lit("")), seed=seed).alias("u"),
        *[F.col(c).alias(f"__c_{c}") for c in carry],
    )
    slim = materialize(rows.select("doc_id", "source", "size", "u"))
    targets = source_targets(slim, weights, share, most)
    totals = slim.groupBy("source").agg(F.count("*").alias("documents"))
    plan = targets.join(totals, targets["source"].eqNullSafe(totals["source"])).select(
        targets["*"], "documents")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    plan = materialize(plan.select(
        F.col("source").alias("s_source"), "source_size", "target", "whole",
        F.least(F.col("rate") - F.col("whole"), F.lit(1 - 1e-9)).alias("part"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing"),
        (F.col("source_size") / F.col("documents")).alias("mean"),
    ))

    def ranked(frame):
        joined = frame.join(plan, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
        odds = F.col("part") / (1 - F.col("part")) * F.sqrt(
            (F.col("mean") + 1) / (F.col("size") + 1))
        rank = F.col("u") / (1 - F.col("u")) / F.greatest(odds, F.lit(1e-12))
        return joined.withColumn("rank", rank / (1 + rank)).withColumn(
            "slice", F.floor(F.col("rank") * SLICES).cast("int"))

    scored = ranked(slim)
    sums = scored.groupBy("source", "slice").agg(
        F.sum("size").alias("words"), F.first("missing").alias("missing"))
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = materialize(
        sums.where(F.col("start") + F.col("words") > F.col("missing")).groupBy("source").agg(
            F.min(F.struct("slice", "start")).alias("at"))
        .select(F.col("source").alias("c_source"), F.col("at.slice").alias("cut"),
                F.col("at.start").alias("start")))

    def placed(frame):
        return frame.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")

    # the one slice of each source in which the target falls
    inside = placed(scored).where("slice = cut")
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size")
    running = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    number = F.row_number().over(order)
    edge = inside.select("source", "rank", "doc_id", "size", "missing",
                         (F.col("start") + running).alias("sum"), number.alias("n"))
    inner = edge.groupBy("source").agg(
        F.max(F.when(F.col("sum") <= F.col("missing"), F.col("n"))).alias("edge_n"),
        F.max(F.when(F.col("sum") <= F.col("missing"), F.col("sum"))).alias("edge_sum"))
    ends = materialize(cut.join(inner, F.col("c_source").eqNullSafe(F.col("source")), "left").select(
        F.col("c_source").alias("e_source"), F.coalesce("edge_n", F.lit(0)).alias("edge_n"),
        F.coalesce("edge_sum", F.col("start")).alias("edge_sum")))

    def chosen(frame):
        """Adds `more` (1 if in the sample) and `gap` (words still missing)."""
        at = placed(frame).join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
        sure = at.where("cut is null or slice <> cut").withColumn(
            "more", F.when(F.col("cut").isNull() | (F.col("slice") < F.col("cut")), 1).otherwise(0))
        near = at.where("slice = cut").withColumn("__n", F.row_number().over(order)).withColumn(
            "more", F.when(F.col("__n") <= F.col("edge_n"), 1).otherwise(0)).drop("__n")
        return sure.unionByName(near).withColumn(
            "gap", F.col("missing") - F.coalesce("edge_sum", F.lit(0)))

    # one closing document per source: nearest in size to the gap, if it helps
    off = F.abs(F.col("size") - F.col("gap"))
    helps = (F.col("more") == 0) & (off < F.col("gap")) & (F.col("size") > 0)
    close = materialize(
        chosen(scored).where(helps).groupBy("source").agg(
            F.min(F.struct(off.alias("off"), "rank", "doc_id", "size")).alias("best"))
        .select(F.col("source").alias("x_source"), F.col("best.rank").alias("x_rank"),
                F.col("best.doc_id").alias("x_doc"), F.col("best.size").alias("x_size")))

    base = ranked(rows) if carry else scored
    final = chosen(base).join(
        close, F.col("source").eqNullSafe(F.col("x_source")) & (F.col("rank") == F.col("x_rank"))
        & F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.col("size") == F.col("x_size"))
        & (F.col("more") == 0), "left")
    copies = (F.col("whole") + F.col("more")
              + F.when(F.col("x_size").isNotNull(), 1).otherwise(0)).cast("int")
    return final.select(
        "doc_id", "size", "source_size", "target", F.least(copies, F.lit(int(most))).alias("copies"),
        *[F.col(f"__c_{c}").alias(f"__c_{c}") for c in carry],
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed=9, **options) -> DataFrame:
    """The rows of the mix with all columns of `docs`, each repeated as often as it is taken."""
    plain, names = numbered(docs)
    ids = {k: names[options.pop(k, k)] for k in ("doc_id", "text", "source")}
    mixed = mix_rows(plain, seed=seed, carry=list(names.values()), **ids, **options)
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").withColumn("copy", again).select(
        *[F.col(f"__c_{c}") for c in names.values()]).toDF(*docs.columns)
