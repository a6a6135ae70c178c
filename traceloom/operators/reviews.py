"""Claim reviews carried through labels, scores and revisions by their delta.

The score table is a view over claims and sources. A batch of reviews changes a few claims; only the
edges that list one of them are scored again, and the rest of the view is taken over as it is. Where no
view is kept, all edges are scored once, from rows that bear the new status.
"""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..session import materialize
from .evidence import score_edges
from .running import HOT_ROWS, spread_totals

FILTER_BITS = 24  # log2 of the bits of the claim filter: 2 MB, whatever the number of reviews
VERDICTS = {"accept": "accepted", "reject": "rejected", "dispute": "disputed"}


class Reviewed:
    """What a batch of reviews leaves. Every table is computed when it is first asked for; the claims and
    edges that the reviews touch are looked for once."""

    def __init__(self, rows, scores, reviews, graphs, keys, created_at, graph, hot_rows):
        self._rows, self._view, self._reviews, self._graphs = rows, scores, reviews, graphs
        self._keys, self._created_at, self._graph, self._hot_rows = list(keys), created_at, graph, hot_rows
        self._edge = self._keys if graph in self._keys else [graph, *self._keys]
        self._status = model.lookup(F.col("verdict"), VERDICTS)

    @cached_property
    def _touched(self):
        """Reviewed claims of every graph and edge, the one pass that looks for claims among all rows."""
        asked = self._reviews.where(F.col("verdict").isin(*VERDICTS)).select("claim_id").distinct()
        rows = self._rows.select(*self._edge, "claim_id", F.col("status").alias("status_before"))
        return materialize(rows.join(asked, "claim_id", "left_semi").distinct())

    @cached_property
    def _known(self):
        held = self._touched.select("claim_id").distinct()
        return materialize(self._reviews.where(F.col("verdict").isin(*VERDICTS)).join(held, "claim_id", "left_semi"))

    @cached_property
    def _latest(self):
        order = F.struct("created_at", "review_id")
        note = F.concat_ws(" ", F.col("created_at").cast("string"), F.lit("user"), F.concat("verdict", F.lit(":")), "note")
        return materialize(self._known.groupBy("claim_id").agg(
            F.max_by("verdict", order).alias("verdict"),
            F.transform(F.sort_array(F.collect_list(F.struct("created_at", "review_id", note.alias("note")))), lambda x: x["note"]).alias("notes")))

    @cached_property
    def claims(self) -> DataFrame:
        """Reviewed claims: status_before, status, notes."""
        return self._touched.groupBy("claim_id").agg(F.first("status_before").alias("status_before")).join(self._latest, "claim_id").select(
            "claim_id", "status_before", self._status.alias("status"), "notes")

    @cached_property
    def _moved(self):
        """Edges with a claim whose status changes: a review that leaves it as it was moves no score."""
        changed = self._touched.join(self._latest.select("claim_id", "verdict"), "claim_id")
        return materialize(changed.where(~F.col("status_before").eqNullSafe(self._status)).select(*self._edge).distinct())

    @property
    def _stale(self):
        return self._moved.select(*self._keys).distinct()

    @cached_property
    def _stale_rows(self):
        return materialize(self._rows.join(self._stale, self._keys, "left_semi"))

    @cached_property
    def _rescored(self):
        fresh = self._stale_rows.join(self._latest.select("claim_id", "verdict"), "claim_id", "left")
        fresh = fresh.withColumn("status", F.coalesce(self._status, "status")).drop("verdict")
        return materialize(score_edges(fresh, self._keys, self._created_at))

    @property
    def _reviewed_rows(self):
        """All rows with the status after the reviews.

        A bit filter of fixed size tells most other rows apart where they are read, so only about the reviewed
        ones go to their verdicts by claim; the rest bring no claim id to any shuffle.
        """
        kind = self._rows.schema["claim_id"].dataType
        asked = self._reviews.where(F.col("verdict").isin(*VERDICTS)).withColumn("claim_id", F.col("claim_id").cast(kind))
        verdicts = materialize(asked.groupBy("claim_id").agg(
            F.max_by("verdict", F.struct("created_at", "review_id")).alias("verdict")))
        slot = F.pmod(F.xxhash64("claim_id"), F.lit(1 << FILTER_BITS))
        at, bit = F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")
        bits = verdicts.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        words = verdicts.sparkSession.range(1 << FILTER_BITS - 6).select(F.col("id").cast("int").alias("at")).join(bits, "at", "left")
        words = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))),
                                      lambda x: x["bits"]).alias("words"))
        perhaps = F.getbit(F.get(words.scalar(), at), bit) == 1
        few = self._rows.where(perhaps).join(verdicts, "claim_id", "left")
        few = few.withColumn("status", F.coalesce(self._status, "status"))
        return self._rows.where(~perhaps).unionByName(few.select(*self._rows.columns))

    @cached_property
    def scores(self) -> DataFrame:
        """The whole view, touched edges rescored."""
        if self._view is None:
            return score_edges(self._reviewed_rows, self._keys, self._created_at)
        view = self._view
        return view.join(self._stale, self._keys, "left_anti").unionByName(self._rescored.select(*view.columns))

    @cached_property
    def changes(self) -> DataFrame:
        """Touched edges: label and confidence before and after."""
        if self._view is None:
            before = score_edges(self._stale_rows, self._keys, self._created_at)
        else:
            before = self._view.join(self._stale, self._keys, "left_semi")
        before = before.select(
            *self._keys, F.col("support_label").alias("label_before"), F.col("confidence").alias("confidence_before"))
        return materialize(self._rescored.join(before, self._keys, "left").select(
            *self._keys, "label_before", F.col("support_label").alias("label_after"), "confidence_before",
            F.col("confidence").alias("confidence_after")))

    @cached_property
    def revisions(self) -> DataFrame:
        """One row per graph and review, in order."""
        held = self._touched.select(self._graph, "claim_id").distinct().join(self._known, "claim_id")
        numbered = spread_totals(held, [self._graph], ["created_at", "review_id"], "created_at", {"step": F.lit(1)},
                                 hot_rows=self._hot_rows)
        return numbered.join(self._graphs.select(self._graph, "revision"), self._graph).select(
            self._graph, "review_id", "claim_id", "verdict", (F.col("revision") + F.col("step") - 1).alias("revision_before"),
            (F.col("revision") + F.col("step")).alias("revision_after"))

    @cached_property
    def labels(self) -> DataFrame:
        """Change of the number of edges per graph and label."""
        sides = F.explode(F.array(F.struct(F.col("label_before").alias("support_label"), F.lit(-1).alias("n")),
                                  F.struct(F.col("label_after").alias("support_label"), F.lit(1).alias("n"))))
        counted = self.changes if self._graph in self._keys else self._moved.join(self.changes, self._keys)
        return counted.select(self._graph, sides.alias("s")).groupBy(self._graph, "s.support_label").agg(
            F.sum("s.n").alias("change")).where("change <> 0")


def review(rows: DataFrame, scores, reviews: DataFrame, graphs: DataFrame, keys, created_at=None,
           graph="graph_id", hot_rows=HOT_ROWS) -> Reviewed:
    """Apply reviews to a lineage table `rows` and its score view.

    `rows` has `graph`, the edge `keys` (of which `graph` may be one), claim_id, status and what
    `score_edges` reads; `scores` is its result, or None where no view is kept: then the edges asked for
    are scored from `rows`. `reviews` has review_id, claim_id, verdict (accept,
    reject, dispute; others change nothing), note and created_at: the last one of a claim gives its
    status, all of them add to its notes, and each makes one revision of every graph that holds the
    claim, also if the status stays. A verdict never changes a claim's support label. `graphs` has
    `graph` and revision. Reviews of claims that no graph holds leave no trace.
    """
    return Reviewed(rows, scores, reviews, graphs, keys, created_at, graph, hot_rows)
