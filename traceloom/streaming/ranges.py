"""Seen ranges of sequence numbers per stream: gaps, heads and completion under any order of arrival.

The state of a stream is its set of disjoint seen ranges. Sets merge by union, so events may come in
any order and any files; a late number closes its gap. Map tasks fold their events to ranges first, so
a busy stream sends a few rows to its state and not its events.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..model import TERMINAL_RUN

STATE = "firsts array<bigint>, lasts array<bigint>, status string, finished boolean"
GAPS = "array<struct<after:bigint,resume_at:bigint>>"


def merged(firsts, lasts):
    """Disjoint, sorted ranges of the union; neighbours that touch become one."""
    firsts, lasts = np.asarray(firsts, np.int64), np.asarray(lasts, np.int64)
    order = np.argsort(firsts, kind="stable")
    firsts, ends = firsts[order], np.maximum.accumulate(lasts[order])
    if not len(firsts):
        return firsts, ends
    new = np.flatnonzero(np.concatenate([[True], firsts[1:] > ends[:-1] + 1]))
    return firsts[new], ends[np.concatenate([new[1:], [len(firsts)]]) - 1]


def _folded(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        streams = pc.dictionary_encode(batch.column(0))
        codes, seqs = streams.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((seqs, codes))
        codes, seqs = codes[order], seqs[order]
        new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (seqs[1:] > seqs[:-1] + 1)]))
        ends = np.concatenate([new[1:], [len(seqs)]]) - 1
        yield pa.RecordBatch.from_arrays(
            [streams.dictionary.take(pa.array(codes[new])), pa.array(seqs[new]), pa.array(seqs[ends]), pa.nulls(len(new), pa.string())],
            names=["stream_id", "first", "last", "status"])
        done = batch.filter(pc.is_valid(batch.column(2)))
        if done.num_rows:
            seqs = done.column(1)
            yield pa.RecordBatch.from_arrays([done.column(0), seqs, seqs, done.column(2)], names=["stream_id", "first", "last", "status"])


def range_rows(events: DataFrame) -> DataFrame:
    """(stream_id, first, last, status): ranges of the events of a task; works on streams and tables.

    `status` is the terminal status that the event at first = last reports, else NULL.
    """
    status = F.get_json_object("payload", "$.status") if "payload" in events.columns else F.lit(None).cast("string")
    status = F.when(status.isin(*TERMINAL_RUN), status)
    rows = events.where("stream_id is not null and seq is not null").select("stream_id", F.col("seq").cast("long").alias("seq"), status.alias("status"))
    kind = rows.schema["stream_id"].dataType.simpleString()
    return rows.mapInArrow(_folded, f"stream_id {kind}, first long, last long, status string")


class _Seen(StatefulProcessor):
    def init(self, handle):
        self.state = handle.getValueState("seen", STATE)

    def handleInitialState(self, key, initialState, timerValues):
        after = int(initialState.after or 0)
        self.state.update(([0], [after], None, False))

    def handleInputRows(self, key, rows, timerValues):
        firsts, lasts, status, finished = self.state.get() or ([0], [0], None, False)  # one call to the store, not two
        new_firsts, new_lasts = list(firsts), list(lasts)
        for row in rows:
            new_firsts.append(row.first)
            new_lasts.append(row.last)
            status = status or row.status
        held = merged(firsts, lasts)
        seen = merged(new_firsts, new_lasts)
        gaps = list(zip(seen[1][:-1].tolist(), (seen[0][1:] - 1).tolist()))
        before = list(zip(held[1][:-1].tolist(), (held[0][1:] - 1).tolist()))
        opened = [g for g in gaps if not any(a <= g[0] and g[1] <= b for a, b in before)]
        done = finished or (status is not None and not gaps)
        self.state.update((seen[0].tolist(), seen[1].tolist(), status, done))
        as_rows = lambda x: [Row(after=a, resume_at=b) for a, b in x]
        yield Row(stream_id=key[0], head=int(seen[1][-1]), gaps=as_rows(gaps), opened=as_rows(opened), status=status, finished=done,
                  just_finished=done and not finished)

    def close(self):
        pass


def stream_progress(events: DataFrame, cursors: DataFrame = None, mode="Update") -> DataFrame:
    """One row for each stream that a micro-batch touches, its state after the whole batch.

    stream_id, head (largest number seen), gaps (missing numbers as last number before and last number
    missing), opened (the gaps this batch made), status (the terminal one, once seen), finished
    (terminal and without gaps, so a reader has everything) and just_finished, true once per stream.
    `cursors` (stream_id, after) names numbers that a reader already has; by default none. Order within
    and between files does not matter. The state holds two numbers per open gap of a stream.
    """
    rows = range_rows(events)
    kind = rows.schema["stream_id"].dataType.simpleString()
    start = None if cursors is None else cursors.select(
        F.col("stream_id").cast(kind).alias("stream_id"), F.col("after").cast("long").alias("after")).groupBy("stream_id")
    schema = f"stream_id {kind}, head long, gaps {GAPS}, opened {GAPS}, status string, finished boolean, just_finished boolean"
    return rows.groupBy("stream_id").transformWithState(_Seen(), schema, mode, "None", start)


def snapshot_required(events: DataFrame, cursors: DataFrame = None) -> DataFrame:
    """A row (stream_id, after, resume_at) whenever a batch leaves a new gap: the reader must fetch a
    snapshot and resume there. Numbers that come late, in the same batch or before, are no gap."""
    rows = stream_progress(events, cursors, "Append").select("stream_id", F.explode("opened").alias("gap"))
    return rows.select("stream_id", "gap.after", "gap.resume_at")


def finished_streams(events: DataFrame, cursors: DataFrame = None) -> DataFrame:
    """(stream_id, seq, status) of each stream once, when its terminal status and all numbers up to its
    head have come; for append mode."""
    return stream_progress(events, cursors, "Append").where("just_finished").select("stream_id", F.col("head").alias("seq"), "status")


def progress_table(rows: DataFrame, cursors: DataFrame = None) -> DataFrame:
    """The batch twin, and the way to read the state from a table of ranges: one row per stream.

    stream_id, head, gaps, beyond. `beyond` marks a cursor ahead of its stream's head, also of streams
    without any event. `rows` are `range_rows` of all events; ranges combine per stream in the map
    tasks by bucket of numbers, so that a hot stream is folded by many tasks.
    """
    slot = F.floor(F.col("first") / (1 << 16))
    part = rows.groupBy("stream_id", slot.alias("slot")).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("r"))
    part = part.select("stream_id", F.explode(_union("r")).alias("r"))
    whole = part.groupBy("stream_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    if cursors is None:
        own = whole.withColumn("after", F.lit(0).cast("long"))
    else:
        own = whole.join(cursors.select("stream_id", F.col("after").cast("long").alias("after")), "stream_id", "full")
    start = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.coalesce("after", F.lit(0)).alias("last")))
    seen = F.array_max(F.transform("r", lambda x: x["last"]))
    own = own.select("stream_id", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce(seen, F.lit(0)).alias("head"),
                     F.sort_array(F.concat(start, F.coalesce("r", F.array().cast("array<struct<first:bigint,last:bigint>>")))).alias("r"))
    own = own.withColumn("r", _union("r"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(
        F.get("r", i - 1)["last"].alias("after"), (F.get("r", i)["first"] - 1).alias("resume_at")))
    return own.select("stream_id", "head", F.when(F.size("r") > 1, gaps).otherwise(F.array().cast(GAPS)).alias("gaps"),
                      (F.col("after") > F.col("head")).alias("beyond"))


def _union(ranges):
    """Union of an array of ranges sorted by their first number."""
    kind = "array<struct<first:bigint,last:bigint>>"

    def add(held, x):
        end = F.element_at(held, -1)
        joined = F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when((F.size(held) > 0) & (x["first"] <= F.try_element_at(held, F.lit(-1))["last"] + 1),
                      F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(joined))).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.col(ranges), F.array().cast(kind), add)
