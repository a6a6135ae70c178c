"""Structured Streaming over the event log.

Order within a stream is the writer-assigned sequence number, not event time. Watermarks and
timeouts appear only where something must bound the state; they are additions of this package.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.running import running_totals
from .ranges import finished_streams, snapshot_required  # noqa: F401

EVENT = (
    "stream_id string, event_id long, seq long, ts timestamp, type string, graph_id string, "
    "entity_id string, payload string"
)


def tail(spark, path, after=0, schema=EVENT, files_per_batch=None) -> DataFrame:
    """Events after a cursor as a stream; the checkpoint carries the position from then on."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).where(F.col("seq") > after)


# ---------------------------------------------------------------- folds
def current_state(events: DataFrame) -> DataFrame:
    """Latest payload per graph entity, for update mode. The maximum combines in the map tasks, so
    a busy graph does not gather its events in one place."""
    kept = events.where(F.col("type").rlike(r"^(node|edge)\.(added|updated)$"))
    return kept.groupBy("graph_id", F.substring_index("type", ".", 1).alias("what"), "entity_id").agg(
        F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq")
    )


COUNTERS = ("run.status", "budget.updated", "task.finished")


def live_counters(events: DataFrame, types=COUNTERS) -> DataFrame:
    """Latest progress, usage and frontier payload per run, for update mode; all types if `types` is None."""
    kept = events if types is None else events.where(F.col("type").isin(*types))
    return kept.groupBy("stream_id", "type").agg(
        F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq")
    )


# ---------------------------------------------------------------- sequence assignment
HEADS = 64  # buckets of the head table
COMPACT = 16  # a bucket is rewritten whole in one of so many batches


def sequence_writer(path, stream="stream_id", at="ts", tie="event_id", bucket="hour", heads=HEADS, compact=COMPACT):
    """A `foreachBatch` function that numbers each stream's events without gaps, in (`at`, `tie`) order
    within a batch and after all numbers of the batches before.

    Numbers within a batch are bucketed running totals, so a busy stream is spread over tasks. The
    heads are a changelog in `heads` buckets of streams: a batch reads the buckets of its streams and
    writes the heads of its streams, nothing else. Heads only grow, so the largest entry is the valid
    one. In one of `compact` batches a touched bucket is written whole, and what lies before its last
    whole copy is deleted. A batch writes its own folders with overwrite and reads earlier ones only, so
    it can be run again.
    """

    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        batch = batch.persist()
        slot = F.pmod(F.xxhash64(stream), F.lit(heads)).cast("int")
        touched = sorted(r[0] for r in batch.select(slot).distinct().collect())
        kind = batch.schema[stream].dataType.simpleString()
        logs = _Folder(spark, f"{path}/heads")
        found = [f"{path}/heads/batch={b}/bucket={k}" for b, k in logs.entries() if b < batch_id and k in set(touched)]
        schema = f"`{stream}` {kind}, head long"
        known = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
        known = known.groupBy(stream).agg(F.max("head").alias("head"))
        ranked = running_totals(batch, [stream], [at, tie], F.date_trunc(bucket, F.col(at)), {"__n": F.lit(1)})
        numbered = ranked.join(known, stream, "left")
        numbered = numbered.withColumn("seq", F.coalesce("head", F.lit(0)) + F.col("__n")).drop("head", "__n")
        numbered.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        written = spark.read.parquet(f"{path}/events/batch={batch_id}")
        changed = written.groupBy(stream).agg(F.max("seq").alias("head"))
        due = [k for k in touched if (batch_id + k) % compact == 0]
        if due:
            whole = known.where(slot.isin(*due)).select(stream, "head")
            changed = changed.unionByName(whole).groupBy(stream).agg(F.max("head").alias("head"))
        changed.select(stream, "head", slot.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{path}/heads/batch={batch_id}")
        for k in due:
            own = sorted(b for b, other in logs.entries() if other == k and b < batch_id)
            last = max((b for b in own if (b + k) % compact == 0), default=0)
            for b in own:
                if b < last:
                    logs.delete(f"batch={b}/bucket={k}")
        batch.unpersist()

    return write


class _Folder:
    """The folders batch=B/bucket=K below a path, on any file system Spark reaches."""

    def __init__(self, spark, path):
        jvm = spark.sparkContext._jvm
        self.kind, self.path = jvm.org.apache.hadoop.fs.Path, path
        self.files = self.kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self):
        found = self.files.globStatus(self.kind(f"{self.path}/batch=*/bucket=*"))
        names = [status.getPath() for status in found or []]
        return [(int(p.getParent().getName()[6:]), int(p.getName()[7:])) for p in names]

    def delete(self, name):
        self.files.delete(self.kind(f"{self.path}/{name}"), True)


# ---------------------------------------------------------------- idempotent requests
def _judge(key, frames, state: GroupState):
    known = state.get[0] if state.exists else None
    out = []
    for frame in frames:
        for row in frame.sort_values(["at", "request_id"]).itertuples(index=False):
            if known is None:
                known, outcome = row.fingerprint, "created"
            else:
                outcome = "replayed" if row.fingerprint == known else "conflict"
            out.append((row.request_id, outcome))
    if state.hasTimedOut:
        state.remove()
    elif known is not None:
        state.update((known,))
        state.setTimeoutDuration(24 * 60 * 60 * 1000)
    yield pd.DataFrame(out, columns=["request_id", "outcome"])


def idempotency(requests: DataFrame) -> DataFrame:
    """Outcome of each keyed request: created, replayed or conflict. A key is forgotten after a day
    without requests."""
    return (
        requests.select("workspace", "key", "fingerprint", "at", "request_id")
        .where("key is not null")
        .groupBy("workspace", "key")
        .applyInPandasWithState(
            _judge,
            "request_id long, outcome string",
            "fingerprint string",
            "append",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    )


# ---------------------------------------------------------------- leases
def _watch(key, frames, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], "partial", "worker_interrupted")], columns=["job_id", "status", "stop_reason"])
        return
    lease, done = 0, False
    for frame in frames:
        lease = max(lease, int(frame["lease_ms"].max()))
        done = done or bool((frame["status"] != "running").any())
    if done:
        if state.exists:
            state.remove()
    else:
        if state.exists:
            lease = max(lease, state.get[0])
        state.update((lease,))
        # a lease already behind the watermark ends at the next progress of the clock
        state.setTimeoutTimestamp(max(lease, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([], columns=["job_id", "status", "stop_reason"])


def lease_expiry(heartbeats: DataFrame, delay="0 seconds") -> DataFrame:
    """Jobs whose lease passes without a heartbeat or a final status.

    `heartbeats` has job_id, status, ts and lease_until; the clock is the watermark on `ts`.
    """
    lease = (F.unix_micros("lease_until") / 1000).cast("long")
    return (
        heartbeats.withWatermark("ts", delay)
        .select("job_id", "status", "ts", lease.alias("lease_ms"))
        .groupBy("job_id")
        .applyInPandasWithState(
            _watch,
            "job_id string, status string, stop_reason string",
            "lease long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
