"""Streaming operators on file sources, compared with their batch twins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from traceloom.operators import runs as rn
from traceloom.streaming import events as st

START = datetime(2026, 1, 1)


def event(stream, seq, kind="node.added", entity="n", payload='{"v":1}'):
    return (stream, seq, seq, START + timedelta(minutes=seq), kind, "g", entity, payload)


def drain(df, tmp_path, name, mode="append", each=None):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}"))
    writer = writer.trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("memory").queryName(name)
    query = writer.start()
    query.awaitTermination(120)
    assert query.exception() is None
    return None if each else df.sparkSession.table(name)


def write_batches(spark, path, *batches, schema=st.EVENT):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_gap_and_resume(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [event("a", 1), event("a", 2), event("b", 4)], [event("a", 5), event("b", 5)])
    out = drain(st.snapshot_required(st.tail(spark, str(tmp_path / "in"), files_per_batch=1)), tmp_path, "gaps")
    assert {tuple(r) for r in out.collect()} == {("a", 2, 4), ("b", 0, 3)}


def test_tail_from_cursor(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [event("a", i) for i in range(1, 8)])
    out = drain(st.tail(spark, str(tmp_path / "in"), after=5), tmp_path, "tail")
    assert sorted(r.seq for r in out.collect()) == [6, 7]


def test_terminal_once(spark, tmp_path):
    done = '{"status":"completed"}'
    write_batches(
        spark, tmp_path / "in",
        [event("a", 1), event("a", 2, "run.completed", payload=done)],
        [event("a", 3, "run.completed", payload=done), event("b", 1, "run.status", payload='{"status":"running"}')],
    )
    out = drain(st.finished_streams(st.tail(spark, str(tmp_path / "in"), files_per_batch=1)), tmp_path, "ends")
    assert [(r.stream_id, r.seq, r.status) for r in out.collect()] == [("a", 2, "completed")]


def test_current_state_equals_batch(spark, tmp_path):
    data = [event("a", i, "node.updated" if i % 3 else "edge.added", f"n{i % 4}", str(i)) for i in range(1, 30)]
    write_batches(spark, tmp_path / "in", data[:15], data[15:])
    out = drain(st.current_state(st.tail(spark, str(tmp_path / "in"))), tmp_path, "fold", "complete")
    batch = rn.current_state(spark.read.parquet(str(tmp_path / "in")))
    columns = ["graph_id", "what", "entity_id", "payload", "seq"]
    assert {tuple(r) for r in out.select(*columns).collect()} == {tuple(r) for r in batch.select(*columns).collect()}


def test_live_counters(spark, tmp_path):
    write_batches(
        spark, tmp_path / "in",
        [event("r", 1, "run.status", payload="1"), event("r", 2, "budget.updated", payload="2")],
        [event("r", 3, "run.status", payload="3")],
    )
    out = drain(st.live_counters(st.tail(spark, str(tmp_path / "in"))), tmp_path, "counters", "complete")
    assert {(r.type, r.payload) for r in out.collect()} == {("run.status", "3"), ("budget.updated", "2")}


def test_sequence_across_batches(spark, tmp_path):
    raw = lambda s, i: (s, i, None, START + timedelta(hours=i), "x", "g", "e", "p")
    write_batches(spark, tmp_path / "in", [raw("a", i) for i in range(5)] + [raw("b", 1)], [raw("a", i) for i in range(5, 9)])
    stream = spark.readStream.schema(st.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(stream.drop("seq"), tmp_path, "seq", each=st.sequence_writer(str(tmp_path / "out")))
    out = spark.read.parquet(str(tmp_path / "out/events"))
    assert sorted(r.seq for r in out.where("stream_id = 'a'").collect()) == list(range(1, 10))
    assert [r.seq for r in out.where("stream_id = 'b'").collect()] == [1]


def test_idempotency(spark, tmp_path):
    schema = "workspace string, key string, fingerprint string, at timestamp, request_id long"
    first = [("w", "k", "f", START, 1), ("w", "k2", "x", START, 2), ("w", None, "z", START, 9)]
    second = [("w", "k", "f", START + timedelta(hours=1), 3), ("w", "k2", "y", START + timedelta(hours=1), 4)]
    write_batches(spark, tmp_path / "in", first, second, schema=schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(st.idempotency(stream), tmp_path, "idem")
    found = {(r.request_id, r.outcome) for r in out.collect()}
    batch = rn.idempotency(spark.read.parquet(str(tmp_path / "in"))).where("key is not null")
    assert found == {(r.request_id, r.outcome) for r in batch.collect()}
    assert found == {(1, "created"), (2, "created"), (3, "replayed"), (4, "conflict")}


def test_lease_expiry(spark, tmp_path):
    schema = "job_id string, status string, ts timestamp, lease_until timestamp"
    at = lambda m: START + timedelta(minutes=m)
    write_batches(
        spark, tmp_path / "in",
        [("lost", "running", at(0), at(5)), ("kept", "running", at(0), at(5)), ("done", "running", at(0), at(5))],
        [("kept", "running", at(4), at(60)), ("done", "completed", at(4), at(5))],
        [("tick", "completed", at(10), at(10))],
        [("tick", "completed", at(11), at(11))],
        schema=schema,
    )
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(st.lease_expiry(stream), tmp_path, "lease")
    assert [tuple(r) for r in out.collect()] == [("lost", "partial", "worker_interrupted")]


def test_batch_sequence_and_retention(spark, rows):
    data = [("s", i, START + timedelta(minutes=i * 7)) for i in range(40)]
    out = rn.with_sequence(rows(data, "stream_id string, event_id long, ts timestamp"))
    assert [r.seq for r in out.orderBy("ts").collect()] == list(range(1, 41))
    assert rn.retained(out, 10).agg(F.min("seq")).first()[0] == 31
    cursors = rows([("s", 5), ("s", 31), ("s", 99)], "stream_id string, after long")
    missing = rn.snapshot_required(cursors, rn.retained(out, 10))
    assert rows.of(missing, "after", "resume_at") == [(5, 30), (99, 40)]
