"""Streams over event files that come out of order, run to their end and held against SQL on the table."""

from pyspark.sql import functions as F

from ..operators import runs as rn
from ..session import materialize, scratch_path
from ..streaming import events as st
from ..streaming import ranges as rg
from .catalog import query
from .runs import ORDER, SEQ_SQL, events

FILES = 3


def replayed(spark, sf, rows, columns):
    """(stream, deliver): a stream over `rows` and what brings it the next part of them.

    Parts go by event_id, so that numbers of a stream come out of order. The rows are computed once, and a
    part is written by all tasks: a batch is what was delivered, not a file.
    """
    path = scratch_path(spark, "replay")
    kept = rows.select(*columns, (F.col("event_id") % FILES).alias("__part"))
    schema = kept.drop("__part").schema
    kept = materialize(kept)
    kept.where("false").drop("__part").write.parquet(path)

    def deliver(part):
        kept.where(F.col("__part") == part).drop("__part").write.mode("append").parquet(path)

    return spark.readStream.schema(schema).parquet(path), deliver


def drained(df, mode, deliver, write=None):
    """Run a stream to its end, a batch per delivery; what each batch gave is a table with its number."""
    spark = df.sparkSession
    path, state = scratch_path(spark, "drained"), scratch_path(spark, "checkpoint")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part-{batch_id}")

    each = write(path) if write else keep
    for part in range(FILES):
        deliver(part)
        run = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        run.foreachBatch(each).start().awaitTermination()
    return path if write else spark.read.schema(f"{df._jdf.schema().toDDL()}, batch int").parquet(f"{path}/part-*")


def numbered(spark, sf):
    done = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("failed").alias("status"))))
    return rn.with_sequence(events(spark, sf)).select("stream_id", "event_id", "event_type", "seq", done.alias("payload"))


CURSORS = "c AS (SELECT DISTINCT user_id AS stream_id, user_id % 90 AS after FROM events UNION ALL SELECT -1, 4)"


@query(
    "stream_gaps",
    f"""WITH s AS (SELECT stream_id, seq FROM ({SEQ_SQL}) WHERE event_type <> 'signup'), {CURSORS},
 x AS (SELECT stream_id, seq FROM s JOIN c USING (stream_id) WHERE seq > after UNION ALL SELECT stream_id, after FROM c),
 y AS (SELECT stream_id, seq, lead(seq) OVER (PARTITION BY stream_id ORDER BY seq) AS nxt FROM x)
SELECT stream_id, seq AS after, nxt - 1 AS resume_at, false AS beyond FROM y WHERE nxt > seq + 1
UNION ALL SELECT stream_id, after, coalesce(max(seq), 0), true FROM c LEFT JOIN s USING (stream_id) GROUP BY ALL HAVING after > coalesce(max(seq), 0)""",
)
def stream_gaps(spark, sf):
    """Gaps that are open when all files are read, and cursors ahead of their stream."""
    rows = numbered(spark, sf).where("event_type <> 'signup'")
    cursors = events(spark, sf).select("stream_id", (F.col("stream_id") % 90).alias("after")).distinct()
    cursors = cursors.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(4).cast("long")))
    stream, deliver = replayed(spark, sf, rows, ["stream_id", "seq"])
    got = drained(rg.stream_progress(stream, cursors), "update", deliver)
    last = got.groupBy("stream_id").agg(F.max_by(F.struct("head", "gaps"), "batch").alias("p"))
    gaps = last.select("stream_id", F.explode("p.gaps").alias("g")).select("stream_id", "g.after", "g.resume_at", F.lit(False).alias("beyond"))
    heads = range_heads(rows)
    ahead = cursors.join(heads, "stream_id", "left").where("after > coalesce(head, 0)")
    return gaps.union(ahead.select("stream_id", "after", F.coalesce("head", F.lit(0)).alias("resume_at"), F.lit(True)))


def range_heads(rows):
    return rows.groupBy("stream_id").agg(F.max("seq").alias("head"))


@query(
    "stream_gaps_of_table",
    f"""WITH s AS (SELECT stream_id, seq FROM ({SEQ_SQL}) WHERE event_type <> 'signup'), {CURSORS},
 x AS (SELECT stream_id, seq FROM s JOIN c USING (stream_id) WHERE seq > after UNION ALL SELECT stream_id, after FROM c),
 y AS (SELECT stream_id, seq, lead(seq) OVER (PARTITION BY stream_id ORDER BY seq) AS nxt FROM x),
 h AS (SELECT stream_id, after, coalesce(max(seq), 0) AS head FROM c LEFT JOIN s USING (stream_id) GROUP BY ALL)
SELECT h.stream_id, head, after > head AS beyond, count(nxt) FILTER (nxt > seq + 1) AS gaps, CAST(coalesce(sum(nxt - seq - 1), 0) AS BIGINT) AS missing FROM h JOIN y USING (stream_id) GROUP BY ALL""",
)
def stream_gaps_of_table(spark, sf):
    """The same from a table: head, cursor ahead, number of gaps and of missing events per stream."""
    rows = numbered(spark, sf).where("event_type <> 'signup'").select("stream_id", "seq")
    cursors = events(spark, sf).select("stream_id", (F.col("stream_id") % 90).alias("after")).distinct()
    cursors = cursors.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(4).cast("long")))
    got = rg.progress_table(rg.range_rows(rows), cursors)
    missing = F.aggregate("gaps", F.lit(0).cast("long"), lambda n, g: n + g["resume_at"] - g["after"])
    return got.select("stream_id", "head", "beyond", F.size("gaps").cast("long").alias("gaps"), missing.alias("missing"))


@query("stream_tail", f"SELECT stream_id, event_id, seq FROM ({SEQ_SQL}) WHERE seq > 5")
def stream_tail(spark, sf):
    """Events after a cursor, as a stream."""
    columns = ["stream_id", "event_id", "seq"]
    stream, deliver = replayed(spark, sf, numbered(spark, sf), columns)
    return drained(stream.where("seq > 5"), "append", deliver).drop("batch")


@query(
    "stream_terminal",
    f"""WITH s AS (SELECT * FROM ({SEQ_SQL}) WHERE NOT (event_type = 'signup' AND stream_id % 3 = 0)),
 p AS (SELECT stream_id, n, count(seq) AS seen, max(seq) AS head, bool_or(event_type = 'error') AS ended FROM s, (SELECT unnest(range(0, {FILES})) AS n) WHERE event_id % {FILES} <= n GROUP BY ALL)
SELECT DISTINCT stream_id, 'failed' AS status FROM p WHERE ended AND seen = head""",
)
def stream_terminal(spark, sf):
    """Streams that ended and have all their numbers, each once, whenever that came to be."""
    rows = numbered(spark, sf).where("not (event_type = 'signup' and stream_id % 3 = 0)")
    stream, deliver = replayed(spark, sf, rows, ["stream_id", "seq", "payload"])
    return drained(rg.finished_streams(stream), "append", deliver).select("stream_id", "status")


@query("stream_seq", f"SELECT stream_id, event_id, row_number() OVER ({ORDER.replace('ORDER BY', f'ORDER BY event_id % {FILES},')}) AS seq FROM ({SEQ_SQL})")
def stream_seq(spark, sf):
    """Numbers that a stream gives to events as their files come."""
    stream, deliver = replayed(spark, sf, events(spark, sf), ["stream_id", "event_id", "ts"])
    path = drained(stream, "append", deliver, lambda path: st.sequence_writer(path, heads=8, compact=2))
    return spark.read.parquet(f"{path}/events/batch=*").select("stream_id", "event_id", "seq")
