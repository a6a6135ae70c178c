"""A replayed table is computed once and delivered by all tasks; a batch is a delivery, not a file."""

from pyspark.sql import functions as F

from traceloom.plans import streams as pl


def test_a_delivery_of_many_files_is_one_batch(spark):
    """Before, each part was computed anew and written by one task, so that a file was a batch."""
    rows = spark.range(0, 40, 1, 4).withColumnRenamed("id", "event_id")
    stream, deliver = pl.replayed(spark, None, rows, ["event_id"])
    written = []

    def counted(part):
        deliver(part)
        written.append(part)

    got = pl.drained(stream, "append", counted)
    assert written == list(range(pl.FILES))
    assert {(r.event_id, r.batch) for r in got.collect()} == {(i, i % pl.FILES) for i in range(40)}
    assert got.where("batch = 0").select(F.input_file_name()).distinct().count() > 1


def test_a_part_without_rows(spark):
    rows = spark.range(0, 9, 3).withColumnRenamed("id", "event_id")
    got = pl.drained(*(lambda s: (s[0], "append", s[1]))(pl.replayed(spark, None, rows, ["event_id"])))
    assert sorted(r.event_id for r in got.collect()) == [0, 3, 6]
