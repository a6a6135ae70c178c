"""Exact duplicates by deterministic block naming."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, numbered, release

BLOCK_BYTES = 2048


def _heads(docs, doc_id, text):
    """One row per document: key, id, digest of the normalised text and its bytes."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    named = docs.select(F.col(doc_id).alias("doc_id"), normal.alias("normal"))
    owner = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "normal")
    return named.select(
        F.unhex(F.md5(owner.cast("binary"))).alias("key"),
        "doc_id",
        F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"),
        F.col("normal").cast("binary").alias("bytes"),
    )


def _named(rows: DataFrame, columns) -> DataFrame:
    """Integer names of the values that occur at least twice.

    A value that occurs once belongs to a document that has no copy, so it needs no name. The count
    combines in the map tasks, so a value that fills a third of the rows reaches a task as one row
    per map task. Equal values meet in one partition; each partition is sorted and its values are
    numbered in that order, with the partition's number in the high bits. The table is written before
    its names are read, so they never change.
    """
    repeated = rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    numbered = repeated.sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())
    return materialize(numbered)


def _first_level(docs, doc_id, text, block_bytes):
    """Names of the blocks of every document all of whose blocks occur at least twice."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes))).cast("int")
    blocks = _heads(docs, doc_id, text).select(
        "key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), size - 1),
                lambda i: F.expr("bytes").substr(i * block_bytes + 1, F.lit(block_bytes)),
            )
        ).alias("pos", "block"),
    )
    names = _named(blocks.select("block"), ["block"])
    found = blocks.join(names, "block", "left").select("key", "pos", "name")
    whole = found.groupBy("key").agg(
        F.count_if(F.col("name").isNull()).alias("lone"), (F.max("pos") + 1).alias("size"),
        F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name"))).alias("parts"),
    ).where("lone = 0")
    out = materialize(whole.select("key", "size", F.explode("parts").alias("part"))
                      .select("key", "size", "part.pos", "part.name").distinct())
    release(names)
    return out


def block_identities(docs: DataFrame, doc_id="doc_id", text="text", block_bytes=BLOCK_BYTES):
    """(key, level, name) of every document that may have a copy; equal pairs mean equal texts.

    Level 0 names fixed-size blocks; each further level names adjacent pairs of names, until a
    document has one name. A name stands for one exact byte string, so identities cannot collide.
    Documents with a part that occurs nowhere else are left out: nothing equals them.
    """
    level, done = 0, []
    rows = _first_level(docs, doc_id, text, block_bytes)
    while True:
        done.append(rows.where("size = 1").select("key", F.lit(level).alias("level"), "name"))
        longer = rows.where("size > 1")
        if longer.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = longer.groupBy("key", "size", half).agg(
            F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = materialize(pairs.select("key", F.ceil(F.col("size") / 2).cast("int").alias("size"),
                                         "pos", "l", "r"))
        names = _named(pairs, ["l", "r"])
        found = pairs.join(names, ["l", "r"], "left")
        lone = found.where("name is null").select("key").distinct()
        rows = materialize(found.join(lone, "key", "left_anti").select("key", "size", "pos", "name"))
        release(pairs)
        release(names)
        level += 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every


def exact_groups(docs: DataFrame, doc_id="doc_id", text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its key.

    Texts are equal when identical after each run of blanks becomes one space. Null counts as empty;
    all empty texts are one group. Of equal texts the smallest doc_id stays, null ids last. Rows that
    repeat an id and a text are one group of which exactly one row is kept. An empty table gives
    none. Other columns are not read, whatever their names.
    """
    heads = materialize(_heads(docs, doc_id, text).drop("bytes"))
    identities = block_identities(docs, doc_id, text, block_bytes)
    copies = heads.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"),
        F.count("*").alias("rows"),
    )
    marked = materialize(copies.join(identities, "key", "left"))
    groups = marked.where("name is not null").groupBy("level", "name").agg(
        F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")
    )
    lone = marked.where("name is null").select(
        "key", "doc_id", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"),
        "rows", "text_sha256")
    grouped = marked.where("name is not null").join(groups, ["level", "name"]).select(lone.columns)
    every = lone.unionByName(grouped).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return every.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256", "key",
    )


def drop_exact_copies(docs: DataFrame, doc_id="doc_id", text="text", block_bytes=BLOCK_BYTES):
    """The rows of `docs` that stay, with all their columns; see `exact_groups`.

    Of rows that repeat an id and a text one stays, whichever Spark meets first.
    """
    groups = exact_groups(docs, doc_id, text, block_bytes)
    kept = materialize(groups.groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
                       .where("kept").select("key", "rows"))
    plain, names = numbered(docs)
    normal = F.regexp_replace(F.coalesce(F.col(names[text]), F.lit("")), SPACE, " ")
    owner = F.concat_ws("|", F.coalesce(F.col(names[doc_id]).cast("string"), F.lit("null")), normal)
    stay = plain.withColumn("key", F.unhex(F.md5(owner.cast("binary")))).join(kept, "key")
    repeated = stay.where("rows > 1").dropDuplicates(["key"])
    return stay.where("rows = 1").unionByName(repeated).select(*names.values()).toDF(*docs.columns)
