"""Helpers the corpus operators share."""

from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame):
    """`df` with columns c0, c1, ..., and their names by the old ones; nothing clashes with these."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def release(df: DataFrame):
    """Delete the files of a table that `materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = files(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(*columns, seed=0):
    """A number strictly between 0 and 1, the same for the same values in every run."""
    hashed = F.xxhash64(*columns, F.lit(seed))
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def text_groups(batch, column, characters=1_000_000):
    """Slices of an Arrow batch whose texts hold about so many characters, a longer text by itself."""
    at, held = 0, 0
    sizes = pc.coalesce(pc.utf8_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > characters:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def small_batches(spark):
    """Arrow batches of at most 1,000 rows and some 8 MB: texts are long, and workers share memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


_cache = {}


def word_cache(owner):
    """The one cache of words that a Python worker holds; what another operator left is given back.

    Workers are used again by later stages, so caches of their own would add up in an executor.
    """
    if owner not in _cache:
        _cache.clear()
        _cache[owner] = {}
    return _cache[owner]


def give_back(batches, keep=50_000):
    """The batches of a partition; after the last one the worker keeps few cached words and no free buffers.

    Frequent words are met first, so the first ones are kept for the next partition.
    """
    try:
        yield from batches
    finally:
        for owner, words in _cache.items():
            if len(words) > keep:
                _cache[owner] = dict(islice(words.items(), keep))
        pa.default_memory_pool().release_unused()
