"""Documents to packed training sequences: five stages, each on all that the one before kept.

1. quality: the classifier scores whole texts; documents it rejects go.
2. exact: of equal texts the one with the smallest doc_id stays.
3. near: of each group linked by the similarity of word 5-grams the smallest doc_id stays.
4. mix: documents are repeated or left out so that sources meet their target weights.
5. pack: token pieces are placed in sequences; a document that the mix repeats is packed each time.

A stage returns the columns of `documents`, the last one a row per piece. Every stage is defined for
nulls in any column, empty and very long texts, repeated rows, and empty tables, as its operator is.
"""

from traceloom.llm.common import small_batches, table
from traceloom.llm.exact_dedup import drop_exact_copies
from traceloom.llm.mixing import mixed_documents
from traceloom.llm.ngram_join import keep_one_per_group
from traceloom.llm.packing import pack_documents
from traceloom.llm.quality import keep_accepted
from traceloom.session import scratch_path, tune


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return keep_accepted(docs, table(small_batches(spark), sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near copies."""
    small_batches(spark)
    return keep_one_per_group(docs)


def mix(spark, docs, sf_dir):
    """The mix of sources; a document taken twice is two rows."""
    return mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """Pieces of token sequences of at most 2,048 tokens."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# trained networks, hashes and tokens are beyond SQL: the tests hold run() against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order, each written as Parquet and read again by the next."""
    small_batches(tune(spark))
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
