"""Importance resampling towards a target distribution of hashed n-grams."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_totals
from .common import materialize, numbered, text_groups

BUCKETS = 10_000
SALT = "2024"
LEAST_WORDS = 20
PERCENT = 10
CACHED_WORDS = 200_000  # words of a partition whose gain is kept; each at most CACHED_BYTES long
CACHED_BYTES = 48
SLOT = 16  # scores that share a slice when ranks are counted


def _table():
    """Lower case for A-Z, a blank for every other ASCII byte but digits and a-z; UTF-8 bytes stay."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                 for b in range(256))


TABLE = _table()


def words(text: bytes):
    return text.translate(TABLE).split()


def _longer(found, seeds, order):
    """Checksums of the runs of `order` words, each from that of the run one word shorter."""
    return [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, found[order - 1 :])]


def _bytes(part, at):
    return [t or b"" for t in part.column(at).cast(pa.large_binary()).to_pylist()]


def _counted(grams, buckets):
    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_groups(batch, 0):
                single, longer = Counter(), Counter()
                for text in _bytes(part, 0):
                    found = words(text)
                    single.update(found)
                    if grams > 1:
                        seeds = list(map(zlib.crc32, found))
                        for order in range(2, grams + 1):
                            seeds = _longer(found, seeds, order)
                            longer.update(seeds)
                for sums_of, sizes in ((list(map(zlib.crc32, single)), single), (list(longer), longer)):
                    at = np.asarray(sums_of, np.int64) % buckets
                    sums[:] += np.bincount(at, np.fromiter(sizes.values(), np.int64, len(sizes)),
                                           buckets).astype(np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], names=["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, text="text", grams=1, buckets=BUCKETS) -> np.ndarray:
    """Features of all whole texts per bucket; the driver gets at most `buckets` numbers."""
    got = docs.select(F.col(text).alias("text")).mapInArrow(_counted(grams, buckets), "bucket long, n long")
    got = got.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the source."""
    buckets = len(source)
    ratio = (target + 1.0) * float(source.sum() + buckets) / ((source + 1.0) * float(target.sum() + buckets))
    return [math.floor(1000 * math.log(r)) for r in ratio.tolist()]


class _Gains(dict):
    """Gains of single words, the first ones seen kept."""

    def __init__(self, gains):
        super().__init__()
        self.gains = gains

    def __missing__(self, word):
        gain = self.gains[zlib.crc32(word) % len(self.gains)]
        if len(self) < CACHED_WORDS and len(word) <= CACHED_BYTES:
            self[word] = gain
        return gain


def _weighed(gains, grams, at):
    def weigh(batches):
        known = _Gains(gains)
        for batch in batches:
            for part in text_groups(batch, at):
                sizes, features, weights = [], [], []
                for text in _bytes(part, at):
                    found = words(text)
                    total, n = sum(map(known.__getitem__, found)), len(found)
                    if grams > 1:
                        seeds = list(map(zlib.crc32, found))
                        for order in range(2, grams + 1):
                            seeds = _longer(found, seeds, order)
                            total += sum(gains[s % len(gains)] for s in seeds)
                            n += len(seeds)
                    sizes.append(len(found))
                    features.append(n)
                    weights.append(total // n if n else 0)
                kept = [i for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in kept], *[pa.array(v, pa.int64()) for v in (sizes, features, weights)]],
                    names=[*[part.schema.names[i] for i in kept], "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id, salt=SALT):
    """Floored thousandths of a Gumbel variate that is fixed by the id; a null id reads as empty."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text.cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent=PERCENT, grams=1, buckets=BUCKETS, salt=SALT,
             least_words=LEAST_WORDS, doc_id="doc_id", text="text", target_text="text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn).

    Features are all runs of 1 to `grams` words of a whole text. Bucket counts come from all documents
    and all target texts. Of the documents with `least_words` words the best `percent` percent by score
    (weight plus fixed noise) are drawn, ties to the smaller id, null ids last.

    Null and empty texts have no features and weight 0. Repeated rows are scored alike and ranked one
    after the other. With empty documents there are no rows; with an empty target every share is even.
    Other columns are not read. Two passes read the texts; ranks are counted per slice of scores, and
    only the slices that can be drawn from are sorted. Scores are logarithms, so the slices are a few
    thousand whatever the corpus.
    """
    gains = bucket_gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    slim, _ = numbered(docs.select(doc_id, text))
    kind = slim.schema["c0"].dataType.simpleString()
    weighed = slim.mapInArrow(_weighed(gains, grams, 1), f"c0 {kind}, n_words long, n_features long, weight long")
    scored = materialize(weighed.select(
        F.col("c0").alias("doc_id"), "n_words", "n_features", "weight",
        (F.col("weight") + noise(F.col("c0"), salt)).alias("score")))
    slot = -F.floor(F.col("score") / SLOT)
    able = F.col("n_words") >= least_words
    sizes = sorted(map(tuple, scored.where(able).groupBy(slot.alias("slot")).count().collect()))
    quota, last, seen = percent * sum(n for _, n in sizes) // 100, None, 0
    for at, n in sizes:
        if seen >= quota:
            break
        last, seen = at, seen + n
    near = able & (slot <= F.lit(last)) if last is not None else F.lit(False)
    ranked = running_totals(
        scored.where(near).withColumn("all", F.lit(0)), ["all"],
        [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], slot, {"rank": F.lit(1)})
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank")).unionByName(
        scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, doc_id="doc_id", **options) -> DataFrame:
    """The drawn rows of `docs`, all columns; ids must be unique and not null."""
    best = resample(docs, target, doc_id=doc_id, **options).where("rank is not null")
    return docs.join(best.select(F.col("doc_id").alias(doc_id)), doc_id, "left_semi").select(*docs.columns)
