"""Documents linked by the Jaccard similarity of their word n-grams: a size-aware heavy-light join."""

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, numbered, release, text_groups
from .hashing import Hashes, mix
from .linking import linked_groups

WORDS = 5
PERCENT = 75  # links from intersection * 100 >= PERCENT * union
BUCKET_ITEMS = 2_000_000  # n-grams of a bucket that one task holds
MARKS = ("m0", "m1", "m2", "m3")
MOST_SMALL = 12  # subsets are considered for sets of up to so many n-grams

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def ngram_sets(texts, words=WORDS):
    """The sorted distinct n-gram hashes (64 bits) of each whole text.

    A-Z are lower-cased and words parted at ASCII blanks. With fewer words the whole sequence is one
    n-gram; without words the set is empty. Two n-grams of one pair of documents share a hash with a
    probability near 2 ** -64 each, so similarities are those of the n-grams themselves.
    """
    raw = [b" " + t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"".join(raw) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(_BLANK[data].view(np.int8)))
    starts, stops = edges[0::2] + 1, edges[1::2] + 1
    owner = np.searchsorted(np.cumsum([len(r) for r in raw]), starts, "right")
    counts = np.bincount(owner, minlength=len(texts))
    h = Hashes(data).of(starts, stops)
    firsts = np.cumsum(counts) - counts
    out = [np.zeros(0, np.uint64)] * len(texts)
    whole = _grams(h, words)
    for i in np.flatnonzero(counts):
        if counts[i] >= words:
            out[i] = np.unique(whole[firsts[i] : firsts[i] + counts[i] - words + 1])
        else:
            out[i] = _grams(h[firsts[i] : firsts[i] + counts[i]], int(counts[i]))
    return out


def _grams(h, n):
    """Hashes of every n consecutive words, given those of the words."""
    total = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(total)


def _digest(hashes):
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _need(a, b, percent):
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _first_part(n):
    """How many of a set's smallest hashes the first filter looks at."""
    return np.minimum((n + 1) // 2 + 1, n)


def least_shared(n, percent=PERCENT):
    """Hashes of its first part that a set of size n shares with any set it is linked to.

    Take linked sets of sizes a, b with intersection o. Of the one whose first part ends earlier, all
    but size - o of that part are in the other, and in the other's first part too.
    """
    b = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    o = _need(n, b, percent)
    return int(min((_first_part(n) - (n - o)).min(), (_first_part(b) - (b - o)).min())) if n else 0


def _set_rows(words, percent):
    least = {}

    def rows(batches):
        for batch in batches:
            for part in text_groups(batch, 1):
                sets = ngram_sets([t or "" for t in part.column(1).to_pylist()], words)
                sizes = [len(s) for s in sets]
                for n in set(sizes) - least.keys():
                    least[n] = least_shared(n, percent)
                keys = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(_names(keys)), pa.array([least[n] for n in sizes], pa.int64())],
                    names=["doc_id", "n_shingles", "set_key", "name", "least"])

    return rows


def _names(keys):
    """64 bits of each key, the sets' names in the first filter; a collision only lets a set through."""
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def _spread(words, buckets):
    """First parts of all sets, dealt to buckets by hash: one row per slice of texts and bucket."""

    def rows(batches):
        for batch in batches:
            for part in text_groups(batch, 0, 2_000_000):
                sets = [s for s in ngram_sets([t or "" for t in part.column(0).to_pylist()], words) if len(s)]
                if not sets:
                    continue
                names = _names([_digest(s) for s in sets])
                first = [s[: _first_part(len(s))] for s in sets]
                flat = np.concatenate(first)
                owner = np.repeat(np.arange(len(sets)), [len(f) for f in first])
                home = ((flat & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.argsort(home, kind="stable")
                home, owner, flat = home[order].astype(np.int64), owner[order], flat[order]
                cuts = np.flatnonzero(np.diff(home, prepend=-1))
                out = [[], [], [], []]
                for a, z in zip(cuts, np.append(cuts[1:], len(home))):
                    new = np.flatnonzero(np.diff(owner[a:z], prepend=-1))
                    out[0].append(int(home[a]))
                    out[1].append(flat[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    out[2].append(names[owner[a:z][new]].tobytes())
                    out[3].append(np.diff(np.append(new, z - a)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *[pa.array(o, pa.binary()) for o in out[1:]]],
                    names=["bucket", "hashes", "names", "counts"])

    return rows


def _shared(table):
    """How many of each set's hashes in this bucket another set has too."""
    raw = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint8).reshape(-1, 6)
    hashes = np.zeros((len(raw), 8), np.uint8)
    hashes[:, :6] = raw
    hashes = hashes.view("<u8").ravel()
    names = np.repeat(np.frombuffer(b"".join(table["names"].to_pylist()), np.int64),
                      np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4"))
    order = np.lexsort((names, hashes))
    hashes, names = hashes[order], names[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (names[1:] != names[:-1])  # equal sets count once
    hashes, names = hashes[new], names[new]
    same = hashes[1:] == hashes[:-1]
    both = np.zeros(len(hashes), bool)
    both[1:] |= same
    both[:-1] |= same
    found, counts = np.unique(names[both], return_counts=True)
    return pa.table({"name": found, "shared": counts})


def _whole_sets(words):
    def rows(batches):
        for batch in batches:
            for part in text_groups(batch, 1):
                sets = ngram_sets([t or "" for t in part.column(1).to_pylist()], words)
                own = [i for i, (k, s) in enumerate(zip(part.column(0).to_pylist(), sets)) if _digest(s) == k]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own, pa.int64())),
                     pa.array([len(sets[i]) for i in own], pa.int64()),
                     pa.array([sets[i].tobytes() for i in own], pa.binary())],
                    names=["set_key", "n", "hashes"])

    return rows


def candidate_sets(docs, sets, words, percent):
    """(id, set_key, n, hashes) of the distinct sets that may be linked to another set.

    All first parts are dealt out by hash and counted against each other, in packed form; sets that
    share too few of theirs are linked to nothing. What remains is read again, whole.
    """
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(16, int(total // 2 // BUCKET_ITEMS) + 1)
    dealt = docs.select("text").mapInArrow(
        _spread(words, buckets), "bucket int, hashes binary, names binary, counts binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "name long, shared long")
    shared = shared.groupBy("name").agg(F.sum("shared").alias("shared"))
    distinct = sets.where("n_shingles > 0").groupBy("set_key").agg(
        F.first("name").alias("name"), F.first("least").alias("least"), F.min("doc_id").alias("c_doc"))
    wanted = materialize(distinct.join(shared, "name").where("shared >= least").select("set_key", "c_doc"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("c_doc"))).select("set_key", "text")
    whole = texts.mapInArrow(_whole_sets(words), "set_key binary, n long, hashes binary")
    once = whole.groupBy("set_key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    return materialize(once.withColumn("id", F.monotonically_increasing_id()))


def _items(batches):
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            sizes = part.column(1).to_numpy()
            flat = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)),
                 pa.array(flat)], names=["id", "n", "item"])


def _marks(batches):
    """256 parity bits per set: two sets differ in at least as many items as their marks in bits."""
    for batch in batches:
        rows = []
        for raw in batch.column(1).to_pylist():
            odd = np.bincount(np.frombuffer(raw, np.uint64) & np.uint64(255), minlength=256) & 1
            rows.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        table = np.asarray(rows, np.int64).reshape(-1, len(MARKS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(table[:, i]) for i in range(len(MARKS))]], names=["id", *MARKS])


def _partners(n, most, percent):
    """(size, intersection) of the sets of at most `most` n-grams that a set of n can be linked to."""
    for b in range(-(-percent * n // 100), min(most, 100 * n // percent) + 1):
        yield b, _need(n, b, percent)


def _subsets(most, percent):
    """Fixed-size subsets of small sets: linked sets of sizes a, b share one of `_need(a, b)` items."""

    def rows(batches):
        for batch in batches:
            ids, keys = [], []
            for name, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                items = np.frombuffer(raw, np.uint64)
                for b, size in _partners(n, most, percent):
                    if size > n:
                        continue
                    picks = np.asarray(list(combinations(range(n), size)), np.int64)
                    key = np.full(len(picks), (min(n, b) << 32) | max(n, b), np.uint64)
                    for k in range(size):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + items[picks[:, k]])
                    keys.append(key.view(np.int64))
                    ids.append(np.full(len(key), name, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["bucket", "id"])

    return rows


def small_boundary(counts: dict, list_length, percent=PERCENT, most=MOST_SMALL):
    """Size up to which sets are matched by subsets, chosen by cost.

    `counts` has the number of sets by size, up to 2 * most; `list_length` is the mean length of the
    inverted list of an item. Sets above the boundary, and those that can be linked to one, scan lists.
    """

    def cost(x):
        subsets = sum(c * sum(comb(n, size) for b, size in _partners(n, x, percent) if size <= n)
                      for n, c in counts.items() if 0 < n <= x)
        scans = sum(c * (n - -(-percent * n // 100) + 1) * list_length
                    for n, c in counts.items() if 100 * n >= percent * (x + 1))
        return subsets + scans

    return min(range(most + 1), key=cost)


def _verified(sets, percent):
    def check(batches):
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                x, y = np.frombuffer(left[i], np.uint64), np.frombuffer(right[i], np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            got = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(got)), batch.column(1).take(pa.array(got))], names=["a", "b"])

    def verify(pairs):
        one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("left"))
        two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("right"))
        sized = pairs.join(one.drop("left"), "a").join(two.drop("right"), "b")
        near = sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        return near.join(one.drop("na"), "a").join(two.drop("nb"), "b").select(
            "a", "b", "left", "right").mapInArrow(check, "a long, b long")

    return verify


def link_sets(sets: DataFrame, percent=PERCENT) -> DataFrame:
    """(node, root) of the ids of distinct sets (id, n, hashes) by their links.

    Size-aware heavy-light join: pairs of small sets meet in the subset of items they must share;
    all others meet in an inverted list. Lists are those of a set's rarest items only, as many as a
    linked set cannot avoid, so an item that very many sets have is not scanned unless nearly all of
    a set is that common.
    """
    items = materialize(sets.select("id", "n", "hashes").mapInArrow(_items, "id long, n long, item long"))
    spread = items.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1")
    spread = materialize(spread)
    mean = spread.agg(F.sum(F.col("sets") * F.col("sets")) / F.sum("sets")).first()[0] or 1.0
    counts = {r["n"]: r["count"] for r in
              sets.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").count().collect()}
    small = small_boundary(counts, mean, percent)
    scanned = items.where(100 * F.col("n") >= percent * (small + 1)).join(spread, "item")
    own = W.partitionBy("id")
    ranked = scanned.withColumn("rank", F.row_number().over(own.orderBy("sets", "item"))).withColumn(
        "shared", F.count("*").over(own))
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    # rank among all of the set's items: those that no other set has come first
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("n") - F.col("shared"))
    lists = ranked.where(F.col("rank") <= first).select(
        F.col("item").alias("bucket"), "id", F.struct("n", (F.col("n") - F.col("rank") + 1).alias("rest")).alias("sig"))
    subsets = sets.where(F.col("n") <= small).select("id", "n", "hashes").mapInArrow(
        _subsets(small, percent), "bucket long, id long").join(sets.select("id", "n"), "id").select(
        "bucket", "id", F.struct("n", F.col("n").alias("rest")).alias("sig")).distinct()

    def may_link(a, b):
        """In the list of the first item two sets share, what is left of both must hold their overlap."""
        return (100 + percent) * F.least(a["rest"], b["rest"]) >= percent * (a["n"] + b["n"])

    def not_far(a, b, x, y):
        apart = sum((F.bit_count(x[m].bitwiseXOR(y[m])) for m in MARKS), F.lit(0))
        return (100 + percent) * apart <= (100 - percent) * (a["n"] + b["n"])

    marks = materialize(sets.select("id", "hashes").mapInArrow(
        _marks, "id long, " + ", ".join(f"{m} long" for m in MARKS)).select("id", F.struct(*MARKS).alias("mark")))
    groups = linked_groups(
        lists.unionByName(subsets), _verified(sets, percent), close=may_link, marks=marks, not_far=not_far)
    release(items)
    return groups


def ngram_groups(docs: DataFrame, words=WORDS, percent=PERCENT, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and the key of its set.

    Two documents link when intersection * 100 >= `percent` * union of their sets of distinct
    `words`-word n-grams; component_id is the smallest doc_id reachable by links, itself included.
    Equal sets are one node, so copies are never paired. Null and empty texts, and blanks alone, have
    an empty set and are linked with nothing. Null ids sort last. Repeated rows are copies. An empty
    table gives no rows. Other columns are not read.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(slim.mapInArrow(
        _set_rows(words, percent), "doc_id long, n_shingles long, set_key binary, name long, least long"))
    candidates = candidate_sets(slim, sets, words, percent)
    roots = materialize(link_sets(candidates, percent))
    grouped = candidates.select("id", "set_key").join(roots, F.col("id") == F.col("node"), "left").select(
        "set_key", F.coalesce("root", "id").alias("root"))
    distinct = sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least_doc"))
    known = materialize(distinct.join(grouped, "set_key", "left"))
    smallest = known.where("root is not null").groupBy("root").agg(F.min("least_doc").alias("group_doc"))
    named = materialize(known.join(smallest, "root", "left").select(
        "set_key", F.coalesce("group_doc", "least_doc").alias("component")))
    return sets.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "set_key")


def keep_one_per_group(docs: DataFrame, words=WORDS, percent=PERCENT, doc_id="doc_id", text="text"):
    """The rows of `docs`, all columns, that stay: of each group the one with the smallest doc_id.

    Documents with an empty set are linked with nothing and stay. Of rows that repeat the kept id one
    stays.
    """
    groups = ngram_groups(docs, words, percent, doc_id, text)
    kept = materialize(groups.where("component_id <=> doc_id").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.max("n_shingles").alias("n")))
    plain, names = numbered(docs)
    own = names[doc_id]
    stay = plain.join(kept, F.col(own).eqNullSafe(F.col("doc_id")))
    single = (F.col("rows") == 1) | (F.col("n") == 0)
    repeated = stay.where(~single).dropDuplicates([own])
    return stay.where(single).unionByName(repeated).select(*names.values()).toDF(*docs.columns)
