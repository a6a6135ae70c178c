"""Product codes of vectors: exact integer k-means per part over Hilbert-sorted blocks with boxes."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 256  # points of a block

BLOCKS = "part int, ids binary, points binary, low binary, high binary, sums binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of cells (n x d, each below 2^bits), by bit transposition."""
    axes = [c.copy() for c in cells.T.astype(np.int64)]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for axis in axes:
            on = (axis & q) != 0
            swap = np.where(on, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(on, low, swap)
            if axis is not axes[0]:
                axis ^= swap
        q >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn, q = np.zeros(len(cells), np.int64), top
    while q > 1:
        turn ^= np.where(axes[-1] & q, q - 1, 0)
        q >>= 1
    keys = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | (((axis ^ turn) >> bit) & 1)
    return keys


def _split(width, parts, low, high):
    """Rows (part, key, row, point) of every vector's parts."""
    size = width // parts
    seen = min(size, 62)  # more dimensions than bits: the rest does not steer the order
    bits = max(1, min(8, 62 // seen))
    span = np.maximum(high - low + 1, 1)

    def split(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            values = batch.column(1).flatten().to_numpy().reshape(-1, width)
            cells = ((values - low).astype(np.float64) / span * (1 << bits)).astype(np.int64)
            for part in range(parts):
                own = slice(part * size, (part + 1) * size)
                points = np.ascontiguousarray(values[:, own].astype("<i4"))
                keys = hilbert_keys(cells[:, own][:, :seen], bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part, np.int32)), pa.array(keys), pa.array(rows),
                     pa.array([p.tobytes() for p in points], pa.binary())],
                    names=["part", "key", "row", "point"])

    return split


def _blocks(size):
    """Runs of at most `BLOCK` sorted points of one part as flat blocks with box and sum."""

    def build(batches):
        part, ids, points = None, [], []

        def close():
            flat = np.frombuffer(b"".join(points), "<i4").reshape(-1, size).astype("<i8")
            return [part, np.asarray(ids, "<i8").tobytes(), flat.astype("<i4").tobytes(),
                    flat.min(0).tobytes(), flat.max(0).tobytes(), flat.sum(0).tobytes()]

        def flush(done):
            types = [pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*done), types)],
                names=["part", "ids", "points", "low", "high", "sums"])

        for batch in batches:
            done = []
            for p, row, point in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if ids and (p != part or len(ids) == BLOCK):
                    done.append(close())
                    ids, points = [], []
                part = p
                ids.append(row)
                points.append(point)
            if done:
                yield flush(done)
        if ids:
            yield flush([close()])

    return build


def _shortlists(low, high, entries):
    """Entries that can be nearest to a point of each box: no other one is surely nearer."""
    below, above = low[:, None] - entries, entries - high[:, None]
    near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
    far = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
    return near <= far.min(1, keepdims=True)


def _nearest(points, entries, able):
    """(entry, squared distance) of each point among the able entries, ties to the lower index."""
    distances = ((points[:, None] - entries[able]) ** 2).sum(2)
    at = distances.argmin(1)
    return able[at], distances[np.arange(len(points)), at]


def _each_block(batch, books):
    """(part, block number, able entries) of a batch's blocks, and the batch's columns as lists."""
    part, ids, points, low, high, sums = [c.to_pylist() for c in batch.columns]
    for p in sorted(set(part)):
        own = [i for i, x in enumerate(part) if x == p]
        size = books[p].shape[1]
        boxes = [np.frombuffer(b"".join(x[i] for i in own), "<i8").reshape(-1, size) for x in (low, high)]
        for i, able in zip(own, _shortlists(*boxes, books[p])):
            yield p, np.flatnonzero(able), ids[i], points[i], sums[i]


def _round(books):
    """Partial sums (part, entry, place, total) of a partition; place -1 is the number of points."""

    def run(batches):
        totals = [np.zeros((b.shape[0], b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for p, able, ids, points, sums in _each_block(batch, books):
                size = books[p].shape[1]
                if len(able) == 1:
                    totals[p][able[0], 1:] += np.frombuffer(sums, "<i8")
                    totals[p][able[0], 0] += len(ids) // 8
                    continue
                flat = np.frombuffer(points, "<i4").reshape(-1, size).astype(np.int64)
                entry, _ = _nearest(flat, books[p], able)
                totals[p][:, 0] += np.bincount(entry, minlength=len(books[p]))
                for e in np.unique(entry):
                    totals[p][e, 1:] += flat[entry == e].sum(0)
        found = [(p, e, d - 1, int(t[e, d])) for p, t in enumerate(totals)
                 for e in np.flatnonzero(t[:, 0]).tolist() for d in range(t.shape[1])]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types)],
                                         names=["part", "entry", "place", "total"])

    return run


def _final(books):
    def run(batches):
        for batch in batches:
            for p, able, ids, points, _ in _each_block(batch, books):
                flat = np.frombuffer(points, "<i4").reshape(-1, books[p].shape[1]).astype(np.int64)
                entry, error = _nearest(flat, books[p], able)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, "<i8")), pa.array(np.full(len(flat), p, np.int32)),
                     pa.array(entry.astype(np.int32)), pa.array(error)], names=["row", "part", "entry", "error"])

    return run


def vector_codes(vectors: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE, vec_id="vec_id",
                 embedding="embedding", label="label"):
    """(codes, codebooks): codes has vec_id, code, error, label_error; codebooks a matrix per part.

    Components become integers floor(scale * x) and a vector `parts` equal parts. Codebooks begin as the
    parts of the first `entries` vectors by vec_id and are refined `rounds` times, all in integers. `code`
    has two hex digits per part, `error` is the sum of squared distances, `label_error` their sum over
    equal labels, nulls together.

    Vectors that are null, or hold null or non-finite components, are left out. Shorter vectors count as
    ending in zeros, up to the longest one and a multiple of `parts`. A vector with an integer so large
    that squared distances could leave 64 bits has null code and error and shapes no codebook. Repeated
    rows are vectors of their own; null ids come last among the first vectors. An empty table gives no
    rows and empty codebooks. Other columns are not read.

    Each part's points are range-sorted along a Hilbert curve (ids break ties, so equal points are spread)
    and written once as blocks with box and sum. In a round a block whose box leaves one entry adds its
    sum; the others try the entries on their shortlist. The driver gets sums per entry, never points.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"),
                          F.col(label).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    limit = math.isqrt((2**63 - 1) // width) // 2
    padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
    able = F.forall("vector", lambda x: F.abs(x * scale) < limit - 1)
    whole = F.when(able, F.transform(padded, lambda x: F.floor(x * scale).cast("long")))
    kept = materialize(rows.select("vec_id", "label", whole.alias("v"), F.monotonically_increasing_id().alias("row")))
    coded = kept.where("v is not null")

    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = np.asarray([r.v for r in first], np.int64).reshape(-1, width)
    books = np.split(seeds, parts, axis=1)
    edges = coded.select("v").mapInArrow(_edges(width), "place int, low long, high long").groupBy("place").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for edge in edges:
        low[edge.place], high[edge.place] = edge.low, edge.high

    points = coded.select("row", "v").mapInArrow(_split(width, parts, low, high),
                                                 "part int, key long, row long, point binary")
    ordered = points.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    blocks = materialize(ordered.select("part", "row", "point").mapInArrow(_blocks(width // parts), BLOCKS))
    for _ in range(rounds if len(seeds) else 0):
        sums = blocks.mapInArrow(_round(books), "part int, entry int, place int, total long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        count = {(s.part, s.entry): s.total for s in sums if s.place < 0}
        books = [b.copy() for b in books]
        for s in sums:
            if s.place >= 0:
                books[s.part][s.entry, s.place] = s.total // count[s.part, s.entry]

    found = blocks.mapInArrow(_final(books), "row long, part int, entry int, error long")
    named = kept.select("row", "vec_id", "label", F.lit(None).cast("int").alias("part"),
                        F.lit(None).cast("int").alias("entry"), F.lit(None).cast("long").alias("error"))
    found = found.select("row", F.lit(None).cast(kept.schema["vec_id"].dataType).alias("vec_id"),
                         F.lit(None).cast(kept.schema["label"].dataType).alias("label"), "part", "entry", "error")
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    codes = materialize(named.unionByName(found).groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.concat(*digits).alias("code"),
        F.sum("error").alias("error")).drop("row"))
    release(kept)
    release(blocks)
    sums = codes.groupBy(F.col("label").alias("l_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("l_label")))
    return joined.select("vec_id", "code", "error", "label_error"), books


def _edges(width):
    def run(batches):
        low = high = None
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(-1, width)
            if len(values):
                a, b = values.min(0), values.max(0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)],
                names=["place", "low", "high"])

    return run


def books_digest(books) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()
