"""Near duplicates among embeddings: int8 tile products with error bounds, then full precision."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialize

COSINE = 0.95
TILE = 8192  # vectors of one side of a tile product
STRIP = 1024  # rows of a tile that are multiplied at a time
RECHECK = 65_536  # pairs recomputed in full precision at a time


def _unit(flat, dims):
    x = flat.reshape(-1, dims)
    # scaled first: squares of very large or very small components would leave the range of doubles
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _quantised(x):
    """int8 vectors, their scales and rigorous bounds of the norm of what rounding left out."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12
    return q, scale, error


def _join(labels, a, b):
    """Merge the groups that the links a-b connect; labels point to the smallest of a group."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _links(x, y, cosine, same):
    """Pairs (i, j) with cosine at or above the threshold, in strips; i < j if both sides are the same.

    With x = s q + e the product of two unit vectors differs from that of their int8 parts by at most
    |e_x| (1 + |e_y|) + |e_y|, plus the rounding of single-precision sums. Pairs surely above the
    threshold are links, those surely below are not, and only those between are computed in doubles.
    """
    qx, sx, ex = _quantised(x)
    qy, sy, ey = (qx, sx, ex) if same else _quantised(y)
    slack = (x.shape[1] + 8) * 2.0**-23
    right = np.ascontiguousarray((qy * sy[:, None]).astype(np.float32).T)
    for at in range(0, len(x), STRIP):
        rows = slice(at, at + STRIP)
        left = (qx[rows] * sx[rows, None]).astype(np.float32)
        product = left @ (right[:, at:] if same else right)
        shift = at if same else 0
        most = ex[rows] * (1 + ey.max()) + ey.max() + slack
        i, j = np.nonzero(product >= (cosine - most)[:, None].astype(np.float32) - np.float32(1e-6))
        value = product[i, j].astype(np.float64)
        i, j = i + at, j + shift
        if same:
            ahead = i < j
            i, j, value = i[ahead], j[ahead], value[ahead]
        bound = ex[i] * (1 + ey[j]) + ey[j] + slack
        sure, open_ = value - bound >= cosine, np.flatnonzero(
            (value - bound < cosine) & (value + bound >= cosine))
        for part in range(0, len(open_), RECHECK):
            k = open_[part : part + RECHECK]
            sure[k] = np.einsum("nd,nd->n", x[i[k]], y[j[k]]) >= cosine
        yield i[sure], j[sure]


def _tile(cosine):
    def links(table):
        own = table["own"].combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(own, kind="stable")
        table = table.take(pa.array(order))
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        vectors = table["vector"].combine_chunks()
        dims = len(vectors.flatten()) // max(1, len(ids))
        unit = _unit(vectors.flatten().to_numpy().astype(np.float64), dims)
        cut = int(np.searchsorted(own[order], own.max())) if own.min() != own.max() else 0
        same = bool(table["diagonal"][0].as_py())
        found, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if same or cut:
            left = unit if same else unit[:cut]
            right = unit if same else unit[cut:]
            for i, j in _links(left, right, cosine, same):
                j = j if same else j + cut
                found += np.bincount(i, copies[j], len(ids)).astype(np.int64)
                found += np.bincount(j, copies[i], len(ids)).astype(np.int64)
                _join(labels, i, j)
        some = np.flatnonzero(found)
        return pa.table({"id": ids[some], "links": found[some], "root": ids[labels[some]]})

    return links


def vector_links(vectors: DataFrame, cosine=COSINE, tile=TILE) -> DataFrame:
    """(id, links, root) of every distinct vector and tile in which it has links.

    `vectors` has distinct (id, vector, copies). Vectors are dealt to slabs of about `tile` rows per
    dimension, every two slabs (and each with itself) are one tile, and a task multiplies one tile.
    A tile returns counts and a spanning link per vector, never its pairs. Work grows with the square
    of the number of distinct vectors, as comparing all does; it is that of dense products on int8.
    """
    sized = vectors.withColumn("dims", F.size("vector"))
    total = sized.groupBy("dims").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("slabs"))
    dealt = sized.join(total, "dims").withColumn("own", F.pmod(F.xxhash64("id"), "slabs").cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))).select(
        "dims", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"),
        "own", (F.col("own") == F.col("other")).alias("diagonal"), "id", "vector", "copies")
    return tiles.groupBy("dims", "row", "col").applyInArrow(_tile(cosine), "id long, links long, root long")


def embedding_groups(embeddings: DataFrame, cosine=COSINE, vec_id="vec_id", embedding="embedding",
                     tile=TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors whose cosine, in doubles, is at least `cosine`; component_id is
    the smallest vec_id reachable by links, itself included; kept marks it. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and so do vectors of
    different length. Equal vectors are compared once and counted as often as they occur. Null ids
    sort last and a group of them alone has component null. Repeated rows are vectors of their own;
    all rows of a kept id are kept. An empty table gives no rows. Other columns are not read.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"),
                             F.col(embedding).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = (F.coalesce(F.size("vector"), F.lit(0)) > 0) & F.forall("vector", finite) & F.exists(
        "vector", lambda x: x != 0.0)
    key = F.when(sound, F.concat(*[F.hex(F.xxhash64(F.lit(s), "vector")) for s in (1, 2)]))
    keyed = rows.select("vec_id", key.alias("key"), "vector")
    distinct = keyed.where("key is not null").groupBy("key").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = materialize(distinct.withColumn("id", F.monotonically_increasing_id()))
    found = materialize(vector_links(classes.select("id", "vector", "copies"), cosine, tile))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("key", "id", "copies", "least").join(counts, "id", "left").join(
        roots, F.col("id") == F.col("node"), "left")
    known = materialize(known.select(
        "key", "least", F.coalesce("root", "id").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    named = materialize(known.join(smallest, "root").select("key", "n_links", "component"))
    out = keyed.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
