"""Exact Lloyd clustering of integer vectors with two trees.

Every block of vectors gets a cover tree once: the children of a node are centres more than half its radius apart that cover
its points within that, so equal vectors are one leaf. Each round builds such a tree over the centroids on the driver, where
they are few, and walks both trees together in every block: a pair of nodes goes if even its nearest points are farther
apart than the farthest ones of another pair of the same vectors. What is left at the leaves is compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import Scratch

BLOCK = 4096  # vectors of a tree
PAIRS = 1 << 15  # pairs of nodes in memory at once
LARGEST = 1 << 27  # so that squared distances of 64 components fit 64 bits
SLACK = 1e-6  # relative; over the rounding of the bounds, so that ties are never pruned


@dataclass(frozen=True)
class LloydConfig:
    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    scale: int = 256  # components become floor(scale * x)
    seed: int = 2


@dataclass(frozen=True)
class CoverTree:
    """Nodes in breadth-first order; node i covers the points ``order[low[i] : high[i]]``, and its children are
    ``first[i]`` to ``first[i] + children[i]``. A leaf's points are all equal to its centre."""

    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray
    order: np.ndarray

    def pack(self) -> bytes:
        return np.stack([self.center, self.first, self.children, self.low, self.high]).astype(np.int32).tobytes() + self.radius.astype(np.float64).tobytes() + self.order.astype(np.int32).tobytes()

    @staticmethod
    def unpack(data: bytes, n_points: int) -> CoverTree:
        nodes = (len(data) - 4 * n_points) // 28
        five = np.frombuffer(data, np.int32, 5 * nodes).reshape(5, nodes)
        return CoverTree(five[0], np.frombuffer(data, np.float64, nodes, 20 * nodes), *five[1:], np.frombuffer(data, np.int32, n_points, 28 * nodes))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def cover_tree(x: np.ndarray) -> CoverTree:
    """The cover tree of the rows of ``x`` (int64), by farthest-first choice of centres at half the radius of each node."""
    n = len(x)
    order = np.arange(n)
    center, radius, first, children, low, high = [0], [0.0], [0], [0], [0], [n]
    queue = [(0, _squared(x, x[:1]) if n else np.zeros(0, np.int64))]
    for node, far in queue:  # grows while it is read
        a, b = low[node], high[node]
        most = int(far.max()) if len(far) else 0
        radius[node] = float(np.sqrt(most))
        if most == 0:
            continue
        members = order[a:b]
        held = x[members]
        near, owner, centers = far.copy(), np.zeros(b - a, dtype=np.int64), [center[node]]
        while 4 * int(near[at := int(near.argmax())]) > most:  # farther than half the radius from all centres
            d = _squared(held, held[at : at + 1])
            closer = d < near
            near[closer] = d[closer]
            owner[closer] = len(centers)
            centers.append(int(members[at]))
        by = np.argsort(owner, kind="stable")
        order[a:b] = members[by]
        near, sizes = near[by], np.bincount(owner, minlength=len(centers))
        first[node], children[node] = len(center), len(centers)
        ends = np.cumsum(sizes)
        for c, end, size in zip(centers, ends, sizes, strict=True):
            queue.append((len(center), near[end - size : end]))
            for column, value in ((center, c), (radius, 0.0), (first, 0), (children, 0), (low, a + int(end - size)), (high, a + int(end))):
                column.append(value)
    return CoverTree(np.array(center), np.array(radius), *[np.array(v, dtype=np.int64) for v in (first, children, low, high)], order)


def _least_of_leaves(tree: CoverTree) -> np.ndarray:
    """Of each leaf the smallest of its points; 0 for other nodes."""
    leaves = np.flatnonzero(tree.children == 0)
    leaves = leaves[np.argsort(tree.low[leaves])]  # they divide the points
    out = np.zeros(len(tree.center), np.int64)
    out[leaves] = np.minimum.reduceat(tree.order, tree.low[leaves])
    return out


def _expanded(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, node): the children of each node, or itself if it is a leaf."""
    n = np.maximum(tree.children[nodes], 1)
    of = np.repeat(np.arange(len(nodes)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, np.where(tree.children[nodes[of]] > 0, tree.first[nodes[of]] + within, nodes[of])


def nearest(x: np.ndarray, tree: CoverTree, c: np.ndarray, ctree: CoverTree, at_once: int = PAIRS) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest row of ``c`` to each row of ``x`` (ties: the smaller number), its squared distance, and the number of
    distances computed."""
    cluster, distance, work = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    smallest = _least_of_leaves(ctree)  # equal centroids share a leaf
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(x) else []
    while stack:
        v, k = stack.pop()  # pairs of nodes, those of one vector node side by side
        work += len(v)
        d2 = _squared(x[tree.center[v]], c[ctree.center[k]])
        d = np.sqrt(d2.astype(np.float64))
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        size = np.diff(np.append(start, len(v)))
        most = np.minimum.reduceat(d + ctree.radius[k], start) + tree.radius[v[start]]
        keep = d - ctree.radius[k] - tree.radius[v] <= np.repeat(most, size) * (1 + SLACK) + SLACK
        v, k, d2 = v[keep], k[keep], d2[keep]
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        size = np.diff(np.append(start, len(v)))
        wide = np.maximum.reduceat(np.where(ctree.children[k] > 0, ctree.radius[k], -1.0), start)  # -1: centroid leaves only
        node = v[start]
        leaf = tree.children[node] == 0
        over = np.repeat(leaf & (wide < 0), size)
        if over.any():
            dv, dk, dd = v[over], k[over], d2[over]
            by = np.lexsort((smallest[dk], dd, dv))
            lead = by[np.flatnonzero(np.append(True, dv[by][1:] != dv[by][:-1]))]
            n = tree.high[dv[lead]] - tree.low[dv[lead]]
            at = np.repeat(tree.low[dv[lead]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cluster[tree.order[at]] = np.repeat(smallest[dk[lead]], n)
            distance[tree.order[at]] = np.repeat(dd[lead], n)
        split = ~leaf & (tree.radius[node] >= wide)
        for side, chosen in ((0, np.repeat(split, size)), (1, ~np.repeat(split, size) & ~over)):
            if not chosen.any():
                continue
            cv, ck = v[chosen], k[chosen]
            n = np.maximum((tree if side == 0 else ctree).children[cv if side == 0 else ck], 1)
            edge = np.flatnonzero(np.append(True, cv[1:] != cv[:-1]))
            group = np.cumsum(np.add.reduceat(n, edge)) // at_once  # vector nodes are dealt to pieces of about ``at_once`` pairs
            cuts = edge[np.flatnonzero(np.append(True, group[1:] != group[:-1]))]
            for low, high in zip(cuts, [*cuts[1:], len(cv)], strict=True):
                of, grown = _expanded(tree, cv[low:high]) if side == 0 else _expanded(ctree, ck[low:high])
                pv, pk = (grown, ck[low:high][of]) if side == 0 else (cv[low:high][of], grown)
                by = np.argsort(pv, kind="stable")
                stack.append((pv[by], pk[by]))
    return cluster, distance, work


def integer_vectors(vectors: DataFrame, config: LloydConfig = LloydConfig()) -> DataFrame:
    """(vec_id, x array<long>): vectors of exactly ``dimensions`` finite components, as floor(scale * component)."""
    whole = (F.size("embedding") == config.dimensions) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.coalesce(whole, F.lit(False)))
    return kept.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * config.scale).cast("long")).alias("x"))


def first_centroids(kept: DataFrame, config: LloydConfig) -> np.ndarray:
    """The ``clusters`` vectors of smallest seeded hash of their id; ties and null ids (last) in the order of their components."""
    seeded = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(seeded.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(config.clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(-1, config.dimensions)


def _blocks(kept: DataFrame, config: LloydConfig) -> DataFrame:
    """(ids, x, tree): blocks of up to ``BLOCK`` vectors of a partition with their cover trees, in binary but for the ids."""
    id_type = kept.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("x", T.BinaryType()), T.StructField("tree", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = rows.column(1).chunk(0).flatten().to_numpy().reshape(-1, config.dimensions)
            if np.abs(x).max() > LARGEST:
                raise ValueError(f"a component of more than {LARGEST // config.scale} in size: squared distances would not fit 64 bits")
            ids = rows.column(0).chunk(0)
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([one, pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([cover_tree(x).pack()], pa.binary())], names=["ids", "x", "tree"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == BLOCK:
                    yield flush()
        if held:
            yield flush()

    return kept.mapInArrow(run, schema)


def _assigned(blocks: pa.RecordBatch, c: np.ndarray, ctree: CoverTree) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(blocks.num_rows):
        x = np.frombuffer(blocks.column(1)[i].as_py(), np.int32).reshape(-1, c.shape[1]).astype(np.int64)
        yield blocks.column(0)[i].values, x, *nearest(x, CoverTree.unpack(blocks.column(2)[i].as_py(), len(x)), c, ctree)[:2]


def _round(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """New centroids: the componentwise floor of the mean of each one's vectors; those without vectors stay. A task passes on one sum of each
    cluster and component."""
    shared = blocks.sparkSession.sparkContext.broadcast((c, cover_tree(c)))  # clusters x dimensions numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ctree = shared.value
        total, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, c, ctree):
                np.add.at(total, cluster, x)
                n += np.bincount(cluster, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    sums = blocks.mapInArrow(run, "cluster int, n long, total array<long>")
    sums = sums.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = c.copy()
    for r in sums.collect():  # clusters x dimensions rows
        out[r["cluster"], r["at"]] = r["total"] // r["n"]
    shared.unpersist()
    return out


def lloyd(vectors: DataFrame, config: LloydConfig = LloydConfig()) -> DataFrame:
    """Per kept vector: vec_id, cluster int, distance long (squared, to its centroid), cluster_inertia and inertia long, n_cluster long,
    centroid array<long> and centroid_sha256 string.

    Vectors that are null, of another length, or with null or non-finite components are left out; repeated rows count each. Ties go to
    the smaller cluster. With fewer vectors than ``clusters`` each starts one cluster; an empty table gives no rows. Further
    columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kept = integer_vectors(vectors, config)
    c = first_centroids(kept, config)
    blocks = scratch.keep(_blocks(kept, config))
    for _ in range(config.rounds if len(c) else 0):
        c = _round(blocks, c)
    shared = spark.sparkContext.broadcast((c, cover_tree(c)))
    id_type = vectors.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance in _assigned(batch, *shared.value):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", id_type), *T.StructType.fromDDL("cluster int, distance long").fields])
    placed = scratch.keep(blocks.mapInArrow(run, schema))
    sums = {r["cluster"]: (r["inertia"], r["n"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia"), F.count(F.lit(1)).alias("n")).collect()}
    hashes = [hashlib.sha256(",".join(str(v) for v in row).encode()).hexdigest() for row in c.tolist()]
    rows = [(k, own, sum(v[0] for v in sums.values()), n, c[k].tolist(), hashes[k]) for k, (own, n) in sums.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, n_cluster long, centroid array<long>, centroid_sha256 string")
    return placed.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "n_cluster", "centroid", "centroid_sha256")
