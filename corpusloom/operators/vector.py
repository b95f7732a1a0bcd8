"""Exact and approximate vector search over arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 4096  # vectors of a side that meet in one task
FLOOR = 1e-10


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine", profile: str = "flat") -> Column:
    """Similarity as each store profile turns a distance into it."""
    l2 = squared_distance(a, b)
    forms = {
        ("cosine", "flat"): lambda: cosine(a, b),
        ("dot", "flat"): lambda: dot(a, b),
        ("euclidean", "flat"): lambda: 1 / (1 + l2),
        ("cosine", "half"): lambda: F.greatest(F.lit(0.0), 1 - (1 - cosine(a, b)) / 2),
        ("euclidean", "root"): lambda: 1 / (1 + F.sqrt(l2)),
        ("dot", "clipped"): lambda: F.greatest(F.lit(0.0), dot(a, b)),
        ("dot", "logistic"): lambda: 1 / (1 + F.exp(-dot(a, b))),
        ("manhattan", "flat"): lambda: 1 / (1 + manhattan(a, b)),
        ("cosine", "clipped"): lambda: F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(a, b))),
        ("euclidean", "exponential"): lambda: F.exp(-F.sqrt(l2)),
    }
    if (metric, profile) not in forms:
        raise ValueError(f"unknown similarity {metric}/{profile}")
    return forms[metric, profile]()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), FLOOR)


def similarities(q: np.ndarray, t: np.ndarray, metric: str, profile: str) -> np.ndarray:
    """The similarity of every row of ``q`` with every row of ``t``, as ``similarity`` gives it, by one matrix product."""
    if metric == "cosine":
        x = _unit(q) @ _unit(t).T
    elif metric == "dot":
        x = q @ t.T
    elif metric == "manhattan":
        x = np.stack([np.abs(t - row).sum(axis=1) for row in q]) if len(q) else np.empty((0, len(t)))
    else:
        x = np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (t * t).sum(axis=1)[None, :] - 2 * (q @ t.T))
    forms = {
        ("cosine", "flat"): lambda: x,
        ("dot", "flat"): lambda: x,
        ("euclidean", "flat"): lambda: 1 / (1 + x),
        ("cosine", "half"): lambda: np.maximum(0.0, 1 - (1 - x) / 2),
        ("euclidean", "root"): lambda: 1 / (1 + np.sqrt(x)),
        ("dot", "clipped"): lambda: np.maximum(0.0, x),
        ("dot", "logistic"): lambda: 1 / (1 + np.exp(-x)),
        ("manhattan", "flat"): lambda: 1 / (1 + x),
        ("cosine", "clipped"): lambda: np.clip(x, 0.0, 1.0),
        ("euclidean", "exponential"): lambda: np.exp(-np.sqrt(x)),
    }
    if (metric, profile) not in forms:
        raise ValueError(f"unknown similarity {metric}/{profile}")
    return forms[metric, profile]()


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of a row; ties go to the smaller id."""
    if len(sim) > k:
        at = np.flatnonzero(sim >= np.partition(sim, len(sim) - k)[len(sim) - k])
    else:
        at = np.arange(len(sim))
    at = at[np.isfinite(sim[at])]
    return at[np.lexsort((ids[at], -sim[at]))][:k]


def _cells(table: DataFrame, queries: DataFrame, keys: tuple[str, ...], k: int, metric: str, profile: str, exclude_self: bool) -> DataFrame:
    """(qid, id, similarity): per cell of ``keys``, the ``k`` best rows for each query of that cell."""
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", table.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"qid": asked["qid"][:0], "id": rows["id"][:0], "similarity": np.empty(0)})
        t, ids, qids = _matrix(rows["vector"]), rows["id"].to_numpy(), asked["qid"].to_numpy()
        out = []
        for at in range(0, len(asked), 512):
            sim = similarities(_matrix(asked["query_vector"].iloc[at : at + 512]), t, metric, profile)
            for row, qid in zip(sim, qids[at : at + 512], strict=True):
                if exclude_self:
                    row[ids == qid] = -np.inf
                best = _best(row, ids, k)
                out.append((np.full(len(best), qid), ids[best], row[best]))
        return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("qid", "id", "similarity"))})

    return table.select(*keys, "id", "vector").groupBy(*keys).cogroup(queries.select(*keys, "qid", "query_vector").groupBy(*keys)).applyInPandas(meet, schema)


def first_k(hits: DataFrame, k: int) -> DataFrame:
    """Hits with their 1-based rank by similarity, then id, up to ``k`` for each query."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _blocks(rows: int, spread: int = 1) -> int:
    return max(1, min(spread, math.ceil(rows / 256)), math.ceil(rows / ROWS))


def topk(table: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", profile: str = "flat", exclude_self: bool = False) -> DataFrame:
    """(qid, id, similarity, rank) of the ``k`` most similar rows (id, vector) for each query (qid, query_vector).

    Both sides are dealt to blocks of at most about ``ROWS`` vectors by hash, and each pair of blocks is one cell: a
    matrix product in one task, of which only ``k`` rows per query go on. Nothing is broadcast.
    """
    spread = table.sparkSession.sparkContext.defaultParallelism
    across, down = _blocks(table.count(), spread), _blocks(queries.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    t = table.select("id", "vector", own("id", across).alias("tb")).withColumn("qb", every(down))
    q = queries.select("qid", "query_vector", own("qid", down).alias("qb")).withColumn("tb", every(across))
    return first_k(_cells(t, q, ("tb", "qb"), k, metric, profile, exclude_self), k)


def with_threshold(hits: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Hits of at least ``threshold``; a query without any has one row with null id and similarity."""
    kept = hits.where(F.col("similarity") >= threshold).withColumnRenamed("qid", "hit_qid")
    return queries.select("qid").join(kept, F.col("qid") == F.col("hit_qid"), "left").drop("hit_qid")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` replace those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """Without the rows of ``ids`` and those that match ``where``; one of both has to be given."""
    if ids is None and where is None:
        raise ValueError("give ids or a condition")
    if ids is not None:
        table = table.join(ids.select(key), key, "left_anti")
    return table if where is None else table.where(~F.coalesce(where, F.lit(False)))


def status(table: DataFrame) -> DataFrame:
    return table.agg(F.max(F.size("vector")).cast("long").alias("vector_dim"), F.count(F.lit(1)).alias("vector_count"))


def semantic_duplicates(table: DataFrame, threshold: float) -> DataFrame:
    """(id, target_id, similarity): each item with an earlier item of cosine above ``threshold``, and the most
    similar of those (ties: lowest id).

    An exact similarity join by blocks: each pair of blocks is one cell and one matrix product of unit vectors;
    only the best earlier item of each row leaves it.
    """
    blocks = max(4, _blocks(table.count()))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = table.select("id", "vector", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "vector", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m, blocks_of = rows["id"].to_numpy(), _unit(_matrix(rows["vector"])), rows["own"].to_numpy()
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        pairs = [(low, high), (high, low)] if low != high else [(low, high)]
        out: dict[str, list] = {"id": [], "similarity": [], "neg": []}
        for a, b in pairs:  # items of block a against earlier ones of block b
            x, y = np.flatnonzero(blocks_of == a), np.flatnonzero(blocks_of == b)
            y = y[np.argsort(ids[y], kind="stable")]
            for at in range(0, len(x) if len(y) else 0, 1024):
                part = x[at : at + 1024]
                sim = np.where(ids[y][None, :] < ids[part][:, None], m[part] @ m[y].T, -2.0)
                best = sim.argmax(axis=1)  # the first of equals, so the lowest id
                value = sim[np.arange(len(part)), best]
                ok = value > threshold
                out["id"] += ids[part][ok].tolist()
                out["similarity"] += value[ok].tolist()
                out["neg"] += (-ids[y][best[ok]]).tolist()
        return pd.DataFrame(out)

    found = dealt.groupBy("low", "high").applyInPandas(meet, "id long, similarity double, neg long")
    best = found.groupBy("id").agg(F.max(F.struct("similarity", "neg")).alias("m"))
    return best.select("id", (-F.col("m.neg")).alias("target_id"), F.col("m.similarity").alias("similarity"))


def similar_pairs(table: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of cosine at least ``threshold``, by cells as in ``semantic_duplicates``."""
    blocks = max(4, _blocks(table.count()))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = table.select("id", "vector", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "vector", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m, of = rows["id"].to_numpy(), _unit(_matrix(rows["vector"])), rows["own"].to_numpy()
        x, y = np.flatnonzero(of == rows["low"].iloc[0]), np.flatnonzero(of == rows["high"].iloc[0])
        out: list[tuple] = []
        for at in range(0, len(x) if len(y) else 0, 1024):
            part = x[at : at + 1024]
            sim = m[part] @ m[y].T
            i, j = np.nonzero(sim >= threshold)
            a, b = ids[part][i], ids[y][j]
            keep = a < b if rows["low"].iloc[0] == rows["high"].iloc[0] else np.ones(len(a), dtype=bool)
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], sim[i, j][keep]))
        return pd.DataFrame({name: np.concatenate([o[k] for o in out]) if out else [] for k, name in enumerate(("a", "b", "similarity"))})

    return dealt.groupBy("low", "high").applyInPandas(meet, "a long, b long, similarity double")


def add(table: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` appended; a vector of another length fails the job."""
    checked = rows.where(F.coalesce(F.assert_true(F.size("vector") == dim, F.lit(f"a vector is not of length {dim}")).isNull(), F.lit(True)))
    return table.unionByName(checked, allowMissingColumns=True)


def update_payload(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Payload maps with the entries of ``changes`` (id, payload) put over theirs, key by key."""
    new = changes.select("id", F.col("payload").alias("_new"))
    both = table.join(new, "id", "left")
    kept = F.map_filter(F.coalesce("payload", F.expr("map()").cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    return both.withColumn("payload", F.when(F.col("_new").isNull(), F.col("payload")).otherwise(F.map_concat(kept, "_new"))).drop("_new")


def unknown_ids(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of ``changes`` that the table lacks; an update of these is an error to its caller."""
    return changes.select("id").join(table.select("id"), "id", "left_anti")


def payload_matches(payload: Column, wanted: dict[str, str]) -> Column:
    """Whether all wanted keys are there and equal."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(payload[key] == value, F.lit(False))
    return out


def filtered_topk(table: DataFrame, queries: DataFrame, k: int, wanted: dict[str, str], post: bool = False, fetch_factor: int = 2, **how) -> DataFrame:
    """``topk`` among rows whose payload matches; ``post`` filters ``k * fetch_factor`` hits instead, and so may give fewer."""
    if not post:
        return topk(table.where(payload_matches(F.col("payload"), wanted)), queries, k, **how)
    hits = topk(table, queries, k * fetch_factor, **how).drop("rank").join(table.where(payload_matches(F.col("payload"), wanted)).select("id"), "id", "left_semi")
    return first_k(hits, k)


def payloads(table: DataFrame, queries: DataFrame, k: int, **how) -> DataFrame:
    """(qid, id, rank, payload) of the ``k`` most similar rows, without those that have no payload."""
    return topk(table, queries, k, **how).join(table.select("id", "payload"), "id").where("payload IS NOT NULL").select("qid", "id", "rank", "payload")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _letters(texts: pd.Series) -> pd.Series:
    return pd.Series([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[97:123].astype(np.float64) for t in texts.fillna("")])


def letter_embedding(text: Column) -> Column:
    """A stand-in for an encoder, without a model: how often each letter occurs, as a vector; without a text, a vector of nulls. One pass over the text."""
    return F.when(text.isNotNull(), _letters(F.lower(text))).otherwise(F.array_repeat(F.lit(None).cast("double"), len(LETTERS)))


class InvertedLists:
    """An approximate index: rows are listed by their nearest centroid, queries look into the nearest lists.

    Centroids are fitted on at most ``sample`` rows, chosen by hash; every row is listed. Lists above ``ROWS`` are
    split by hash, so that a hot list isn't one task's. ``probes`` lists are searched for each query.
    """

    def __init__(self, table: DataFrame, lists: int = 100, sample: int = 20_000, seed: int = 5):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = table.count()
        share = min(1.0, sample / max(1, rows))
        spread = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        fitted = table.where(spread < share).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        self.centroids = _unit(np.array(KMeans(k=max(1, min(lists, rows)), seed=seed, maxIter=10).fit(fitted).clusterCenters()))
        self.splits = max(1, math.ceil(rows / len(self.centroids) / ROWS))
        self.table = table.select("id", "vector", self._nearest("vector", 1)[0].alias("list"), F.pmod(F.xxhash64("id"), F.lit(self.splits)).cast("int").alias("split"))

    def _nearest(self, column: str, n: int) -> Column:
        centroids = self.centroids  # at most ``lists`` rows

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def lists(vectors: pd.Series) -> pd.Series:
            near = np.argsort(-(_unit(_matrix(vectors)) @ centroids.T), axis=1, kind="stable")[:, :n] if len(vectors) else []
            return pd.Series(list(near))

        return lists(F.col(column))

    def topk(self, queries: DataFrame, k: int, probes: int = 10) -> DataFrame:
        asked = queries.select("qid", "query_vector", F.explode(self._nearest("query_vector", min(probes, len(self.centroids)))).alias("list"))
        asked = asked.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(self.splits - 1))))
        return first_k(_cells(self.table, asked, ("list", "split"), k, "cosine", "flat", False), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (qid, id) that were found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id"), ["qid", "id"], "left_semi").count()
    return hit / max(1, exact.count())
