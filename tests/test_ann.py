"""Approximate indexes: recall against the exact search, and how much of the table they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ann, vector
from corpusloom.plans import search
from tests.conftest import DATA


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_product_codes(spark, sf):
    t, q = search._vectors(spark, f"{DATA}/{sf}")
    index = ann.QuantizedLists(t)
    rows = t.count()
    assert index.codes.count() == rows and len(index.centroids) == int(np.ceil(np.sqrt(rows)))
    assert vector.recall(index.topk(q, 10), vector.topk(t, q, 10)) >= 0.9
    read = index.candidates(q, min(320, rows // 10), 0.75)
    assert read.groupBy("qid").count().agg(F.max("count")).first()[0] <= rows / 10


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbor_graph(spark, sf):
    t, q = search._vectors(spark, f"{DATA}/{sf}")
    index = ann.NeighborGraph(t)
    assert index.links.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * index.degree
    found, rounds, read = index.topk(q, 10)
    share = read / q.count() / index.rows
    assert vector.recall(found, vector.topk(t, q, 10)) >= 0.9 and rounds < 20 and share < 1, (rounds, share)


def test_clustered_rows_read_less(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(60, 16))
    rows = [(i, (middles[i % 60] + rng.normal(scale=0.2, size=16)).tolist()) for i in range(3000)]
    t = spark.createDataFrame(rows, "id long, vector array<double>")
    q = t.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))
    exact = vector.topk(t, q, 10)
    assert vector.recall(ann.QuantizedLists(t).topk(q, 10, probes=0.1), exact) >= 0.9
    found, _, read = ann.NeighborGraph(t).topk(q, 10, entries=256)
    assert vector.recall(found, exact) >= 0.9 and read / q.count() < 0.3 * 3000


def test_product_codes_in_bounded_parts(spark, monkeypatch):
    t, q = search._vectors(spark, f"{DATA}/sf0.01")
    t = t.unionByName(t.where("id < 60").select((F.col("id") * 0 + 1000 + F.monotonically_increasing_id() % 1000).alias("id"), F.lit([1.0] * 64).alias("vector")))  # a hot list
    want = sorted(map(tuple, ann.QuantizedLists(t).topk(q, 10).select("qid", "id", "rank").collect()))
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "SLICE", 50)
    index = ann.QuantizedLists(t)
    assert index.codes.groupBy("list", "split").count().agg(F.max("count")).first()[0] <= 80 and max(index.splits) >= 2
    assert sorted(map(tuple, index.topk(q, 10).select("qid", "id", "rank").collect())) == want


def test_kmeans_fills_empty_clusters():
    x = np.array([[0.0, 0.0]] * 10 + [[5.0, 5.0]])
    assert {tuple(r) for r in ann.kmeans(x, 2, 1)} == {(0.0, 0.0), (5.0, 5.0)}


def test_local_joins_give_each_pair_once():
    ids, x = np.arange(5), vector._unit(np.random.default_rng(2).normal(size=(5, 3)))
    own, other, value = ann._nearest(ids, x, 9, 0)
    assert len(own) == 20 and (own != other).all() and np.allclose(value, (x[own] * x[other]).sum(axis=1))


def test_local_joins_keep_the_best(spark):
    rng = np.random.default_rng(3)
    t = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(150)], "id long, vector array<double>")
    index = ann.NeighborGraph(t, degree=4, rounds=1)
    rows = index._local_joins().collect()
    x = {r.id: np.array(r.vector) / np.linalg.norm(r.vector) for r in t.collect()}
    assert len({(r.id, r.other) for r in rows}) == len(rows) > 300 and all(r.id != r.other and abs(x[r.id] @ x[r.other] - r.similarity) < 1e-9 for r in rows)
    assert max(sum(r.id == i for r in rows) for i in range(150)) <= 4


def test_neighbor_graph_in_bounded_cells(spark, monkeypatch):
    """Cells of hyperplanes, one of them hot with equal rows; rounds hand over only what a row would keep; vectors of floats as bytes."""
    monkeypatch.setattr(ann, "CELL", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, vector array<float>")
    index = ann.NeighborGraph(t, degree=6, rounds=2)
    sizes = [r["count"] for r in index.table.groupBy("lot").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4 * 40 and sum(sizes) == 700
    least = {r.id: r.least for r in index.edges.groupBy("id").agg(F.min("similarity").alias("least")).collect()}
    every, better = index._local_joins().count(), index._local_joins(better=True).collect()
    assert len(better) < every / 4 and all(r.similarity > least[r.id] for r in better)
    q = t.where("id < 400 and id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))
    found, _, _ = index.topk(q, 10)
    assert vector.recall(found, vector.topk(t, q, 10)) >= 0.9
    x = {r.id: np.array(r.vector) / np.linalg.norm(r.vector) for r in t.collect()}
    assert all(abs(x[r.qid] @ x[r.id] - r.similarity) < 1e-9 for r in found.collect())
