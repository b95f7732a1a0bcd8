"""Rounds of label propagation over links in blocks: a task holds a block's links as arrays, and blocks send each other the labels that have changed."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.session import Scratch

BLOCK = 1 << 17  # links of a block, but for those of a node of more
TASK = 8  # blocks that a task goes through, one after the other
STATE = "block int, kind int, a binary, b binary, c binary, open long"
LINKS = "nodes binary, degree binary, near binary, at binary, weight binary, node binary, target binary, name array<string>"


def blocks_of(links: DataFrame, names: DataFrame, number: int, scratch: Scratch) -> DataFrame:
    """One row for each block of links (src, dst, weight), which are ranges of ``dst``: its nodes, how many links end in each, the near nodes that they begin at, each link's place among
    these and its weight, the blocks that need a node's label, and the nodes' names (name, code)."""
    n = max(1, math.ceil(number / BLOCK))
    placed = scratch.keep(links.select("src", "dst", "weight").repartitionByRange(n, "dst").withColumn("block", F.spark_partition_id()))
    home = placed.groupBy("dst").agg(F.first("block").alias("block"))
    needed = placed.groupBy(F.col("block").alias("target"), F.col("src").alias("dst")).agg(F.lit(None).cast("string").alias("name"))
    onward = home.join(needed, "dst").select("block", F.col("dst").alias("id"), "target", "name")
    named = home.join(names.select(F.col("code").alias("dst"), F.col("name").cast("string").alias("name")), "dst").select("block", F.col("dst").alias("id"), F.lit(-1).alias("target"), "name")

    def pack(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        src, dst, weight = (rows[c].to_numpy(np.int64) for c in ("src", "dst", "weight"))
        order = np.argsort(dst, kind="stable")
        nodes, degree = np.unique(dst, return_counts=True)
        near, at = np.unique(src[order], return_inverse=True)
        own = ends["target"].to_numpy() < 0
        sent, told = ends[~own], ends[own].sort_values("id")
        if np.abs(weight).max() < 128:
            weight = weight.astype(np.int8)
        arrays = {"nodes": nodes, "degree": degree.astype(np.int32), "near": near, "at": at.astype(np.int32), "weight": weight[order], "node": np.searchsorted(nodes, sent["id"].to_numpy(np.int64)).astype(np.int32), "target": sent["target"].to_numpy(np.int32)}
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], **{k: [v.tobytes()] for k, v in arrays.items()}, "name": [told["name"].tolist()]})

    packed = scratch.keep(placed.groupBy("block").cogroup(onward.unionByName(named).groupBy("block")).applyInPandas(pack, f"block int, {LINKS}"))
    scratch.drop(placed)
    return packed


class Block:
    """A block's links, labels, and what is best for its nodes, after the messages it got."""

    def __init__(self, rows: pd.DataFrame):
        kind = rows["kind"].to_numpy()
        self.block = int(rows["block"].iloc[0])
        links = rows[kind == 0].iloc[0]
        read = lambda name, of: np.frombuffer(links[name], of)
        self.nodes, self.degree, self.near, self.at = read("nodes", np.int64), read("degree", np.int32), read("near", np.int64), read("at", np.int32)
        self.weight = read("weight", np.int8 if len(links["weight"]) == len(self.at) else np.int64).astype(np.int64)
        self.node, self.target, self.name = read("node", np.int32), read("target", np.int32), links["name"]
        held = rows[kind == 2]
        if len(held):
            self.label, self.best, self.around = (np.frombuffer(held[c].iloc[0], np.int64).copy() for c in "abc")
        else:
            self.label, self.best, self.around = self.nodes.copy(), None, self.near.copy()
        sent = rows[kind == 1]
        if len(sent):
            self.around[np.searchsorted(self.near, np.frombuffer(b"".join(sent["a"]), np.int64))] = np.frombuffer(b"".join(sent["b"]), np.int64)
            self.best = None

    def vote(self) -> None:
        """The label of the greatest summed weight of each node; of equal ones its own, else the least."""
        labels, place = np.unique(self.around, return_inverse=True)
        owner = np.repeat(np.arange(len(self.nodes), dtype=np.int64), self.degree)
        key = owner * len(labels) + place[self.at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(self.weight[order], starts)
        owner, label = np.divmod(key[starts], len(labels))
        label = labels[label]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        top = np.flatnonzero(total == np.maximum.reduceat(total, first)[owner])
        self.best = np.empty_like(self.nodes)
        self.best[owner[top[::-1]]] = label[top[::-1]]  # the least comes last
        own = top[label[top] == self.label[owner[top]]]
        self.best[owner[own]] = label[own]


def _round(prefix: str):
    """One round: nodes that would move and whose hash of ``prefix`` and name is even do so, and tell the blocks that need it."""
    start = zlib.crc32(prefix.encode())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = Block(rows)
        if b.best is None:
            b.vote()
        would = np.flatnonzero(b.best != b.label)
        now = would[[zlib.crc32(b.name[i].encode(), start) % 2 == 0 for i in would]] if len(would) else would
        b.label[now] = b.best[now]
        moved = np.zeros(len(b.nodes), bool)
        moved[now] = True
        go = moved[b.node]
        node, target = b.node[go], b.target[go]
        order = np.argsort(target, kind="stable")
        node, target = node[order], target[order]
        to, cuts = np.unique(target, return_index=True)
        parts = np.split(node, cuts[1:]) if len(to) else []
        own = {"block": [b.block], "kind": [2], "a": [b.label.tobytes()], "b": [b.best.tobytes()], "c": [b.around.tobytes()], "open": [len(would)]}
        sent = {"block": to, "kind": 1, "a": [b.nodes[p].tobytes() for p in parts], "b": [b.label[p].tobytes() for p in parts]}
        return pd.concat([pd.DataFrame(own), pd.DataFrame(sent)]) if parts else pd.DataFrame(own)

    return run


def _met(packed: DataFrame, state: DataFrame | None, n: int):
    """The blocks' links beside their state and messages, one group each, up to ``TASK`` groups to a task."""
    both = packed.withColumn("kind", F.lit(0))
    if state is not None:
        both = both.unionByName(state.select("block", "kind", "a", "b", "c"), allowMissingColumns=True)
    else:
        both = both.withColumns({c: F.lit(None).cast("binary") for c in "abc"})
    few = min(n, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(max(few, math.ceil(n / TASK)), "block").groupBy("block")


def _labels(rows: pd.DataFrame) -> pd.DataFrame:
    b = Block(rows)
    return pd.DataFrame({"id": b.nodes, "label": b.label})


def _between(rows: pd.DataFrame) -> pd.DataFrame:
    """The summed weight of a block's links between each two different labels."""
    b = Block(rows)
    labels, place = np.unique(np.r_[b.label, b.around], return_inverse=True)
    dst, src = np.repeat(place[: len(b.nodes)], b.degree), place[len(b.nodes) :][b.at]
    apart = src != dst
    key, at = np.unique(src[apart] * len(labels) + dst[apart], return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, b.weight[apart])
    return pd.DataFrame({"src": labels[key // len(labels)], "dst": labels[key % len(labels)], "weight": total})


def propagate(links: DataFrame, names: DataFrame, number: int, prefix: str, most_rounds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Labels (id, label) of the ends of ``number`` links (src, dst, weight), both ways, after rounds as in ``graphsearch.communities``, and the links (src, dst, weight) between labels, in parts that are still to be summed."""
    packed, state = blocks_of(links, names, number, scratch), None
    n = max(1, math.ceil(number / BLOCK))
    for at in range(most_rounds):
        seen = Observation()
        after = _met(packed, state, n).applyInPandas(_round(f"{prefix}:{at}:"), STATE)
        after = scratch.keep(after.observe(seen, F.coalesce(F.sum("open"), F.lit(0)).alias("open")))
        if state is not None:
            scratch.drop(state)
        state = after
        if not seen.get["open"]:
            break
    labels = scratch.keep(_met(packed, state, n).applyInPandas(_labels, "id long, label long"))
    return labels, _met(packed, state, n).applyInPandas(_between, "src long, dst long, weight long")
