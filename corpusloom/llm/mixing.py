"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get word targets; targets become whole blocks by highest quotients; a source's blocks are
apportioned to its shards the same way. A shard is a seeded sequence of documents cut into blocks of
equal length; of its blocks, the quota is taken at evenly spaced places from a seeded start, and a
quota above the number of blocks takes all of them once before that.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 16
SHARD_WORDS = 4_000_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the earlier party.

    Rounding votes / (total / seats) is the allocation for some number of seats; the difference is
    made up one quotient at a time, so the time doesn't follow the number of seats.
    """
    votes = np.asarray(votes, dtype=float)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    got = np.floor(votes * seats / total + 0.5).astype(np.int64)
    missing = int(seats - got.sum())
    if missing > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes.tolist(), got.tolist(), strict=True))]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * int(got[i]) + 1), i))
    elif missing < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes.tolist(), got.tolist(), strict=True)) if g]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * int(got[-i]) - 1), i))
    return got


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Targets in proportion to weights, none above ``cap`` times its size, with the excess shared by weight."""
    limit = cap * sizes.astype(float)
    target = np.zeros(len(sizes))
    order = np.argsort(limit / weights, kind="stable")
    left, weight = float(total), float(weights.sum())
    for at, i in enumerate(order):
        if left * weights[i] / weight < limit[i]:
            rest = order[at:]
            target[rest] = left * weights[rest] / weight
            return target
        target[i] = limit[i]
        left -= limit[i]
        weight -= weights[i]
    return target


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and taken, in words.

    ``size``: words of the text (null: 0). Sources by code point, null last, weigh ``weights``,
    repeating; together they share ``share`` of all sizes; no target is above ``cap`` times its
    source's size. ``taken``: words that the mix takes of the row, repeats counted, at most ``cap``
    times its size, the same in every run. Rows without words take none; equal rows are mixed each
    on its own; an empty table gives no rows. Further columns are ignored.

    The table of sources has one row per source and is planned in one task; all else is by shard.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = Scratch(docs.sparkSession).keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order")))  # words are counted once
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(missing=rows["source"].isna()).sort_values(["missing", "source"], kind="stable")
        sizes = rows["source_size"].to_numpy(dtype=np.int64)
        w = np.array([weights[i % len(weights)] for i in range(len(rows))])
        rows["target"] = water_fill(sizes, w, share * float(sizes.sum()), cap)
        rows["blocks"] = sainte_lague(rows["target"].to_numpy(), round(rows["target"].sum() / block_words))
        rows["shards"] = [max(1, math.ceil(s / shard_words)) for s in sizes]
        return rows[["source", "source_size", "target", "blocks", "shards"]]

    planned = sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(plan, f"source {dict(docs.dtypes)['source']}, source_size long, target double, blocks long, shards long")
    spread = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    placed = sized.join(planned.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source").withColumn("shard", spread % F.col("shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", kind="stable")
        rows["quota"] = sainte_lague(rows["words"].to_numpy(), int(rows["blocks"].iloc[0]))
        return rows[["source", "shard", "words", "quota"]]

    allotted = shards.groupBy("source").applyInPandas(quotas, f"source {dict(docs.dtypes)['source']}, shard long, words long, quota long")
    n = F.greatest(F.ceil(F.col("words") / block_words), F.lit(1)).cast("long")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    allotted = allotted.select(F.col("source").alias("its_source"), F.col("shard").alias("its_shard"), n.alias("n"), F.least("quota", n * cap).alias("quota"), (start % n).alias("start"))
    both = placed.join(allotted, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("shard") == F.col("its_shard"))).drop("its_source", "its_shard")
    within = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("upto", F.sum("size").over(within))

    def chosen(words: str) -> str:
        """Words of the chosen blocks among the first ``words`` of the shard; r of its n blocks are chosen."""
        j, r = f"({words} div {block_words})", "(quota % n)"
        before = f"((({j} + start) * {r}) div n)"
        return f"({block_words} * ({before} - ((start * {r}) div n)) + ({words} % {block_words}) * (((({j} + 1 + start) * {r}) div n) - {before}))"

    taken = F.expr(f"(quota div n) * size + {chosen('upto')} - {chosen('(upto - size)')}")
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: each row of ``docs`` of which words are taken, with ``taken`` and the
    number of times it is repeated in full or in part (``copies``)."""
    mixed = mix_sources(docs, **parameters).where("taken > 0")
    return mixed.select("doc_id", "source", "size", "taken", F.ceil(F.col("taken") / F.col("size")).cast("long").alias("copies"))
