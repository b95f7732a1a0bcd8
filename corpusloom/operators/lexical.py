"""BM25, rank fusion, boosts and keyword search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Split at single spaces, empty terms included."""
    return F.split(text, " ")


CELL = 8192  # documents
PAIRS = 250_000  # documents times queries for each task


def _term_weights(docs: DataFrame, asked: DataFrame, epsilon: float) -> DataFrame:
    """(term, avgdl, idf) of the terms of ``asked``, from the documents (t) in terms."""
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row
    average = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(asked.select("term").distinct(), "term", "left_semi")
    return idf.join(F.broadcast(average)).select("term", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))  # one row


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qid, id, score) of every document that shares a term with a query (qid, text).

    Okapi weights; negative inverse document frequencies become ``epsilon`` times their average.
    Document frequencies are counted over distinct terms of a document, combined before their shuffle; postings are
    cut down to query terms before they are grouped. Corpus statistics are one row. Postings meet the queries of their term in cells of
    some ``CELL`` documents, as many tasks as that takes, so that a frequent term's pairs are dealt to many.
    """
    asked = _asked(queries)
    split = docs.select("id", terms(F.col("text")).alias("t"))
    idf = _term_weights(split, asked, epsilon)
    lists = split.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    lists = lists.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    tf = F.col("tf")
    weight = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    n, m = docs.count(), queries.count()
    cells = -(-n // CELL) or 1
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-n * m // PAIRS), 20_000))
    weights = asked.join(idf, "term").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    lists = lists.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")).repartition(tasks, "term", "cell")  # a number of its own, so that tasks aren't joined again for their few bytes
    pairs = weights.join(lists, ["term", "cell"]).select("qid", "id", weight.alias("w"))
    return pairs.repartition(tasks, "qid", "id").groupBy("qid", "id").agg(F.sum("w").alias("score"))  # terms of a pair lie apart, so sums before the shuffle would only hold memory


BLOCK, LOT, SLICE = 512, 4096, 256  # queries and documents of a cell, documents of a product


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank): the first ``k`` documents of each query by ``bm25`` score rounded to ``digits``, then id.

    Documents are dealt to lots and queries to blocks; a cell of both takes some ``LOT`` by ``BLOCK`` of them in
    one task, as products of a matrix of documents by terms with one of terms by queries, and gives each query's best rows only. So texts move once for each block
    of queries, and neither postings nor pairs are shuffled. A cell leaves what may still round to its ``k``-th score.
    """
    asked = _asked(queries)
    idf = _term_weights(docs.select(terms(F.col("text")).alias("t")), asked, epsilon)
    n, m = docs.count(), queries.count()
    lots, blocks = max(1, -(-n // LOT)), max(1, -(-m // BLOCK))
    number = lambda name, of: F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    weights = asked.join(idf, "term").select(number("qid", blocks).alias("block"), "qid", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl").withColumn("lot", every(lots))
    texts = docs.where("text IS NOT NULL").select("id", "text", number("id", lots).alias("lot")).withColumn("block", every(blocks))
    near = 2 * 10.0**-digits

    def meet(texts: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(weights):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        rows = texts.groupby("id", sort=False, dropna=False)["text"].agg(list)  # rows of one id are one document, as in ``bm25``
        term, names = pd.factorize(weights["term"])
        query, qids = pd.factorize(weights["qid"])
        place, avgdl = {t: i for i, t in enumerate(names)}, weights["avgdl"].iloc[0]
        asked = np.zeros((len(names), len(qids)))
        asked[term, query] = weights["w"].to_numpy()
        has = np.zeros(asked.shape, dtype=np.float32)
        has[term, query] = 1
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qids]
        for at in range(0, len(rows), SLICE):
            part = rows.iloc[at : at + SLICE]
            split = [[t.split(" ") for t in held] for held in part]
            tf, length = np.zeros((2, len(part), len(names)))
            for row, held in enumerate(split):
                for words in held:
                    found = np.bincount(np.array([place[w] for w in words if w in place], dtype=np.int64), minlength=len(names))
                    tf[row] += found
                    length[row] = np.maximum(length[row], len(words) * (found > 0))
            score = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))) @ asked
            score[(tf > 0).astype(np.float32) @ has == 0] = -np.inf
            ids = part.index.to_numpy()
            low = np.partition(score, -k, axis=0)[-k] if len(part) > k else np.full(len(qids), -np.inf)
            for j in range(len(qids)):
                there = np.flatnonzero((score[:, j] >= low[j] - near) & (score[:, j] > -np.inf))
                best[j].append((ids[there], score[there, j]))
        out = []
        for j, found in enumerate(best):
            ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(ids) > k:
                held = score >= np.partition(score, -k)[-k] - near
                ids, score = ids[held], score[held]
            out.append(pd.DataFrame({"qid": qids[j], "id": ids, "score": score}))
        return pd.concat(out)

    met = texts.groupBy("lot", "block").cogroup(weights.groupBy("lot", "block")).applyInPandas(meet, f"qid {queries.schema['qid'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double")
    return ranked(met.withColumn("score", F.round("score", digits)), k)


def ranked(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The first ``k`` rows of each query by score, then id, with their 1-based rank."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "id"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (0.8, 0.2), constant: int = 60, k: int = 20) -> DataFrame:
    """(qid, id, rrf, rank) from two ranked lists (qid, id, rank); a missing rank adds nothing."""
    a = first.select("qid", "id", F.col("rank").alias("rank_a"))
    b = second.select("qid", "id", F.col("rank").alias("rank_b"))
    both = a.join(b, ["qid", "id"], "full_outer")
    score = F.coalesce(weights[0] / (constant + F.col("rank_a")), F.lit(0.0)) + F.coalesce(weights[1] / (constant + F.col("rank_b")), F.lit(0.0))
    return ranked(both.select("qid", "id", score.alias("rrf")), k, "rrf")


def fused_by_text(vector: DataFrame, lexical: DataFrame, weights: tuple[float, float] = (0.8, 0.2), constant: int = 60, k: int = 20) -> DataFrame:
    """(qid, text, rrf, rank) of two ranked lists (qid, text, rank), merged by text: of texts that one list holds
    twice, the vector list counts the last rank, the lexical one the first."""
    if min(weights) < 0:
        raise ValueError("weights can't be negative")
    a = vector.groupBy("qid", "text").agg(F.max("rank").alias("rank"))
    b = lexical.groupBy("qid", "text").agg(F.min("rank").alias("rank"))
    return reciprocal_rank_fusion(a.withColumnRenamed("text", "id"), b.withColumnRenamed("text", "id"), weights, constant, k).withColumnRenamed("id", "text")


def keyword_score(query_terms: Column, text: Column, prefix: Column | None = None, query: Column | None = None) -> Column:
    """Share of the query's terms that the lower-cased text contains; +0.5 if query or prefix contains the other (an empty prefix does)."""
    low = F.lower(text)
    share = F.size(F.filter(query_terms, lambda t: F.contains(low, t))) / F.greatest(F.size(query_terms), F.lit(1))
    if prefix is None or query is None:
        return share
    p, q = F.lower(F.coalesce(prefix, F.lit(""))), F.lower(query)
    return share + F.when(F.contains(p, q) | F.contains(q, p), 0.5).otherwise(0.0)


def category_boost(score: Column, category: Column, wanted: str) -> Column:
    """+0.08 for the wanted category, +0.03 for one of the same prefix up to "/", else -0.02."""
    same = F.substring_index(category, "/", 1) == wanted.split("/")[0]
    return score + F.when(category == wanted, 0.08).when(same, 0.03).otherwise(-0.02)


def budget(total: int, weight: Column, sum_of_weights: Column) -> Column:
    return F.floor(total * weight / sum_of_weights).cast("long")
