"""Quality scores learned from preference pairs (Bradley-Terry) and cut at a score quantile.

Features are shares of bytes and of hashed words and word pairs, with a few shapes. Training takes every labelled
document that isn't held out and every pair (preferred, other) of the two classes; the weights minimise the logistic loss of
feature differences. Since the loss of a pair hangs on the difference of two scores alone, a pass over the documents needs
only how the scores of the other class are spread, and no pair is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes, held_out, keyed
from corpusloom.llm.hashing import mix64, word_hashes
from corpusloom.session import Scratch

PAIRS = 40_000
CUT = 0.7
BYTES, WORDS, SHAPES = 256, 1024, 6  # blocks of features
WIDTH = BYTES + WORDS + SHAPES


def features(text: bytes) -> np.ndarray:
    """Fixed-length description of a text: roots of the shares of its bytes, roots of the shares of its words and pairs of
    neighbouring words by hash, and shapes (length, length of words, variety, immediate repeats, most frequent word, line ends).
    Zeros for an empty text."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    out[:BYTES] = np.sqrt(np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=BYTES) / len(text))
    words = word_hashes(text)
    n = len(words)
    if n:
        pairs = mix64(words[:-1] * np.uint64(3) + words[1:])
        hashed = np.concatenate([words, pairs]) % np.uint64(WORDS)
        out[BYTES : BYTES + WORDS] = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=WORDS) / len(hashed))
        times = np.unique(words, return_counts=True)[1]
        same = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
        out[BYTES + WORDS :] = (np.log1p(n) / 10, min(40, len(text) / n) / 20, len(times) / n**0.9, same, times.max() / n, text.count(b"\n") / n)
    return out


@dataclass(frozen=True)
class Ranking:
    """``score`` = logistic(scale * (w . x - cut) + logit(CUT)): the quantile cut lies at ``CUT``."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def levelled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.levelled(x) * self.weights.astype(np.float64)).sum(axis=-1)  # by row, so that equal texts score the same

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ranking(x: np.ndarray, label: np.ndarray, positive_share: float, n_pairs: int = PAIRS, seed: int = 7, steps: int = 300, decay: float = 0.1) -> Ranking:
    """For features at hand, as tests have them: Bradley-Terry weights by full-batch gradient steps on drawn pairs (logistic loss of feature differences,
    with ``decay``); the cut is the quantile of the training scores, classes weighted to ``positive_share``, that
    leaves that share above it. Without both classes all scores are the same."""
    mean, std = (x.mean(axis=0), x.std(axis=0) + 0.01) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, std, np.zeros(WIDTH), 0.0 if not len(good) else -1.0, 1.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / std, -6, 6).astype(np.float32)
    wins, losses = rng.choice(good, n_pairs), rng.choice(bad, n_pairs)
    w = np.zeros(WIDTH, dtype=np.float32)
    speed = np.zeros_like(w)
    rate = 1.0 / max(1.0, float((z * z).sum(axis=1).mean()) / 4)
    for _ in range(steps):
        raw = z @ w
        p = 1 / (1 + np.exp(np.clip(raw[wins] - raw[losses], -40, 40)))
        pull = np.bincount(wins, p, len(z)) - np.bincount(losses, p, len(z))  # of each document, over all its pairs
        speed = 0.9 * speed + rate * ((pull.astype(np.float32) @ z) / n_pairs - decay * w)
        w = w + speed
    raw = z @ w
    weight = np.where(label == 1, positive_share / len(good), (1 - positive_share) / len(bad))
    order = np.argsort(raw, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weight[order]), 1 - positive_share)), len(order) - 1)
    cut = (raw[order[at]] + raw[order[min(at + 1, len(order) - 1)]]) / 2
    return Ranking(mean, std, w, float(cut), float(1 / max(1e-6, np.median(np.abs(raw - cut)))) * 2)


def _described(docs: DataFrame, key: str) -> DataFrame:
    """(key, x): the features as bytes of 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or b"").tobytes() for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=[key, "x"])

    return docs.select(key, "text").mapInArrow(run, keyed(docs, "x binary", key))


STEPS = 1 << 6  # cells of scores to one; scores are counted by cell
REACH = 1 << 6  # scores beyond count as these
PARTS = 1 << 12  # parts of a feature, so that sums are of whole numbers and hang on no order
PULLS = 1 << 16  # parts of a document's pull


def _summed(x: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sums over the rows (label, x) of ``each(features, labels)``, ``width`` whole numbers for a block of rows; summed in Spark, so that
    the driver gets ``width`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                rows = np.frombuffer(b"".join(as_bytes(piece, "x")), dtype=np.float32).reshape(-1, WIDTH)
                total += each(rows, piece.column(0).to_numpy(zero_copy_only=False))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["at", "n"])

    found = x.select("label", "x").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width, dtype=np.int64)
    out[found["at"].to_numpy(dtype=int)] = found["n"].to_numpy()
    return out


def _moments(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    parts = np.rint(rows.astype(np.float64) * PARTS)
    return np.concatenate([parts.sum(axis=0), (parts * parts).sum(axis=0), [(label == 0).sum(), (label == 1).sum()]]).astype(np.int64)


CELLS = 2 * REACH * STEPS + 1


def _cells(raw: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(raw, -REACH, REACH) + REACH) * STEPS).astype(np.int64)


def _over_differences(counts: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each cell i the sum of counts[j] * f(score of i - score of j) over all cells j."""
    kernel = f(np.arange(-(CELLS - 1), CELLS) / STEPS)
    size = 1 << (3 * CELLS).bit_length()
    full = np.fft.irfft(np.fft.rfft(counts.astype(np.float64), size) * np.fft.rfft(kernel, size), size)
    return full[CELLS - 1 : 2 * CELLS - 1]


def _slope(x: DataFrame, at: Ranking, good: np.ndarray, bad: np.ndarray, decay: float) -> np.ndarray:
    """The gradient of the mean loss over all pairs, given the classes' counts by cell: a document's pull is the mean chance
    that the other class has the better of it."""
    lost = lambda d: 1 / (1 + np.exp(np.clip(d, -40, 40)))
    of_good = np.rint(_over_differences(bad, lost) / bad.sum() * PULLS)
    of_bad = -np.rint(_over_differences(good, lambda d: lost(-d)) / good.sum() * PULLS)

    def each(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
        cells, z = _cells(at.raw(rows)), np.rint(at.levelled(rows).astype(np.float64) * PARTS)
        won, lost_ = of_good[cells] * (label == 1), of_bad[cells] * (label == 0)
        return np.concatenate([won @ z, lost_ @ z]).astype(np.int64)  # whole numbers below 2 ** 53

    sums = _summed(x, each, 2 * WIDTH).astype(np.float64) / PULLS / PARTS
    return -(sums[:WIDTH] / good.sum() + sums[WIDTH:] / bad.sum()) + decay * at.weights


def _descend(x: DataFrame, mean: np.ndarray, std: np.ndarray, decay: float, most: int = 40, near: float = 1e-3) -> np.ndarray:
    """The weights of least loss over all pairs and ``decay``, by quasi-Newton steps (L-BFGS), each halved until the loss falls; ends
    once no component of the gradient exceeds ``near``. The loss is convex, so where it starts doesn't matter."""

    def counted(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, Ranking]:
        at = Ranking(mean, std, w, 0.0, 1.0)

        def each(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
            return np.bincount(_cells(at.raw(rows)) + CELLS * (label == 1), minlength=2 * CELLS)

        n = _summed(x, each, 2 * CELLS)
        bad, good = n[:CELLS], n[CELLS:]
        loss = good @ _over_differences(bad, lambda d: np.logaddexp(0, -d)) / good.sum() / bad.sum()
        return float(loss + decay / 2 * w @ w), good, bad, at

    w = np.zeros(WIDTH)
    loss, good, bad, at = counted(w)
    slope = _slope(x, at, good, bad, decay)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.abs(slope).max() <= near:
            break
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            way -= a * y
            kept.append(a)
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += (a - y @ way / (s @ y)) * s
        size = 1.0
        while True:
            then = w - size * way
            found = counted(then)
            if found[0] <= loss - 1e-4 * size * (slope @ way) or size < 1e-3:
                break
            size /= 2
        if found[0] >= loss:
            break  # as good as cells of scores can tell
        after = _slope(x, found[3], found[1], found[2], decay)
        if (then - w) @ (after - slope) > 0:
            past = [*past[-9:], (then - w, after - slope)]
        w, slope, loss = then, after, found[0]
    return w


def at_places(values: DataFrame, places: list[int], few: int = 1000) -> list[float]:
    """The values of column v at these places, from 0, of their order. Cells are counted, and those asked for are cut anew until they
    hold ``few`` rows or one value, so that the driver gets a few thousand numbers at a time."""
    ends = values.agg(F.min("v"), F.max("v")).first()

    def find(low: float, high: float, place: int) -> float:
        held = values.where(F.col("v").between(low, high))
        before = values.where(F.col("v") < low).count()
        while True:
            step = (high - low) / 4096
            if not step or low + step == low or held.limit(few + 1).count() <= few:
                break
            cell = F.least(F.floor((F.col("v") - low) / step), F.lit(4095))
            n = 0
            for r in held.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("c").collect():
                if before + n + r["n"] > place:
                    break
                n += r["n"]
            before, low, high = before + n, r["low"], r["high"]
            held = values.where(F.col("v").between(low, high))
        return low if low == high else sorted(r["v"] for r in held.collect())[place - before]

    return [find(ends[0], ends[1], place) for place in places]


def learn(docs: DataFrame, labels: DataFrame, decay: float = 0.1) -> Ranking:
    """Learns from all documents with a label 0 or 1 that aren't held out.

    Their features are written once; means, weights, the cut (a quantile of the training scores that leaves the share of label 1 above
    it) and the scale come from all of them. Null labels, null
    ids, further rows of an id (one is taken by hash) and ids without documents don't count; without both classes every score is the same.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    one = known.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))  # however often an id is repeated
    scratch = Scratch(docs.sparkSession)
    x = scratch.keep(_described(one.select("label", "t.text"), "label"))
    sums = _summed(x, _moments, 2 * WIDTH + 2).astype(np.float64)
    n_bad, n_good = int(sums[-2]), int(sums[-1])
    n = n_bad + n_good
    mean = sums[:WIDTH] / PARTS / max(1, n)
    std = np.sqrt(np.maximum(0, sums[WIDTH:-2] / PARTS**2 / max(1, n) - mean * mean)) + (0.01 if n else 1.0)
    if not n_bad or not n_good:
        scratch.drop(x)
        return Ranking(mean, std, np.zeros(WIDTH), 0.0 if not n_good else -1.0, 1.0)
    model = Ranking(mean, std, _descend(x, mean, std, decay), 0.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                rows = np.frombuffer(b"".join(as_bytes(piece, "x")), dtype=np.float32).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(rows), pa.float64())], names=["v"])

    raw = scratch.keep(x.select("x").mapInArrow(run, "v double"))
    cut = sum(at_places(raw, [n_bad - 1, n_bad])) / 2
    middle = at_places(raw.select(F.abs(F.col("v") - cut).alias("v")), [(n - 1) // 2, n // 2])
    scratch.drop(x, raw)
    return Ranking(mean, std, model.weights, float(cut), float(1 / max(1e-6, sum(middle) / 2)) * 2)


def score_quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score double) for each row of ``docs``; empty and null texts are scored too. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                x = np.array([features(t or b"") for t in as_bytes(piece, "text")], dtype=np.float32).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, "score double"))


def keep_quality(docs: DataFrame, model: Ranking, cut: float = CUT) -> DataFrame:
    """``docs``, all columns, without the rows that score below the quantile cut."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    return score_quality(packed, model).where(F.col("score") >= cut).select("doc_id.*")
