"""Toxic words by a gap-weighted subsequence kernel, and documents by their most toxic word.

Two words are alike by the subsequences of four symbols that they share (word ends count as symbols), each weighted by ``DECAY`` to the
power of its spread in both, so a letter put into an insult costs weight and not the match. A support vector machine over
Nyström features of that kernel (similarities to landmark words, whitened) tells insults from other words. Its decision
is a sum over subsequences, so that it folds into one table of weights by hash, which every text is read with.

Labels are those of whole sentences, or texts of them. Which word makes a text toxic is found in turns: the word that
the present table scores highest speaks for each toxic text and against each clean one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import keyed
from corpusloom.session import Scratch

PER_CLASS = 3000  # labelled texts of each class that are learned from, chosen by a hash of the id
OTHERS = 3  # further words of each clean text, by hash
LANDMARKS = 512
TURNS = 3
STRETCHED = 6  # copies of each toxic word with a letter put in, that are learned too
DECAY = 0.6
SPREAD = 6  # symbols from the first to the last of a subsequence, at most
BITS = 20  # of the table of weights
WINDOW = 32  # letters; longer words are read in halfway overlapping windows of so many
TOGETHER = 1 << 16  # characters of texts read at once
LONGEST = 1 << 18  # characters of a piece of a text
SURE = 25.0  # occurrences in toxic texts times the logarithm of the odds, above which a word or a part of one is no chance find
SILENT = -30.0  # raw score of a text without letters
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_kinds: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or a mark, whether it is white space."""
    if not _kinds:
        import unicodedata

        kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
        _kinds[:] = [np.array([k[0] in "LM" for k in kinds]), np.array([chr(c).isspace() for c in range(0x110000)])]
    return _kinds[0], _kinds[1]


@dataclass(frozen=True)
class Symbols:
    """Words as one array of code points with a 0 before, between and after them. ``start`` and ``end`` are the windows: a
    word's symbols from the 0 before it to the 0 after it, or, of long words, parts of them."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # number of the text of each window


def symbols(texts: list[str]) -> Symbols:
    """The words of ``texts``: lower-cased letters between white space, anything else between them left out (``i.d-iot``); letters
    that stand alone side by side are one word (``i d i o t``)."""
    letter, space = _letters()
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[: len(points)]
    is_space = space[points]
    word = np.cumsum(is_space)
    keep = letter[points]
    points, word, owner = points[keep], word[keep], owner[keep]
    if not len(points):
        return Symbols(np.zeros(1, np.uint32), *[np.zeros(0, np.int64)] * 3)
    first = np.append(True, word[1:] != word[:-1])
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(points)))
    joins = np.zeros(len(head), dtype=bool)
    joins[1:] = (size[1:] == 1) & (size[:-1] == 1) & (owner[head[1:]] == owner[head[:-1]])
    head = head[~joins]
    size = np.diff(np.append(head, len(points)))
    n = len(head)
    out = np.zeros(len(points) + n + 1, dtype=np.uint32)
    out[np.arange(len(points)) + np.repeat(np.arange(n), size) + 1] = points
    start = head + np.arange(n)
    end = start + size + 1
    text = owner[head]
    long = np.flatnonzero(size > WINDOW)
    if len(long):
        half = WINDOW // 2
        more = [np.arange(start[i] + half, end[i] - half, half) for i in long]
        last = end.copy()
        last[long] = start[long] + WINDOW
        start, end = np.concatenate([start, *more]), np.concatenate([last, *[np.minimum(m + WINDOW, end[i]) for m, i in zip(more, long, strict=True)]])
        text = np.concatenate([text, np.repeat(text[long], [len(m) for m in more])])
        by = np.argsort(start, kind="stable")
        start, end, text = start[by], end[by], text[by]
    return Symbols(out, start, end, text)


def _spread(points: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int, Iterator[np.ndarray]]]:
    """For each spread: the places at which subsequences within a word begin, the spread, and an iterator of their hashes, one array for
    each choice of the two symbols inside."""
    a, b, c, d = (points * np.uint32(f) for f in _FACTORS)
    gaps = np.cumsum(points == 0)
    for wide in range(3, most):
        at = np.flatnonzero(gaps[wide - 1 : len(points) - 1] == gaps[: len(points) - wide]) if len(points) > wide else np.zeros(0, np.int64)
        ends = a[at] + d[at + wide]

        def hashes(at: np.ndarray = at, ends: np.ndarray = ends, wide: int = wide) -> Iterator[np.ndarray]:
            for i in range(1, wide - 1):
                one = ends + b[at + i]
                for j in range(i + 1, wide):
                    mixed = one + c[at + j]
                    yield (mixed ^ (mixed >> np.uint32(15))) >> np.uint32(32 - BITS)

        yield at, wide, hashes()


def window_scores(seen: Symbols, table: np.ndarray, most: int = SPREAD) -> np.ndarray:
    """The sum of ``table`` over the weighted subsequences that begin in each window."""
    each = np.zeros(len(seen.points), dtype=np.float64)
    for at, wide, hashes in _spread(seen.points, most):
        each[at] += sum(table[h] for h in hashes) * DECAY ** (wide + 1) if len(at) else 0
    if not len(seen.start):
        return np.zeros(0)
    edges = np.stack([seen.start, seen.end], axis=1).ravel()
    return np.add.reduceat(each, edges)[::2]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence by hash, weight) of each word of at most ``WINDOW`` letters; together the kernel's feature vectors."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(points == 0) - 1
    of, what, weight = [], [], []
    for at, wide, hashes in _spread(points, SPREAD):
        for h in hashes:
            of.append(owner[at])
            what.append(h.astype(np.int64))
            weight.append(np.full(len(at), DECAY ** (wide + 1)))
    return np.concatenate(of), np.concatenate(what), np.concatenate(weight)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of each word with each landmark."""
    of, what, weight = subsequences(words)
    z_of, z_what, z_weight = subsequences(landmarks)
    out = np.zeros((len(words), len(landmarks)))
    dense = np.zeros(1 << BITS)
    for j in range(len(landmarks)):
        own = z_of == j
        np.add.at(dense, z_what[own], z_weight[own])
        out[:, j] = np.bincount(of, weight * dense[what], len(words))
        dense[z_what[own]] = 0
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge loss, y in -1, 1) by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-9
    weight = weight / weight.sum()
    active = None
    for _ in range(steps):
        inside = y * (x1 @ w) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        xa, wa = x1[active], weight[active]
        w = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), xa.T @ (wa * y[active]))
    return w[:-1], float(w[-1])


def fit_words(words: list[str], y: np.ndarray, weight: np.ndarray, n_landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """(table of subsequence weights, bias) of the kernel machine on labelled words (y in -1, 1). Landmarks are words of either class, half and half; those of
    the toxic one are the heaviest, and others at even strides of their order by spelling."""

    def strided(of: list[str], n: int) -> list[str]:
        return [of[i] for i in sorted({int(k) for k in np.linspace(0, len(of) - 1, min(n, len(of)))})] if of else []

    total: dict[tuple[str, float], float] = {}
    for word, label, own in zip(words, y, weight, strict=True):
        total[word, float(label)] = total.get((word, float(label)), 0.0) + float(own)
    words, y, weight = [w for w, _ in total], np.array([label for _, label in total]), np.array(list(total.values()))
    heavy = {w: own for (w, label), own in total.items() if label > 0 and len(w) > 1}  # one letter has no subsequence of four symbols
    good = sorted({w for w, label in zip(words, y, strict=True) if label < 0 and len(w) > 1} - set(heavy))
    first = sorted(heavy, key=lambda w: (-heavy[w], w))[: n_landmarks // 4]
    landmarks = first + strided(sorted(set(heavy) - set(first)), n_landmarks // 4) + strided(good, n_landmarks // 2)
    among = kernel(landmarks, landmarks)
    scale = 1 / np.sqrt(np.diag(among))
    values, vectors = np.linalg.eigh(among * scale * scale[:, None])
    used = values > 1e-6 * values.max()
    whiten = scale[:, None] * vectors[:, used] / np.sqrt(values[used])
    w, bias = fit_svm(kernel(words, landmarks) @ whiten, y, weight)
    of, what, times = subsequences(landmarks)
    table = np.bincount(what, times * (whiten @ w)[of], 1 << BITS)
    return table.astype(np.float32), bias


def stretched(words: list[str], seed: int) -> list[str]:
    """Each word with a letter put in at a seeded place."""
    rng = np.random.default_rng(seed)
    out = []
    for w in words:
        at = int(rng.integers(1, max(2, len(w))))
        out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


@dataclass(frozen=True)
class WordMachine:
    """``score`` = logistic(slope * (highest word score - middle))."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    middle: float = 0.0
    flat: float | None = None  # the score of all texts, if there was nothing to learn

    def probability(self, raw: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(raw), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.middle), SILENT, -SILENT)))


def pieces_of(text: str) -> Iterator[str]:
    """A long text in pieces of about ``LONGEST`` characters, cut at white space, or with ``WINDOW`` characters said twice."""
    at = 0
    while len(text) - at > LONGEST:
        cut = max(text.rfind(" ", at + 1, at + LONGEST), text.rfind("\n", at + 1, at + LONGEST))
        if cut > at + LONGEST // 2:
            yield text[at:cut]
            at = cut
        else:
            yield text[at : at + LONGEST]
            at += LONGEST - WINDOW
    yield text[at:]


def _together(texts: Iterator[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, or pieces of them, in lots of about ``TOGETHER`` characters, with the number of each one's text."""
    of, lot, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text):
            of.append(i)
            lot.append(piece)
            size += len(piece)
            if size >= TOGETHER:
                yield of, lot
                of, lot, size = [], [], 0
    if lot:
        yield of, lot


def highest(texts: list[str], table: np.ndarray, bias: float, most: int = SPREAD) -> tuple[np.ndarray, list[str]]:
    """Per text the highest score of a window (``SILENT`` without letters), rounded, and that window (ties: the first)."""
    best, word = np.full(len(texts), SILENT), [""] * len(texts)
    for of, lot in _together(iter(texts)):
        seen = symbols(lot)
        scores = np.round(window_scores(seen, table, most) + bias, 9)
        if not len(scores):
            continue
        start = np.flatnonzero(np.append(True, seen.text[1:] != seen.text[:-1]))
        top = np.maximum.reduceat(scores, start)
        size = np.diff(np.append(start, len(scores)))
        at = np.flatnonzero(scores == np.repeat(top, size))
        at = at[np.append(True, seen.text[at][1:] != seen.text[at][:-1])]
        for w in at:
            i = of[seen.text[w]]
            if scores[w] > best[i]:
                best[i] = scores[w]
                word[i] = seen.points[seen.start[w] : seen.end[w]].tobytes().decode("utf-32-le", "surrogatepass").strip("\0")
    return best, word


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: held out of all learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most about ``per_class`` labelled texts of each class, of near copies mostly one, and how many have each label."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for k in (0, 1):
        share = F.when(F.col("label") == k, min(1.0, per_class / max(1, counts.get(k, 0)))).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = texts.join(F.broadcast(usable.where(spread < share)), F.col("text_id") == F.col("doc_id"))
    one = both.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("label", "t.text")
    words = F.split(F.lower("text"), r"\s+")
    marks = [F.array_min(F.transform(words, lambda w, i=i: F.xxhash64(F.lit(i), w))).alias(f"m{i}") for i in (1, 2)]
    one = one.select("label", "text", *marks).groupBy("m1", "m2").agg(F.min(F.struct("label", F.xxhash64("text"), "text")).alias("t"))  # else the words of a group of copies seem telling
    return one.select("t.label", "t.text"), counts


def _telling(sample: DataFrame) -> np.ndarray:
    """A first table: how much more often four neighbouring symbols occur in toxic texts than in clean ones, as the logarithm of the odds; 0
    where the texts are few. Counts are summed over all texts of the sample, a text counting once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [np.unique(h) for piece in pieces_of(text.as_py()) for _, _, hashes in _spread(symbols([piece]).points, 4) for h in hashes]
                n[label, np.unique(np.concatenate(found))] += 1
        some = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])], names=["h", "clean", "toxic"])

    texts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sample.mapInArrow(run, "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (texts.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (texts.get(0, 0) + 1))
    table = np.zeros(1 << BITS, dtype=np.float32)
    for r in counts.where("toxic >= 5").select("h", "toxic", odds.alias("odds")).where((F.col("odds") > 1.5) & (F.col("toxic") * F.col("odds") > SURE)).collect():  # at most 2 ** BITS
        table[r["h"]] = r["odds"]
    return table


def _telling_words(sample: DataFrame) -> list[tuple[str, int]]:
    """(word, number of toxic texts) of words of at most ``WINDOW`` letters that occur in 5 toxic texts or more, and so much more often in those than in
    clean ones that it can't be chance. Each of them stands for at least 5 texts of the sample, so they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set()
                for piece in pieces_of(text.as_py()):
                    seen = symbols([piece])
                    words.update(seen.points.tobytes().decode("utf-32-le", "surrogatepass").split("\0"))
                words = [w for w in words if 1 < len(w) <= WINDOW]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32())], names=["word", "label"])

    texts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sample.mapInArrow(run, "word string, label int").groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log(F.col("toxic") / max(1, texts.get(1, 0))) - F.log((F.col("clean") + 0.5) / max(1, texts.get(0, 0)))
    return [(r["word"], r["toxic"]) for r in counts.where(F.col("toxic") >= 5).where((odds > 2) & (F.col("toxic") * odds > SURE)).orderBy("word").collect()]


def _witnesses(sample: DataFrame, table: np.ndarray, bias: float, most: int) -> list[tuple[int, float, str, list[str]]]:
    """(label, highest score, its word, ``OTHERS`` further words by hash) of each text of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(table)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best, word = highest([text.as_py()], shared.value, bias, most)
                seen = symbols([next(pieces_of(text.as_py()))])
                hashed = np.argsort(np.arange(len(seen.start), dtype=np.uint32) * np.uint32(_FACTORS[0]))[:OTHERS] if label == 0 else []
                others = [seen.points[seen.start[w] : seen.end[w]].tobytes().decode("utf-32-le", "surrogatepass").strip("\0") for w in hashed]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array(best), pa.array(word), pa.array([others], pa.list_(pa.string()))], names=["label", "best", "word", "others"])

    rows = [tuple(r) for r in sample.mapInArrow(run, "label int, best double, word string, others array<string>").collect()]
    shared.unpersist()
    return sorted(rows)


def _calibrated(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(slope, middle) of a weighted logistic regression on one number, slope at most 8."""
    z = np.stack([np.clip(raw, -6, 6), np.ones(len(raw))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, SILENT, -SILENT)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (weight * (label - p)) - 1e-4 * w)
        w = w + np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-7:
            break
    slope = max(0.1, w[0])
    middle = -w[1] / slope
    return float(min(8.0, slope)), float(middle)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, turns: int = TURNS) -> WordMachine:
    """Learns from documents with a label 0 or 1 that aren't held out.

    At most about ``per_class`` documents of each class are used, chosen by a hash of the id, whole; words of at most ``WINDOW``
    letters of them come to the driver, a bounded number of each. Null labels, null ids, ids without documents and further rows of an
    id don't count (of its texts one is taken, of its labels the smaller). Without both classes every score is the share of toxic labels.
    """
    scratch = Scratch(docs.sparkSession)
    sample, counts = _sample(docs, labels, per_class)
    sample = scratch.keep(sample)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    table, bias, most = _telling(sample), 0.0, 4
    seen = _witnesses(sample, table, bias, most)
    good = [w for label, _, _, others in seen if label == 0 for w in others]
    telling = _telling_words(sample)
    for _ in range(turns):
        bad = [w for w, _ in telling] + [w for label, best, w, _ in seen if label == 1 and w and best > 0]
        good += [w for label, _, w, _ in seen if label == 0 and w]  # those that were mistaken in earlier turns stay
        if not bad or not good:
            return WordMachine(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, 0.0, share)
        more = [w for k in range(STRETCHED) for w in stretched(bad, k)]
        words = [*bad, *more, *good]
        y = np.array([1.0] * (len(bad) + len(more)) + [-1.0] * len(good))
        times = np.array([n for _, n in telling] + [1] * (len(bad) - len(telling))) / 2
        weight = np.concatenate([times, np.tile(1.5 * times / STRETCHED, STRETCHED), np.full(len(good), 2 * times.sum() / len(good))])
        table, bias = fit_words(words, y, weight)
        most = SPREAD
        seen = _witnesses(sample, table, bias, most)
    raw, label = np.array([s[1] for s in seen]), np.array([s[0] for s in seen])
    weight = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum())) * len(seen)
    return WordMachine(table, bias, *_calibrated(raw, label, weight))


def score_toxicity(docs: DataFrame, model: WordMachine) -> DataFrame:
    """(doc_id, score double, word string) for each row of ``docs``: the score of its most toxic word, and that word. Texts that are null, empty or
    without letters score close to 0 and have the word ''. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                piece = batch.slice(low, 500)
                raw, word = highest([t or "" for t in piece.column(1).to_pylist()], shared.value.table, shared.value.bias)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shared.value.probability(raw)), pa.array(word, pa.string())], names=["doc_id", "score", "word"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, keyed(docs, "score double, word string"))
