"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Every word gets integer deletion keys: the polynomial hash of its prefix before a place and of its suffix after it, joined,
for each place at once (numpy), and the hash of the whole word. Two words are one edit apart if and only if they share such a
key at the same place, or one's whole key is a deletion key of the other. Keys are dealt to partitions by their highest bits
and sorted there by Spark, which spills; neighbours in that order are candidates, and their strings decide.

A pair of near words shares exactly one (key, place), except at places inside a run of one letter, which are told apart below,
so near words are counted where they meet and no pair is ever written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.hashing import mix64, powers, prefix_hash
from corpusloom.session import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORDS_HELD = 200_000  # distinct words that a task holds before it passes their counts on
KEYS_AT_ONCE = 200_000
LONG = 1 << 20  # characters; the words of longer texts are taken one by one
WHOLE = -1  # place of a key without deletion


@dataclass(frozen=True)
class SpellingConfig:
    least_length: int = 7  # code points
    least_n: int = 2  # occurrences
    ratio: int = 10  # a form occurs at least so many times as often as the word
    noise: int = 0  # if not 0, runs whose hash with their document it divides lose a code point


def _words(key: str, text: str, config: SpellingConfig) -> Iterator[tuple[str, int]]:
    """Words of one text with their number. Equal runs of a document have the same hash, so each distinct run is treated once."""
    counts = Counter(RUN.findall(text) if len(text) <= LONG else (m.group() for m in RUN.finditer(text)))
    start = zlib.crc32(f"{key}:".encode())
    for run, n in counts.items():
        if len(run) < config.least_length:
            continue
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        if config.noise:
            h = zlib.crc32(word.encode(), start)
            if h % config.noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < config.least_length:
                    continue
        yield word, n


def word_counts(docs: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n long): words of at least ``least_length`` code points and ``least_n`` occurrences in all texts.

    Null and empty texts have no words; a null doc_id counts as empty in the hash of ``noise``. Repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in _words(key, text.as_py() or "", config):
                    held[word] = held.get(word, 0) + n
                if len(held) >= WORDS_HELD:
                    yield flush()
        if held:
            yield flush()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= config.least_n)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, place, key) of every deletion key, then of every whole word (place ``WHOLE``).

    The key of a place joins the hashes of prefix and suffix. Places in a run of one letter give the same key; all but the
    first are marked by an added ``1 << 30``.
    """
    length = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    end = np.cumsum(length)
    start = end - length
    prefix = prefix_hash(points)
    _, down = powers(len(points) + 1)
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(points))
    s, e = start[of], end[of]
    key = (prefix[at] - prefix[s]) * down[s] + (prefix[e] - prefix[at + 1]) * down[s + 1]
    key = mix64(key + (length[of] - 1).astype(np.uint64))
    place = at - s
    again = np.zeros(len(points), dtype=bool)
    again[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
    whole = mix64((prefix[end] - prefix[start]) * down[start] + length.astype(np.uint64))
    out_of = np.concatenate([of, np.arange(len(words))])
    out_place = np.concatenate([place + (again.astype(np.int64) << 30), np.full(len(words), WHOLE)]).astype(np.int32)
    return out_of, out_place, np.concatenate([key, whole]).view(np.int64)


def _keyed(words: DataFrame) -> DataFrame:
    """(key, place, id) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) + 1 for w in words])
            at = 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + KEYS_AT_ONCE, "right")))
                of, place, key = deletion_keys(words[at:to])
                for low in range(0, len(of), KEYS_AT_ONCE):
                    high = low + KEYS_AT_ONCE
                    yield pa.RecordBatch.from_arrays([pa.array(key[low:high]), pa.array(place[low:high]), pa.array(ids[at:to][of[low:high]])], names=["key", "place", "id"])
                at = to

    return words.select("id", "word").mapInArrow(run, "key long, place int, id long")


def meeting(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key and then place (without marks), share key and place with another row, or share a key of
    which one is whole and another isn't."""
    n = len(key)
    gap = np.where(place == WHOLE, WHOLE, place & ~(1 << 30))
    new_key = np.ones(n, dtype=bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= gap[1:] != gap[:-1]
    run = np.cumsum(new) - 1
    together = np.bincount(run)[run] > 1
    group = np.cumsum(new_key) - 1
    wholes = np.bincount(group, place == WHOLE)[group]
    return (together & (place != WHOLE)) | ((wholes > 0) & (wholes < np.bincount(group)[group]))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the key (first column) changes; the rows of a key are few, as its words differ in one code point."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if left and cut == 0 and left[-1].column(0)[0].as_py() == key[-1]:
            left.append(batch)
            continue
        left.append(batch.slice(0, cut))
        whole = pa.Table.from_batches(left).combine_chunks().to_batches()
        yield from whole
        left = [batch.slice(cut)]
    if left:
        yield from pa.Table.from_batches(left).combine_chunks().to_batches()


def _sorted_by_key(rows: DataFrame) -> DataFrame:
    """Dealt by the 16 highest bits of the key, sorted within each partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.shiftrightunsigned("key", 48)).sortWithinPartitions("key", F.col("place").bitwiseAND(F.lit(~(1 << 30))))


def near_of_key(members: list[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, int, str, int]]:
    """(id, number of near words, n of the best of them, it, its id) for rows (place, id, word, n) of one key; near words that share a
    place (or one of whose words is the other's deletion) meet in no other key. Rows whose strings differ are told apart."""

    def better(x: tuple, y: tuple | None) -> tuple:
        return x if y is None or (-x[0], x[1]) < (-y[0], y[1]) else y

    groups: dict[tuple[str, int], list] = {}
    wholes: dict[str, tuple] = {}
    for place, id_, word, n in members:
        if place == WHOLE:
            wholes[word] = (n, word, id_)
        else:
            gap = place & ~(1 << 30)
            groups.setdefault((word[:gap] + word[gap + 1 :], gap), []).append(((n, word, id_), place == gap))
    near: dict[str, tuple[int, tuple | None]] = {}
    for (rest, _), group in groups.items():
        if len(group) > 1:
            best = second = None
            for x, _ in group:
                if best is None or better(x, best) is x:
                    best, second = x, best
                else:
                    second = better(x, second)
            for x, _ in group:
                yield (x[2], len(group) - 1, *(second if x is best else best))
        if rest in wholes:
            for x, first in group:
                if first:
                    yield (x[2], 1, *wholes[rest])
                    count, best = near.get(rest, (0, None))
                    near[rest] = (count + 1, better(x, best))
    for word, (count, best) in near.items():
        yield (wholes[word][2], count, *best)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n_near, best struct<minus_n, word, id>) of each word of ``words`` (id, word, n) that has near words."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            yield batch.filter(pa.array(meeting(batch.column(0).to_numpy(), batch.column(1).to_numpy())))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            keys = batch.column(0).to_numpy()
            edges = [*np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)]
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True))
            out = [x for low, high in zip(edges, edges[1:]) for x in near_of_key(rows[low:high])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["id", "count", "best_n", "best", "best_id"])

    met = scratch.keep(_sorted_by_key(_keyed(words)).mapInArrow(candidates, "key long, place int, id long"))
    named = met.join(words, "id").select("key", "place", "id", "word", "n")
    found = _sorted_by_key(named).mapInArrow(verified, "id long, count long, best_n long, best string, best_id long")
    return found.groupBy("id").agg(F.sum("count").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"), F.col("best_id").alias("id"))).alias("best"))


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of links (id, to), whose chains end: every round halves what is left of a chain."""
    now = scratch.keep(links.select("id", F.col("to").alias("root")))
    while True:
        then = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left")
        then = scratch.keep(then.select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(now)
        if then.where("moved").isEmpty():
            return then.select("id", "root")
        now = then


def group_spellings(docs: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """Per word: word, n, n_near long, form (its most frequent near word if that occurs ``ratio`` times as often; ties: the smallest by code
    point; else null), form_n long, root (the last word along forms; itself without a form).

    A form is more frequent than its word, so chains have no cycles and end after as many steps as ``ratio`` divides the
    largest count. Texts that are null or empty add nothing; an empty table gives no rows; further columns are ignored. A run
    of any length is one word.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs, config).withColumn("id", F.monotonically_increasing_id()))
    near = near_words(words, scratch)
    best: Column = F.when(-F.col("best.minus_n") >= config.ratio * F.col("n"), F.col("best"))
    placed = scratch.keep(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("form")))
    roots = _roots(placed.where("form IS NOT NULL").select("id", F.col("form.id").alias("to")), scratch)
    rooted = placed.join(roots, "id", "left").join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root", "left")
    return rooted.select("word", "n", "n_near", F.col("form.word").alias("form"), (-F.col("form.minus_n")).alias("form_n"), F.coalesce("root_word", "word").alias("root"))
