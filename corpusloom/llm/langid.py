"""Language identification of mixed text.

Each word gets a score for each learned language from its byte n-grams; the script of its letters, by ranges
of code points, narrows the candidates; Viterbi with a penalty for switching labels runs of words, so that a text's
languages come as spans. The document's language is the one with the most labelled letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes, held_out, keyed, pieces
from corpusloom.llm.hashing import word_spans

SAMPLE_PER_LANG = 1500
BUCKETS = 1 << 16
SWITCH = 6.0
UNKNOWN = "und"
_GAP = np.array([b == 32 for b in range(256)])
CHUNK_BYTES = 1 << 17  # of a text that are scored at once
#: Unicode ranges of scripts, first and last code point. Letters outside of them are of script 0, "other".
SCRIPT_RANGES = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2B8), (0x1D00, 0x1D25), (0x1D2C, 0x1D65), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3E1), (0x3F0, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x531, 0x58F), (0xFB13, 0xFB17))),
    ("Hebrew", ((0x591, 0x5F4), (0xFB1D, 0xFB4F))),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC))),
    ("Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Gurmukhi", ((0xA00, 0xA7F),)),
    ("Gujarati", ((0xA80, 0xAFF),)),
    ("Oriya", ((0xB00, 0xB7F),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Telugu", ((0xC00, 0xC7F),)),
    ("Kannada", ((0xC80, 0xCFF),)),
    ("Malayalam", ((0xD00, 0xD7F),)),
    ("Sinhala", ((0xD80, 0xDFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Lao", ((0xE80, 0xEFF),)),
    ("Tibetan", ((0xF00, 0xFFF),)),
    ("Myanmar", ((0x1000, 0x109F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("Ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF))),
    ("Khmer", ((0x1780, 0x17FF),)),
    ("Mongolian", ((0x1800, 0x18AF),)),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("Han", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF))),
)
N_SCRIPTS = len(SCRIPT_RANGES) + 1


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 for what is no part of a word, 1 for marks that go with letters, 2 for letters; and its script."""
    kind = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x32000):  # no letters above
        category = unicodedata.category(chr(c))
        kind[c] = 2 if category[0] == "L" else 1 if category[0] == "M" else 0
    script = np.zeros(0x110000, dtype=np.int32)
    for i, (_, ranges) in enumerate(SCRIPT_RANGES, 1):
        for first, last in ranges:
            script[first : last + 1] = i
    return kind, script


@dataclass
class Words:
    """The words of a text: letters and their marks, lower-cased; all else is a gap. ``data``: UTF-8 with a space for each
    gap, and one at either end; ``script`` and ``letters`` by word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def split_words(text: bytes) -> Words:
    kind, script = _code_points()
    points = np.frombuffer((" " + text.decode("utf-8", "replace").lower() + " ").encode("utf-32-le"), dtype=np.uint32)
    points = np.where(kind[points] > 0, points, np.uint32(32))
    data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    start, end = word_spans(data, _GAP)
    first, last = word_spans((points != 32).astype(np.uint8), np.array([True, False]))
    if not len(first):
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, none, none)
    letters = np.add.reduceat((kind[points] == 2).astype(np.int64), first)  # gaps count as nothing
    return Words(data, start, end, np.maximum.reduceat(script[points], first).astype(np.int64), letters)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 2-, 3- and 4-byte strings that end at each byte; they don't reach over more than one gap."""
    d = data.astype(np.uint32)
    one = np.concatenate([[np.uint32(32)], d[:-1]])
    two = np.concatenate([[np.uint32(32)], one[:-1]])
    three = np.concatenate([[np.uint32(32)], two[:-1]])
    two = np.where(one == 32, np.uint32(32), two)
    three = np.where(two == 32, np.uint32(32), three)
    mix = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return [mix(d | one << np.uint32(8)), mix((d | one << np.uint32(8) | two << np.uint32(16)) ^ np.uint32(0x5BD1E995)), mix((d | one << np.uint32(8) | two << np.uint32(16) | three << np.uint32(24)) * np.uint32(0x85EBCA6B) ^ np.uint32(0x27D4EB2F))]


@dataclass
class LanguageModel:
    """``table[order, bucket, language]``: log likelihoods; ``scripts[script, language]``: whether the language uses it."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray
    switch: float = SWITCH

    def scores(self, words: Words) -> np.ndarray:
        """Scores (word, language) of the words of a text, in chunks so that memory for them is bounded for any length."""
        n = len(words.start)
        total = np.zeros((n, len(self.langs)), dtype=np.float32)
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(words.end, words.start[at] + CHUNK_BYTES, side="right")))
            base = int(words.start[at]) - 1
            start, end = words.start[at:upto] - base, words.end[at:upto] - base
            for order, buckets in enumerate(grams(words.data[base : base + int(end[-1]) + 1])):
                running = np.cumsum(self.table[order][buckets], axis=0, dtype=np.float64)
                total[at:upto] += running[end] - running[start - 1]  # the gap after the word closes its last string
            at = upto
        narrowed = self.scripts[words.script]
        narrowed |= ~narrowed.any(axis=1, keepdims=True)
        total[~narrowed] -= 50
        return total


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label sequences of many texts at once: step t advances every text that has a t-th word."""
    lengths = np.array([len(s) for s in scores])
    order = np.argsort(-lengths, kind="stable")
    total, k = int(lengths.sum()), scores[0].shape[1] if scores else 0
    if not total:
        return [np.empty(0, dtype=np.int32) for _ in scores]
    flat = np.concatenate([scores[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
    shorter = -lengths[order]
    stay = np.zeros((total, k), dtype=bool)
    jump = np.zeros(total, dtype=np.int32)
    best = np.zeros((len(scores), k), dtype=np.float32)
    labels = np.zeros(total, dtype=np.int32)
    steps = int(lengths.max())
    for t in range(steps):
        live = int(np.searchsorted(shorter, -t, side="left"))
        at = begin[:live] + t
        now = best[:live]
        top = now.argmax(axis=1)
        cap = now[np.arange(live), top] - np.float32(switch)
        hold = now >= cap[:, None]
        stay[at], jump[at] = hold, top
        best[:live] = np.where(hold, now, cap[:, None]) + flat[at]
    state = np.zeros(len(scores), dtype=np.int32)
    fresh = 0
    for t in range(steps - 1, -1, -1):
        live = int(np.searchsorted(shorter, -t, side="left"))
        if live > fresh:  # texts whose last word this is
            state[fresh:live] = best[fresh:live].argmax(axis=1)
            fresh = live
        at = begin[:live] + t
        labels[at] = state[:live]
        state[:live] = np.where(stay[at, state[:live]], state[:live], jump[at])
    out: list[np.ndarray] = [labels[:0]] * len(scores)
    for j, i in enumerate(order):
        out[i] = labels[begin[j] : begin[j] + lengths[i]]
    return out


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, switch: float = SWITCH) -> LanguageModel:
    """Learns from documents with a language and a text that aren't held out.

    At most about ``per_lang`` documents of each language are used, chosen by a hash of the id.
    Their n-gram counts are summed in Spark by language and bucket; the driver gets at most
    3 * ``BUCKETS`` numbers of each language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    index = {name: i for i, name in enumerate(langs)}
    if not langs:
        return LanguageModel([], np.zeros((3, BUCKETS, 0), dtype=np.float32), np.zeros((N_SCRIPTS, 0), dtype=bool), switch)
    share = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, per_lang / sizes[name])))])
    spread = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(spread < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), 3 * BUCKETS + N_SCRIPTS), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(as_bytes(batch, "text"), batch.column(1).to_pylist(), strict=True):
                words = split_words(text or b"")
                row = counts[index[lang]]
                for order, buckets in enumerate(grams(words.data)):
                    row[order * BUCKETS : (order + 1) * BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                row[3 * BUCKETS :] += np.bincount(words.script, minlength=N_SCRIPTS)
        lang, bucket = np.nonzero(counts)
        for at in range(0, max(1, len(lang)), 100_000):
            a, b = lang[at : at + 100_000], bucket[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[a, b], pa.int64())], names=["lang", "bucket", "n"])

    partial = sample.select("text", "lang").mapInArrow(run, "lang int, bucket int, n long")
    summed = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), 3 * BUCKETS + N_SCRIPTS))
    counts[summed["lang"], summed["bucket"]] = summed["n"]
    gram = counts[:, : 3 * BUCKETS].reshape(len(langs), 3, BUCKETS) + 0.2
    logs = np.log(gram / gram.sum(axis=2, keepdims=True))
    logs -= logs.mean(axis=0, keepdims=True)  # only differences between languages count
    script = counts[:, 3 * BUCKETS :]
    used = (script >= 0.005 * np.maximum(1, script.sum(axis=1, keepdims=True))).T
    return LanguageModel(langs, (0.4 * logs).transpose(1, 2, 0).astype(np.float32).copy(), used, switch)


def identify(docs: DataFrame, model: LanguageModel, with_spans: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score and, ``with_spans``, spans array<struct<lang, first_word, n_words>>.

    ``lang_pred`` has the most letters among the spans (ties: first by name); ``score`` is its share
    of them. Null texts, and those without letters, are ``und`` with score 0. The model is bounded:
    3 * ``BUCKETS`` numbers of each language. Columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.langs)
        span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for whole in batches:
            for batch in pieces(whole, (96 << 20) // max(4, k)):  # scores are a number for each word and language
                scores, letters = [], []
                for text in as_bytes(batch, "text"):
                    words = split_words(text if text and k else b"")
                    if not words.letters.sum():
                        words = split_words(b"")
                    scores.append(m.scores(words))
                    letters.append(words.letters)
                names, shares, spans = [], [], []
                for labels, n in zip(viterbi(scores, m.switch), letters, strict=True):
                    if not len(labels):
                        names.append(UNKNOWN)
                        shares.append(0.0)
                        spans.append([])
                        continue
                    by = np.bincount(labels, weights=n, minlength=k)
                    top = int(by.argmax())
                    names.append(m.langs[top])
                    shares.append(float(by[top] / by.sum()))
                    if with_spans:
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]).tolist()
                        spans.append([{"lang": m.langs[labels[a]], "first_word": a, "n_words": b - a} for a, b in zip(cut[:-1], cut[1:], strict=True)])
                out = [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())]
                if with_spans:
                    out.append(pa.array(spans, span))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    ddl = "lang_pred string, score double" + (", spans array<struct<lang:string,first_word:bigint,n_words:bigint>>" if with_spans else "")
    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, ddl))
