"""Benchmark decontamination by a generalised suffix automaton over the items' words.

The automaton holds every substring of every item. Document words stream through it; the matched
length at each word tells whether a window of the items ends there. Items are dealt to blocks of about
``BLOCK_CHARS`` characters, one automaton each. One block is scanned in one pass; of several, one at a time is
collected, broadcast, scanned for and given up again, so that what driver and tasks hold doesn't grow with the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes, keyed
from corpusloom.llm.hashing import prefix_hash, span_hashes, word_spans
from corpusloom.session import Scratch

WINDOW = 10
BLOCK_CHARS = 2_000_000
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = np.array([b == 32 for b in range(256)])


def word_ids(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes, and hashes, of the words [0-9a-z and beyond ASCII] of a lower-cased text."""
    data = np.frombuffer(text.translate(_WORD), dtype=np.uint8)
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0, dtype=np.uint64)
    start, end = word_spans(data, _GAP)
    return start, end, span_hashes(prefix_hash(data), start, end)


class SuffixAutomaton:
    """Of all items of a block; states know the windows that they stand for."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        words = {w for _, item in items for w in item}
        self.known = np.array(sorted(words), dtype=np.uint64)
        self.shortest = min((min(window, len(item)) for _, item in items if item), default=window)
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, w)
        self.items: list[dict[int, set[str]]] = [{} for _ in self.next]
        for name, item in items:  # each state's windows: length -> items
            if 0 < len(item) < window:
                state = 0
                for w in item:
                    state = self.next[state][w]
                self.items[state].setdefault(len(item), set()).add(name)
            state = length = 0
            for w in item:
                state, length = self.advance(state, length, w)
                if length >= window:
                    at = self.anchor(state)
                    self.items[at].setdefault(window, set()).add(name)
        self.up = [-1] * len(self.next)  # nearest proper suffix state with windows
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            p = self.link[v]
            self.up[v] = p if p > 0 and self.items[p] else (self.up[p] if p > 0 else -1)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.len[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def advance(self, state: int, length: int, w: int) -> tuple[int, int]:
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            length = self.len[state]
        if w in nxt[state]:
            return nxt[state][w], length + 1
        return 0, 0

    def anchor(self, state: int) -> int:
        """The state, on the suffix path, whose strings include the last ``window`` words."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, end word, items) of each occurrence of a window. Only runs of words that items
        have, long enough for the shortest window, go through the automaton."""
        if not len(self.known) or not len(words):
            return
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        known = self.known[at] == words
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        begin, end = edge[0::2], edge[1::2]
        long = end - begin >= self.shortest
        anchors: dict[int, int] = {}
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            state = length = 0
            for i, w in enumerate(words[a:b].tolist(), a):
                state, length = self.advance(state, length, w)
                if length < self.shortest:
                    continue
                if length >= self.window:
                    if state not in anchors:
                        anchors[state] = self.anchor(state)
                    v = anchors[state]
                else:
                    v = state
                while v > 0:
                    for n, names in self.items[v].items():
                        if n <= length:
                            yield i + 1 - n, i + 1, names
                    v = self.up[v]


def n_blocks(benchmark: DataFrame, block_chars: int) -> int:
    """Blocks that the items are dealt to by hash: as many as leave about ``block_chars`` characters to each."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, math.ceil(total / block_chars))


def block_automaton(benchmark: DataFrame, window: int, block: int, blocks: int) -> SuffixAutomaton:
    """The automaton of one block of items. Null texts and items without words have no windows. Items of one id are one
    item; the windows of items without an id are hit, but name no item."""
    sized = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    mine = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct()
    return SuffixAutomaton([(r["item"], word_ids(r["text"].encode())[2].tolist()) for r in mine.toLocalIterator()], window)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    start, end, _ = word_ids(text)
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : start[a]])
        at = int(end[b - 1])
    return b"".join([*parts, text[at:]]).decode("utf-8", "replace")


def _batch(key: pa.Array, raw: list[bytes | None], found: list[tuple], with_text: bool, name: str) -> pa.RecordBatch:
    """Rows of (number of words, spans, items) as a batch."""
    spans = [x[1] for x in found]
    out = [key, pa.array([x[0] for x in found], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN)]
    if with_text:
        out.append(pa.array([None if t is None else _without(t, s) if s else t.decode("utf-8", "replace") for t, s in zip(raw, spans, strict=True)], pa.string()))
    return pa.RecordBatch.from_arrays(out, names=[name, "n_words", "n_hit", "items", "spans", "clean_text"][: len(out)])


def _pass(docs: DataFrame, automaton: SuffixAutomaton, with_text: bool, key: str = "doc_id") -> tuple[DataFrame, Broadcast]:
    """Documents against one block."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, found = as_bytes(batch, "text"), []
            for text in raw:
                words = word_ids(text or b"")[2]
                hits = list(shared.value.matches(words))
                found.append((len(words), _merged([(a, b) for a, b, _ in hits]), {n for _, _, names in hits for n in names if n is not None}))
            yield _batch(batch.column(0), raw, found, with_text, key)

    return docs.select(key, "text").mapInArrow(run, keyed(docs, _FOUND + (", clean_text string" if with_text else ""), key)), shared


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items array<string>, spans array<struct<start, end>> of
    words (maximal hit runs) and, ``with_text``, the text without them.

    A document word is hit if it lies in an occurrence of a window: ``window`` consecutive words of
    an item, or a whole shorter item. Null and empty texts have no words. Repeated rows are scanned
    each; an empty benchmark hits nothing. Other columns are ignored.
    """
    blocks = n_blocks(benchmark, block_chars)
    if blocks == 1:
        return _pass(docs, block_automaton(benchmark, window, 0, 1), with_text)[0]
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = None
    for block in range(blocks):
        scanned, shared = _pass(rows, block_automaton(benchmark, window, block, blocks), False, "row")
        part = scratch.keep(scanned.where("n_hit > 0").select("row", "items", "spans"))
        shared.destroy()
        found = part if found is None else found.unionAll(part)
    found = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    both = rows.join(found, "row", "left").select("doc_id", "text", "items", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch, "text")
            spans = [_merged([(x["start"], x["end"]) for x in s or ()]) for s in batch.column(3).to_pylist()]
            yield _batch(batch.column(0), raw, [(len(word_ids(t or b"")[2]), s, n or ()) for t, s, n in zip(raw, spans, batch.column(2).to_pylist(), strict=True)], with_text, "doc_id")

    return both.mapInArrow(run, keyed(docs, _FOUND + (", clean_text string" if with_text else "")))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without benchmark passages: spans of ``window`` words or more (or whole shorter items) are cut
    out of the text; documents with over ``max_coverage`` of their words in such spans are dropped.

    Texts without hits, null ones included, stay as they are. All columns are kept; ``n_chars``, if
    there is one, follows the text.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"), F.col("text"))
    found = scan_benchmark(packed, benchmark, window, block_chars, with_text=True)
    found = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    text = F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("doc_id.text"))
    out = []
    for c in columns:
        old = F.col(f"doc_id.`{c}`")
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("n_hit") > 0, F.length(text).cast(dict(docs.dtypes)[c])).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return found.select(*out)
