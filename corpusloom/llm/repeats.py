"""Removal of repeated byte strings of 200 or more, by blockwise suffix sorting with a difference cover.

Every 200-byte string belongs to one suffix bucket, named by the smallest hash among its 50-byte
substrings; equal strings, wherever they start, fall into the same bucket at the same distance, and
neighbouring strings mostly share theirs. Copies of a text are one text with a multiplicity. A run of
starts that share a bucket is a context, known by the hash of its bytes; equal contexts are counted in
Spark, and one holder of each gives the bytes. Buckets that occur once hold no repeats and are left out
before any text moves. The rest meet bucket by bucket, in blocks of bounded size, and each block's
suffixes are sorted with ranks of a difference-cover sample; what is found repeated in a context goes
back to its holders by a join.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes, pieces
from corpusloom.llm.hashing import prefix_hash, span_hashes
from corpusloom.llm.suffixes import PADDING, classes
from corpusloom.session import Scratch

LENGTH = 200
SEED = 50
BLOCK_BYTES = 2 << 20
HOT = 2000
_CHUNK = 1 << 22
_POSITION = np.uint64((1 << 24) - 1)


def buckets(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, number of starts, hash of their bytes) of the runs of starts that share a bucket, for one text."""
    names, firsts, counts, held = [], [], [], []
    span = LENGTH - SEED + 1
    for base in range(0, len(text) - LENGTH + 1, _CHUNK):  # chunks overlap, so that each start is in one of them whole
        data = np.frombuffer(text, dtype=np.uint8, offset=base, count=min(_CHUNK + LENGTH - 1, len(text) - base))
        at = np.arange(len(data) - SEED + 1)
        sums = prefix_hash(data)
        hashed = span_hashes(sums, at, at + SEED)
        ranked = (hashed & ~_POSITION) | at.astype(np.uint64)
        n = len(data) - LENGTH + 1
        padded = np.full(-(-len(ranked) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(ranked)] = ranked
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])  # the smallest of each window of span
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        names.append(hashed[(low[first] & _POSITION).astype(np.int64)])
        firsts.append(first + base)
        counts.append(np.diff(np.append(first, n)))
        held.append(span_hashes(sums, first, first + counts[-1] - 1 + LENGTH))
    if not names:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    return np.concatenate(names), np.concatenate(firsts), np.concatenate(counts), np.concatenate(held)


def _anchors(texts: DataFrame) -> DataFrame:
    """(bucket, context, copies, holders): holders are triples of the two text keys and the run, which packs the first start
    and the number of starts less one. Equal texts of a batch are one, with their number as copies, and so are equal
    contexts: a hot text or bucket shuffles a row per batch and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 8 << 20):
                found = []
                keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                copies_of = Counter(keys)
                for text, key in zip(as_bytes(batch, "text"), keys, strict=True):
                    copies = copies_of.pop(key, 0)
                    if copies and text and len(text) >= LENGTH:
                        name, first, count, held = buckets(text)
                        found.append((name.view(np.int64), held.view(np.int64), np.full(len(name), copies), np.full(len(name), key[0]), np.full(len(name), key[1]), first << 8 | count - 1))
                if found:
                    name, held, copies, *holder = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.lexsort((held, name))
                    name, held, copies = name[order], held[order], copies[order]
                    edge = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (held[1:] != held[:-1])]))
                    flat = np.stack(holder, axis=1)[order].ravel()
                    holders = pa.ListArray.from_arrays(pa.array(np.append(edge, len(name)) * len(holder), pa.int32()), pa.array(flat, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(name[edge], pa.int64()), pa.array(held[edge], pa.int64()), pa.array(np.add.reduceat(copies, edge), pa.int64()), holders], names=["bucket", "context", "copies", "holders"])

    return texts.select("text", "text_key", "text_check").mapInArrow(run, "bucket long, context long, copies long, holders array<long>")


def _bytes(joined: DataFrame) -> DataFrame:
    """(bucket, owner, context, start, copies, bytes): the bytes of each context, from the text that stands for its holders.

    A context of a hot bucket goes as its single strings, spread by their own hashes, so that no task gathers such a
    bucket; ``owner`` and ``start`` tell where they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 8 << 20):
                out: list[tuple] = []
                for text, runs in zip(as_bytes(batch, "text"), batch.column(1), strict=True):
                    for r in runs.as_py():
                        first, n = r["run"] >> 8, (r["run"] & 255) + 1
                        if not r["hot"]:
                            out.append((r["bucket"], r["bucket"], r["context"], 0, r["copies"], text[first : first + n - 1 + LENGTH]))
                        else:
                            for s in range(n):
                                own = text[first + s : first + s + LENGTH]
                                out.append((xxhash.xxh3_64_intdigest(own) - (1 << 63), r["bucket"], r["context"], s, r["copies"], own))
                    if len(out) >= 20_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        *numbers, held = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in numbers], pa.array(held, pa.binary())], names=["bucket", "owner", "context", "start", "copies", "bytes"])

    return joined.select("text", "runs").mapInArrow(run, "bucket long, owner long, context long, start long, copies long, bytes binary")


def _solve(held: list[bytes], copies: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first start, end start) of the runs of repeated starts in the rows of a block."""
    lengths = np.array([len(c) for c in held], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    block = np.frombuffer(b"".join(held) + bytes(PADDING), dtype=np.uint8)
    count = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(held)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.repeat(begin, count)
    kind = classes(block, at, LENGTH)
    repeated = np.bincount(kind, weights=copies[owner])[kind] > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
    cut = np.union1d(edge, np.concatenate([[0], np.cumsum(count)]))  # runs end with their row
    first = cut[:-1][repeated[cut[:-1]]]
    end = cut[1:][repeated[cut[:-1]]]
    row = owner[first]
    shift = at[first] - begin[row]
    return list(zip(row.tolist(), shift.tolist(), (shift + end - first).tolist(), strict=True))


def _repeated(contexts: DataFrame) -> DataFrame:
    """(bucket, context, start, end): repeated starts of each context, from its own first byte; partitions hold whole buckets, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = [(rows[i][1], rows[i][2], rows[i][3] + a, rows[i][3] + b) for i, a, b in _solve([r[5] for r in rows], np.array([r[4] for r in rows], dtype=np.int64))]
            for at in range(0, len(found), 50_000):
                columns = zip(*found[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "context", "start", "end"])

        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                numbers = [batch.column(i).to_pylist() for i in range(5)]
                for row in zip(*numbers, as_bytes(batch, "bytes"), strict=True):
                    if size >= BLOCK_BYTES and row[0] != rows[-1][0]:
                        yield from flush()
                        rows, size = [], 0
                    rows.append(row)
                    size += len(row[5])
        if rows:
            yield from flush()

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, context long, start long, end long")


def find_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, the text that is left.

    Texts are bytes of UTF-8 (null: empty). A byte is removed if it lies in a ``LENGTH``-byte string
    that starts anywhere else too, in the same text or another; strings are judged on the input.
    Shorter texts lose nothing. Repeated rows count as occurrences of their own. A text that is left
    with broken characters is repaired by replacement characters; the hash is of the bytes. Texts are taken as
    equal by 128 bits of hash, contexts of one bucket by 64. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keys = [F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(5), "text").alias("text_check")]
    rows = docs.select("text", *keys)
    anchors = _anchors(rows)
    seen = anchors.withColumn("n", F.sum("copies").over(Window.partitionBy("bucket"))).where("n > 1").drop("n")
    seen = scratch.keep(seen)
    at = lambda i: F.struct(F.get("holders", i).alias("text_key"), F.get("holders", i + 1).alias("text_check"), F.get("holders", i + 2).alias("run"))
    contexts = seen.groupBy("bucket", "context").agg(F.sum("copies").alias("copies"), F.min(at(F.lit(0))).alias("one"))
    hot = F.count(F.lit(1)).over(Window.partitionBy("bucket")) > HOT
    contexts = contexts.select("bucket", "context", "copies", "one.*", hot.alias("hot"))
    wanted = contexts.groupBy("text_key", "text_check").agg(F.collect_list(F.struct("bucket", "context", "run", "copies", "hot")).alias("runs"))
    texts = rows.groupBy("text_key", "text_check").agg(F.first("text").alias("text"))  # shuffled once, for both joins
    found = _repeated(_bytes(texts.join(wanted, ["text_key", "text_check"])))
    found = found.groupBy("bucket", "context").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    held = seen.select("bucket", "context", F.explode(F.transform(F.sequence(F.lit(0), F.size("holders") - 3, F.lit(3)), at)).alias("h")).select("bucket", "context", "h.*").distinct()
    held = held.join(found, ["bucket", "context"]).select("text_key", "text_check", F.shiftright("run", 8).alias("first"), "runs")
    spans = held.groupBy("text_key", "text_check").agg(F.collect_list(F.struct("first", "runs")).alias("spans"))
    judged = texts.join(spans, ["text_key", "text_check"]).select("text_key", "text_check", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 16 << 20):
                rows = []
                for text, spans in zip(as_bytes(batch, "text"), batch.column(3), strict=True):
                    data = text or b""
                    mine = sorted((s["first"] + r["start"], s["first"] + r["end"] - 1 + LENGTH) for s in spans.as_py() or () for r in s["runs"])
                    parts, at, removed, n = [], 0, 0, 0
                    reach = -1
                    for a, b in mine:
                        if a > reach:  # a new maximal run
                            n += 1
                            parts.append(data[at:a])
                            removed += b - a
                        elif b > reach:
                            removed += b - reach
                        reach = max(reach, b)
                        at = reach
                    left = b"".join([*parts, data[at:]]) if mine else data
                    rows.append((len(data), removed, n, hashlib.sha256(left).hexdigest(), None if text is None else left.decode("utf-8", "replace")))
                columns = list(zip(*rows, strict=True))
                out = [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
                if with_text:
                    out.append(pa.array(columns[4], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["text_key", "text_check", *_RESULT][: len(out)])

    result = judged.mapInArrow(run, "text_key long, text_check long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else ""))
    plain = [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("all_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("all_sha256"), *([F.col("text").alias("all_text")] if with_text else [])]
    both = docs.select("doc_id", *keys, *plain).join(result, ["text_key", "text_check"], "left")  # texts without repeats have no result
    out = [F.coalesce("n_bytes", "all_bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")]
    return both.select("doc_id", *out, *([F.coalesce("kept_text", "all_text").alias("kept_text")] if with_text else []))


_RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without repeated strings; see ``find_repeats``."""
    return find_repeats(docs, with_text=True).select("doc_id", F.col("kept_text").alias("text"))
