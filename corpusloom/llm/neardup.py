"""Near-duplicate documents: MinHash bands propose, Odd sketches estimate, full shingle sets decide.

An Odd sketch folds the MinHash samples into a bitmap of parities; the bits in which two sketches
differ estimate how many samples differ, most precisely at high similarities. Candidates whose
estimate is far below the threshold are dropped before their texts are fetched. A second bitmap folds
the whole set: two sets differ in at least as many elements as their bitmaps do in bits, so a pair
whose bitmaps differ too much is no link for certain. Within a bucket it is held against all members
of other components in memory, and only pairs that it can't rule out leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes, keyed, pieces
from corpusloom.llm.hashing import mix64, shingles, word_hashes
from corpusloom.llm.linking import link_components
from corpusloom.session import Scratch


@dataclass(frozen=True)
class NearDupConfig:
    """Two texts of Jaccard similarity 0.8 share at least one of 32 bands of 4 samples but for 5 in 10^8."""

    words: int = 5
    threshold: int = 80  # percent
    bands: int = 32
    rows: int = 4
    bits: int = 512
    set_bits: int = 2048
    block: int = 8192  # members of a bucket that meet in one task
    seed: int = 1

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Differing sketch bits up to which a pair is still checked: those expected 0.25 below the threshold,
        some six standard deviations from the threshold's."""
        changed = 2 * self.samples * (1 - max(0.0, self.threshold / 100 - 0.25))
        return math.ceil(self.bits / 2 * (1 - (1 - 2 / self.bits) ** changed))


@lru_cache(maxsize=4)
def _factors(config: NearDupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(config.seed)
    a = rng.integers(0, 1 << 32, config.samples, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, config.samples, dtype=np.uint32), rng.integers(0, 1 << 63, config.samples, dtype=np.uint64)


def min_hashes(found: np.ndarray, config: NearDupConfig) -> np.ndarray:
    a, b, _ = _factors(config)
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(config.samples, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (a[:, None] * low[None, at : at + 2048] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, config: NearDupConfig) -> np.ndarray:
    """Parities of the (position, sample) elements by bit, as 64-bit integers."""
    _, _, salt = _factors(config)
    bit = mix64(samples.astype(np.uint64) + salt) % np.uint64(config.bits)
    parity = (np.bincount(bit.astype(np.int64), minlength=config.bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def band_keys(samples: np.ndarray, config: NearDupConfig) -> np.ndarray:
    _, _, salt = _factors(config)
    key = np.arange(config.bands, dtype=np.uint64) + salt[0]
    for column in samples.reshape(config.bands, config.rows).astype(np.uint64).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def parity(found: np.ndarray, config: NearDupConfig) -> np.ndarray:
    """Parities of a whole set by bit, as 64-bit integers."""
    bit = mix64(found + np.uint64(config.seed)) % np.uint64(config.set_bits)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=config.set_bits) & 1).astype(np.uint8)).view(np.int64)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signatures(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch, bands, parity); for texts without words the last four are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 16 << 20):
                n, keys, sketches, bands, parities = [], [], [], [], []
                for text in as_bytes(batch, "text"):
                    found = shingles(word_hashes(text or b""), config.words)
                    n.append(len(found))
                    if len(found):
                        samples = min_hashes(found, config)
                        keys.append(set_key(found))
                        sketches.append(odd_sketch(samples, config))
                        bands.append(band_keys(samples, config))
                        parities.append(parity(found, config))
                    else:
                        keys.append(None)
                        sketches.append(None)
                        bands.append(None)
                        parities.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "sketch", "bands", "parity"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, "n_shingles long, set_key binary, sketch array<long>, bands array<long>, parity array<long>"))


def _confirmed(pairs: DataFrame, config: NearDupConfig) -> DataFrame:
    """Of pairs with both texts, those of which the full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def sets(text: bytes) -> np.ndarray:
            return shingles(word_hashes(text), config.words)

        for whole in batches:
            for batch in pieces(whole, 16 << 20):
                keep = []
                columns = [as_bytes(batch, c) for c in ("text_a", "key_a", "text_b", "key_b")]
                for text_a, key_a, text_b, key_b in zip(*columns, strict=True):
                    x, y = sets(text_a or b""), sets(text_b or b"")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    whole_sets = set_key(x) == key_a and set_key(y) == key_b  # else another row of the same id
                    keep.append(whole_sets and 100 * both >= config.threshold * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "key_a", "text_b", "key_b").mapInArrow(run, "a long, b long")


def _possible(members: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs (a, b) of one bucket and different components whose set bitmaps don't rule a link out.

    A pair that shares several buckets is given once, from the first; where one of the two is that
    bucket's pivot, the pair has been checked. Buckets above ``block`` members are dealt to pairs of blocks, so that no task holds a whole hot bucket.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = members.join(sizes, "bucket").select("bucket", "id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "bucket", "id", "component")
    dealt = dealt.join(sets.select("id", F.col("n_shingles").alias("n"), "parity", "bands"), "id")
    limit = (100 - config.threshold) / (100 + config.threshold)

    def cross(bucket, ids, components, n, bits, bands) -> Iterator[pa.RecordBatch]:
        order = np.argsort(n, kind="stable")
        ids, components, n, bits, bands = ids[order], components[order], n[order], bits[order], bands[order]
        for at in range(0, len(ids), 256):
            end = min(len(ids), at + 256)
            a, b = [], []
            for i in range(at, end):
                upto = int(np.searchsorted(n, n[i] * 100 / config.threshold + 1e-9, side="right"))  # longer sets can't be near
                later = np.arange(i + 1, upto)
                later = later[components[i + 1 : upto] != components[i]]
                if len(later):
                    differ = np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    later = later[differ <= (n[later] + n[i]) * limit + 1e-9]
                    first = (bands[later] == bands[i]).argmax(axis=1)  # a pair leaves from its first shared bucket only
                    later = later[bands[i][first] == bucket[0]]
                    a.append(np.minimum(ids[later], ids[i]))
                    b.append(np.maximum(ids[later], ids[i]))
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the members of the last cell, which may go on in the next batch

        def meet() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            if len(columns[0]) > 1:
                yield from cross(*columns)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, bucket, ids, components, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            bits, bands = (batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1) for i in (5, 6))
            bucket = bucket.view(np.uint64)
            edge = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if last is not None and cell[s] != last:
                    yield from meet()
                    held.clear()
                last = cell[s]
                held.append((bucket[s:e], ids[s:e], components[s:e], n[s:e], bits[s:e], bands[s:e]))
        if held:
            yield from meet()

    dealt = dealt.select("cell", "bucket", "id", "component", "n", "parity", "bands")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked if their sets of distinct ``words``-word shingles have a Jaccard similarity of
    at least ``threshold`` percent; a text of fewer words has its whole sequence as its one shingle.
    component_id: the smallest doc_id in reach by links; kept: doc_id = component_id. Texts that are
    null, empty or without words have 0 shingles and no links. Rows of equal sets are one item
    throughout, so copies are never paired. A null doc_id has no component_id and is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.keep(signatures(docs, config))
    sets = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first_doc"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n_shingles"))
    sets = scratch.keep(sets.withColumn("id", F.monotonically_increasing_id()))
    holders = sets.select("id", "set_key", "first_doc")

    def check(pairs: DataFrame) -> DataFrame:
        def differ(column: str, bits: int):
            parts = [F.bit_count(F.get(f"{column}_a", F.lit(i)).bitwiseXOR(F.get(f"{column}_b", F.lit(i)))) for i in range(bits // 64)]
            return reduce(lambda x, y: x + y, parts)

        sketch = sets.select("id", "sketch", "parity", F.col("n_shingles").alias("n"))
        near = pairs.join(sketch.withColumnsRenamed({"id": "a", "sketch": "sketch_a", "parity": "parity_a", "n": "n_a"}), "a")
        near = near.join(sketch.withColumnsRenamed({"id": "b", "sketch": "sketch_b", "parity": "parity_b", "n": "n_b"}), "b")
        possible = differ("parity", config.set_bits) * (100 + config.threshold) <= (F.col("n_a") + F.col("n_b")) * (100 - config.threshold)
        near = scratch.keep(near.where((differ("sketch", config.bits) <= config.most_bits) & possible).select("a", "b"))
        if near.isEmpty():
            return near
        ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(holders, "id")
        texts = scratch.keep(docs.select(F.col("doc_id").alias("first_doc"), "text").join(ends, "first_doc").select("id", F.col("set_key").alias("key"), "text"))
        left = texts.withColumnsRenamed({"id": "a", "key": "key_a", "text": "text_a"})
        right = texts.withColumnsRenamed({"id": "b", "key": "key_b", "text": "text_b"})
        return _confirmed(near.join(left, "a").join(right, "b"), config).distinct()

    linked = link_components(sets.select(F.explode("bands").alias("bucket"), "id"), check, scratch, lambda members: _possible(members, sets, config))
    placed = holders.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    placed = scratch.keep(placed.join(lowest, "component").select("set_key", "component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs``, all columns, with one document of each group: the one of the smallest doc_id; of rows
    that repeat a doc_id in a group of several rows, one. Rows without words or id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), config).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text", F.lit(3)).alias("text_hash"))
    named = rows.where("own_id IS NOT NULL").join(found, F.col("own_id") == F.col("kept_id"), "left_semi").dropDuplicates(["own_id", "text_hash"])
    out = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return named.select(*out).unionByName(rows.where("own_id IS NULL").select(*out))
