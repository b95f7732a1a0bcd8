"""Exact length histograms of tokenised documents."""

from __future__ import annotations

import hashlib
import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
_LONG_RUN = re.compile(r"\s{4000}")


def _encoder(ranks_file: bytes) -> Callable[[str], int]:
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(PATTERN)

    def count(text: str) -> int:
        if len(text) >= 4000 and _LONG_RUN.search(text):  # the library's own splitter overflows its stack on these
            return sum(len(encoding._encode_single_piece(p)) if p.isspace() and len(p) > 1 else len(encoding.encode_ordinary(p)) for p in split.findall(text))
        return len(encoding.encode_ordinary(text))

    return count


_ENCODERS: dict[str, Callable[[str], int]] = {}  # of a worker, by digest of the vocabulary; one is kept


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens) of each row of ``docs``: whole texts, encoded as ordinary text.

    A null text counts as empty: 0 tokens. The vocabulary is read on the driver and broadcast; a
    file above ``MAX_VOCABULARY_BYTES`` is refused. Other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = _encoder(shared.value)
        count = _ENCODERS[key]
        for batch in batches:
            lengths = [count(t.decode("utf-8", "replace")) if t else 0 for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), one row for each length that occurs; sums are made before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each occurring length L, what a context limit of L tokens means.

    n_docs: documents of that length; docs_over, tokens_over: those longer and their tokens (suffix
    sums); total_tokens: of all; truncated_tokens: sum of min(length, L); quantile: share of
    documents of length <= L. An empty histogram gives no rows. The window runs over one row per
    distinct length, of which there are at most as many as the longest document has tokens.
    """
    before = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    over = F.coalesce(F.sum("n_docs").over(after), F.lit(0))
    return histogram.select(
        "n_tokens",
        "n_docs",
        over.alias("docs_over"),
        F.coalesce(F.sum(tokens).over(after), F.lit(0)).alias("tokens_over"),
        F.sum(tokens).over(everything).alias("total_tokens"),
        (F.sum(tokens).over(before) + F.col("n_tokens") * over).alias("truncated_tokens"),
        (F.sum("n_docs").over(before) / F.sum("n_docs").over(everything)).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` (context_limit) with total_tokens, truncated_tokens and docs_over, for any limits, occurring or not.

    Histogram and limits are each one row per distinct value; the suffix sums are looked up by a
    merge of both on the length axis (one sort), not by comparing each pair.
    """
    both = histogram.select("n_tokens", "n_docs", F.lit(None).cast("long").alias("context_limit")).unionByName(
        limits.select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"), F.col("context_limit").cast("long"))
    )
    upto = Window.orderBy("n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = both.select(
        "context_limit",
        F.sum(tokens).over(total).alias("total_tokens"),
        (F.sum(tokens).over(upto) + F.col("context_limit") * (F.sum("n_docs").over(total) - F.sum("n_docs").over(upto))).alias("truncated_tokens"),
        (F.sum("n_docs").over(total) - F.sum("n_docs").over(upto)).alias("docs_over"),
    )
    return out.where("context_limit IS NOT NULL")


def token_length_table(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return context_table(length_histogram(token_lengths(docs, vocabulary)))
