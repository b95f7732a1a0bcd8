"""Filters, reports of failed filters, deduplication and seeded sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def length_filter(text: Column, low: int = 5, high: int = 200) -> Column:
    return X.word_count(text).between(low, high)


def keyword_filter(text: Column, blocked: tuple[str, ...] = X.BLOCKED) -> Column:
    low = F.lower(text)
    out = F.lit(True)
    for word in blocked:
        out = out & ~F.contains(low, F.lit(word.lower()))
    return out


def punctuation_filter(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)^[^\w\s]"))


def english_start_filter(text: Column) -> Column:
    return F.rlike(text, F.lit("^[A-Za-z]"))


FILTERS: dict[str, Callable[..., Column]] = {"length": length_filter, "keyword": keyword_filter, "punctuation": punctuation_filter, "non_english": english_start_filter}


def register_filter(name: str, function: Callable[..., Column]) -> None:
    FILTERS[name] = function


def failed_filters(text: Column, names: tuple[str, ...], first_only: bool = False) -> Column:
    """Names of the filters that reject the text, in order."""
    failed = F.array_compact(F.array(*[F.when(~FILTERS[n](text), F.lit(n)) for n in names]))
    return F.slice(failed, 1, 1) if first_only else failed


def all_at_least(scores: Column, thresholds: dict[str, float]) -> Column:
    """Whether each named score reaches its threshold; a missing one fails the job."""
    out = F.lit(True)
    for name, least in thresholds.items():
        out = out & (F.coalesce(scores[name], F.raise_error(F.lit(f"no score {name}")).cast("double")) >= least)
    return out


def first_by_key(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``; combined before the shuffle, so a hot key is no task's burden."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select(*[k.alias(n) for k, n in zip(key, names, strict=True)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(*order).alias("_order"))
    return keyed.groupBy(*names).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows by the smallest hashes of key and seed: the same in every run, without a full sort."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def strict_then_relaxed(df: DataFrame, key: str | None, strict: Column, relaxed: Column) -> DataFrame:
    """Rows that pass ``strict``; for keys without any, rows that pass ``relaxed``. Without a key all rows are one.

    Which keys have a strict row is an aggregate, joined back; rows of a key never meet in one task.
    """
    marked = df.withColumns({"_s": F.coalesce(strict, F.lit(False)), "_r": F.coalesce(relaxed, F.lit(False))}).where("_s OR _r")
    if key is None:
        some = marked.agg(F.coalesce(F.bool_or("_s"), F.lit(False)).alias("_any"))
        return marked.join(F.broadcast(some)).where("_s OR NOT _any").drop("_s", "_r", "_any")  # one row
    having = marked.where("_s").select(F.col(key).alias("_key"), F.lit(True).alias("_any")).distinct()
    return marked.join(having, marked[key].eqNullSafe(having["_key"]), "left").where("_s OR _any IS NULL").drop("_s", "_r", "_key", "_any")


def sentence_triples(docs: DataFrame) -> DataFrame:
    """(doc_id, i, premise, middle, conclusion): neighbouring sentences of which the first two have more than 10 characters.

    The sentences are split once: they are exploded with their place, and a triple is three rows of a window.
    """
    from pyspark.sql import Window

    split = docs.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("at", "s")).select("doc_id", "at", X.strip(F.col("s")).alias("s")).where("s <> ''")
    w = Window.partitionBy("doc_id").orderBy("at")
    found = split.select("doc_id", (F.row_number().over(w) - 1).alias("i"), F.col("s").alias("premise"), F.lead("s", 1).over(w).alias("middle"), F.lead("s", 2).over(w).alias("conclusion"))
    return found.where("conclusion IS NOT NULL AND length(premise) > 10 AND length(middle) > 10")
