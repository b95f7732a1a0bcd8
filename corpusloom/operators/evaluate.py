"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch


def rmse(prediction: Column, truth: Column) -> Column:
    """Over pairs whose prediction is a number."""
    return F.sqrt(F.avg(F.when(~F.isnan(prediction), F.pow(prediction - truth, 2))))


def auroc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(auroc): rank statistic with middle ranks of ties; 0.5 without both classes.

    Scores are grouped first and dealt to ranges; a range's running counts start from the sum of the ranges before it, so
    no task orders all scores.
    """
    by = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(truth).isNotNull())
    by = by.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    ranges = Scratch(df.sparkSession).keep(by.repartitionByRange("s").withColumn("range", F.spark_partition_id()))
    before = ranges.groupBy("range").agg(F.sum("n").alias("held"))
    before = before.select("range", (F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")).alias("before"))  # one row for each range
    w = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranges.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.sum("n").over(w) - (F.col("n") - 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    pos, neg = F.col("pos"), F.col("neg")
    return total.select(F.coalesce(F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos.cast("double") * neg)), F.lit(0.5)).alias("auroc"))


def metric_stats(df: DataFrame, name: str, value: str) -> DataFrame:
    """(metric, value) rows: mean, population deviation, least and greatest of each name."""
    stats = df.groupBy(name).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return stats.selectExpr(f"stack(4, concat({name}, ':mean'), mean, concat({name}, ':std'), std, concat({name}, ':min'), min, concat({name}, ':max'), max) AS (metric, value)")


def accuracy(correct: Column) -> Column:
    return F.avg(correct.cast("double"))


def same_answer(answer: Column, truth: Column) -> Column:
    """Equal as numbers where the truth is one, element by element where it is a list, else as normalised text."""
    from corpusloom.functions.text import normalise_answer, normalise_number

    is_number = truth.try_cast("double").isNotNull()
    is_list = F.rlike(truth, F.lit("[,;]"))
    parts = lambda c: F.split(c, "[,;]")

    def one(a: Column, t: Column) -> Column:
        return F.when(t.try_cast("double").isNotNull(), normalise_number(a) == t.try_cast("double")).otherwise(normalise_answer(a) == normalise_answer(t))

    whole = (F.size(parts(answer)) == F.size(parts(truth))) & F.forall(F.zip_with(parts(answer), parts(truth), one), lambda ok: ok)
    return F.when(is_number, normalise_number(answer) == truth.try_cast("double")).when(is_list, whole).otherwise(normalise_answer(answer) == normalise_answer(truth))
