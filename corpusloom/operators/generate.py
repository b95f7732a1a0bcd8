"""Loops that generate, score and filter; the model is a function from DataFrame to DataFrame, so any UDF can stand in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.curate import FILTERS, failed_filters
from corpusloom.operators.sets import hash_order, rouge_rejects
from corpusloom.session import Scratch

Model = Callable[[DataFrame], DataFrame]


def self_instruct(seeds: DataFrame, model: Model, wanted: int, filters: tuple[str, ...] = ("length", "keyword", "punctuation", "non_english"), per_round: int = 8, most_rounds: int = 20, threshold: float = 0.7) -> DataFrame:
    """(id, text) of at least ``wanted`` instructions if ``most_rounds`` suffice. Each round samples ``per_round`` texts of what
    there is, lets the model write (id, text) rows from them, and keeps those that pass the filters and resemble none before."""
    scratch = Scratch(seeds.sparkSession)
    pool, made = seeds.select("id", "text"), None
    for at in range(most_rounds):
        sample = pool.orderBy(hash_order(at, "id"), "id").limit(per_round)
        new = model(sample.withColumn("round", F.lit(at))).select("id", "text").dropDuplicates(["text"])
        new = scratch.keep(new.where(F.size(failed_filters(F.col("text"), filters)) == 0))
        new = scratch.keep(new.join(rouge_rejects(new, pool, threshold), "id", "left_anti"))
        pool = pool.unionByName(new)
        made = new if made is None else made.unionByName(new)
        if made.count() >= wanted:
            break
    return made


def evolve(prompts: DataFrame, model: Model, score: Column, rounds: int = 1) -> DataFrame:
    """(id, text, generation): each round the model writes candidates (id, place, text) for each prompt; the one of the
    greatest score, first of equals, is the next generation's prompt."""
    now = prompts.select("id", "text").withColumn("generation", F.lit(0))
    out = now
    for at in range(1, rounds + 1):
        made = model(now.select("id", "text", "generation"))
        best = made.withColumn("score", score).groupBy("id").agg(F.max_by("text", F.struct("score", -F.col("place"))).alias("text"))
        now = best.withColumn("generation", F.lit(at))
        out = out.unionByName(now)
    return out


def rejection_sample(tries: DataFrame, scores: tuple[str, ...], least: float) -> DataFrame:
    """(id, text, passed): of each problem's tries (id, place, text, scores), the passing one of the best mean score, else the best of all."""
    mean = sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)
    passed = F.lit(True)
    for s in scores:
        passed = passed & (F.col(s) >= least)
    return tries.groupBy("id").agg(F.max_by(F.struct("text", passed.alias("passed")), F.struct(passed, mean, -F.col("place"))).alias("x")).select("id", "x.*")


def first_error(steps: DataFrame) -> DataFrame:
    """(id, first_bad): place of the first wrong step (id, place, ok) of each solution; null if all are right."""
    return steps.groupBy("id").agg(F.min(F.when(~F.col("ok"), F.col("place"))).alias("first_bad"))


def step_search(questions: DataFrame, answer: Model, verify: Model, score: Model, most_tries: int = 100, enough: float = 0.9, in_place: bool = False) -> DataFrame:
    """(id, solution, how, error_position, tries) of each question (id, question).

    A direct answer that holds is taken. Else up to ``most_tries`` answers, each begun from the best so far, are scored until one
    exceeds ``enough``; failing that the first wrong sentence of the best is sought by halving and the answer is written anew from the part
    before it. All open questions go through each step together: a model call a round, not one a question or a sentence.
    ``answer`` turns (id, question, start, round) into (id, solution); ``verify`` (id, question, solution) into (id, ok); ``score``
    the same into (id, score), null where it failed, which counts as a try only. Sentences end with a full stop of either width.
    ``how`` is direct, early, whole (the best holds after all) or rewritten; ``error_position`` is null but for the last.
    ``in_place`` says that the models keep every row and column they are given, more than those named too, and add their own: then nothing is joined, and a round is
    written once.
    """
    scratch = Scratch(questions.sparkSession)
    settle = scratch.keep if in_place else lambda df: df
    ended = lambda df, how, at, tries: df.select("id", "solution", F.lit(how).alias("how"), at.cast("int").alias("error_position"), tries.cast("int").alias("tries"))
    none = F.lit(None)
    asked = lambda df, start, at: df.withColumns({"start": start, "round": F.lit(at)})
    base = questions.select("id", "question")
    first = _told(asked(base if in_place else scratch.keep(base), F.lit(""), 0), answer, "solution", scratch, in_place, "inner")
    first = settle(_told(first, verify, "ok", scratch, in_place).select("id", "question", "solution", F.coalesce("ok", F.lit(False)).alias("ok")))
    done = ended(first.where("ok"), "direct", none, F.lit(0))
    now = first.where(~F.col("ok")).select("id", "question", F.lit("").alias("best"), F.lit(0.0).alias("top"))
    for at in range(1, most_tries + 1):
        if now.isEmpty():
            break
        tried = _told(_told(asked(now, F.col("best"), at), answer, "solution", scratch, in_place), score, "score", scratch, in_place)
        good = F.coalesce(F.col("score") > enough, F.lit(False))
        better = F.coalesce(F.col("score") > F.col("top"), F.lit(False))
        best = F.when(good | better, F.col("solution")).otherwise(F.col("best"))
        tried = settle(tried.select("id", "question", best.alias("best"), F.when(better, F.col("score")).otherwise(F.col("top")).alias("top"), good.alias("good")))
        done = done.unionByName(ended(tried.where("good").withColumnRenamed("best", "solution"), "early", none, F.lit(at)))
        now = tried.where(~F.col("good")).drop("good")
    tries = F.lit(most_tries)
    held = _told(now.select("id", "question", F.col("best").alias("solution")), verify, "ok", scratch, in_place)
    held = settle(held.withColumn("ok", F.coalesce("ok", F.lit(False))))
    done = done.unionByName(ended(held.where("ok"), "whole", none, tries))
    wrong = first_wrong_sentence(held.where(~F.col("ok")).drop("ok"), verify, scratch, in_place)
    wrong = wrong if in_place else scratch.keep(wrong)
    part = F.concat(F.array_join(F.slice(F.split("solution", r"\. "), F.lit(1), F.col("error_position")), ". "), F.lit("."))
    again = _told(asked(wrong, part, most_tries + 1).drop("solution"), answer, "solution", None, in_place)
    return done.unionByName(ended(again, "rewritten", F.col("error_position"), tries))


_GIVEN = {"solution": ("id", "question", "start", "round"), "ok": ("id", "question", "solution"), "score": ("id", "question", "solution")}


def _told(df: DataFrame, model: Model, name: str, scratch: Scratch | None, in_place: bool, how: str = "left") -> DataFrame:
    """``df`` with the model's column ``name``; a model that does not keep what it is given is joined back, and what it said is written before it is read again."""
    if in_place:
        return model(df).select(*df.columns, name)
    joined = df.join(model(df.select(*_GIVEN[name])).select("id", name), "id", how)
    return joined if scratch is None else scratch.keep(joined)


def first_wrong_sentence(solutions: DataFrame, verify: Model, scratch: Scratch | None = None, in_place: bool = False) -> DataFrame:
    """(id, question, solution, error_position): the number of sentences up to the first that makes a beginning of the solution fail.

    Every round checks the middle of all intervals that are still open, so there are log2 of the most sentences rounds. ``in_place`` is that of ``step_search``.
    """
    scratch = scratch or Scratch(solutions.sparkSession)
    pieces = F.filter(F.transform(F.split(F.translate("whole", "\u3002", "."), r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    now = scratch.keep(solutions.select("id", "question", F.col("solution").alias("whole")).withColumns({"lo": F.lit(0), "hi": F.size(pieces)}))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ok = F.coalesce("ok", F.lit(False))
    while not now.where("lo < hi").isEmpty():
        begun = now.where("lo < hi").withColumn("solution", F.concat(F.array_join(F.slice(pieces, F.lit(1), mid), ". "), F.lit(".")))
        probed = _told(begun, verify, "ok", None, in_place)
        halved = probed.select("id", "question", "whole", F.when(ok, mid + 1).otherwise(F.col("lo")).alias("lo"), F.when(ok, F.col("hi")).otherwise(mid).alias("hi"))
        after = scratch.keep(halved.unionByName(now.where("lo >= hi")))
        scratch.drop(now)
        now = after
    return now.select("id", "question", F.col("whole").alias("solution"), F.col("lo").alias("error_position"))


def verified_rows(model: Model, seeds: DataFrame, check: Column, wanted: int, most_tries: int = 10) -> DataFrame:
    """``wanted`` distinct rows (text) that pass ``check``; fewer after ``most_tries`` calls raise."""
    scratch = Scratch(seeds.sparkSession)
    held = None
    for at in range(most_tries):
        new = model(seeds.withColumn("round", F.lit(at))).select("text").where(check)
        held = scratch.keep((new if held is None else held.unionByName(new)).distinct())
        if held.count() >= wanted:
            return held.orderBy("text").limit(wanted)
    raise RuntimeError(f"fewer than {wanted} valid rows after {most_tries} tries")


def plugged(df: DataFrame, name: str, function: Callable[..., Column], keep: bool = False) -> DataFrame:
    """Registers a filter of the caller's and applies it: ``keep`` leaves the rows that pass, else they are marked."""
    FILTERS[name] = function
    passed = FILTERS[name](F.col("text"))
    return df.where(passed) if keep else df.withColumn("passed", passed)
