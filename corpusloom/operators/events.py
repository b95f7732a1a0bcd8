"""Event logs: KPIs, trailing rate windows, change detection, task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def trailing_load(events: DataFrame, key: str, seconds: int, tokens: Column) -> DataFrame:
    """Adds requests and tokens of the ``seconds`` up to each event, per key."""
    w = Window.partitionBy(key).orderBy(_micros()).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumns({"requests": F.count(F.lit(1)).over(w), "tokens": F.sum(tokens).over(w)})


def event_kpis(events: DataFrame, key: str) -> DataFrame:
    """Per key: events, span in seconds and events a second (null for a span of 0)."""
    span = (F.max(_micros()) - F.min(_micros())) / 1e6
    out = events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), span.alias("span_s"))
    return out.withColumn("per_s", F.try_divide("n_events", "span_s"))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of (path, hash, mtime): new, deleted, or modified where hash or time differ."""
    a = old.select("path", F.col("hash").alias("h0"), F.col("mtime").alias("m0"), F.lit(True).alias("was"))
    b = new.select("path", F.col("hash").alias("h1"), F.col("mtime").alias("m1"), F.lit(True).alias("now"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("h0").eqNullSafe(F.col("h1")) | ~F.col("m0").eqNullSafe(F.col("m1")), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def ready_tasks(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(task_id) of open tasks whose dependencies (task_id, dep_id) are all done."""
    done = tasks.where("state = 'DONE'").select(F.col("task_id").alias("dep_id"))
    blocked = dependencies.join(done, "dep_id", "left_anti").select("task_id").distinct()
    return tasks.where("state = 'OPEN'").join(blocked, "task_id", "left_anti").select("task_id")


def latest_state(packets: DataFrame) -> DataFrame:
    """(task_id, status): the status of each task's last packet."""
    return packets.groupBy("task_id").agg(F.max_by("status", "ts").alias("status"))


def workforce_kpis(events: DataFrame) -> DataFrame:
    """Tasks created, completed, failed (and not completed) and pending of events (task_id, kind, ts), and completions a minute."""
    tasks = events.groupBy("task_id").agg(F.bool_or(F.col("kind") == "completed").alias("done"), F.bool_or(F.col("kind") == "failed").alias("bad"), F.min(_micros()).alias("a"), F.max(_micros()).alias("b"))
    out = tasks.agg(F.count(F.lit(1)).alias("created"), F.count_if("done").alias("completed"), F.count_if(F.col("bad") & ~F.col("done")).alias("failed"), F.count_if(~F.col("bad") & ~F.col("done")).alias("pending"), ((F.max("b") - F.min("a")) / 6e7).alias("minutes"))
    return out.select("created", "completed", "failed", "pending", F.try_divide("completed", "minutes").alias("per_minute"))


def auto_ready(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(task_id, decision): FAIL with a failed dependency (task_id, dep_state), READY if all are done; others wait and have no row."""
    states = dependencies.groupBy("task_id").agg(F.bool_or(F.col("dep_state") == "FAILED").alias("failed"), F.bool_and(F.col("dep_state") == "DONE").alias("done"))
    both = tasks.join(states, "task_id", "left")
    return both.select("task_id", F.when(F.coalesce("failed", F.lit(False)), "FAIL").when(F.coalesce("done", F.lit(True)), "READY").alias("decision")).where("decision IS NOT NULL")


def fork_join(branches: DataFrame, join: str) -> DataFrame:
    """Edges (task_id, dep_id) of parallel branches, and of a task that waits for all of them."""
    return branches.unionByName(branches.select("task_id").distinct().select(F.lit(join).alias("task_id"), F.col("task_id").alias("dep_id")))


def new_tasks(pieces: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """(key, order, i, content): the <task> elements that a text, growing piece by piece, completes with each piece.

    A tag may be cut between pieces. Elements are found once in the whole text of a key; each belongs to the first piece
    that reaches its end, found by one window over the ends of both.
    """
    whole = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), "").alias("_text"))
    parts = whole.select(key, F.posexplode(F.split("_text", "</task>")).alias("_n", "_part"))
    w = Window.partitionBy(key).orderBy("_n")
    ended = parts.withColumns({"_end": F.sum(F.length("_part") + 7).over(w), "_last": F.lead("_n").over(w).isNull()}).where(~F.col("_last") & F.contains("_part", F.lit("<task>")))
    content = strip(F.substring("_part", F.instr("_part", "<task>") + 6, F.length("_part")))
    found = ended.select(key, "_end", F.lit(0).alias("_kind"), F.lit(None).cast(pieces.schema[order].dataType).alias(order), (F.row_number().over(w) - 1).alias("i"), content.alias("content"))
    ends = pieces.select(key, F.sum(F.length(piece)).over(Window.partitionBy(key).orderBy(order)).alias("_end"), F.lit(1).alias("_kind"), order, F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("content"))
    ahead = Window.partitionBy(key).orderBy("_end", "_kind", order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = found.unionByName(ends).withColumn("_at", F.first(order, ignorenulls=True).over(ahead))
    return both.where("_kind = 0").select(key, F.col("_at").alias(order), "i", "content")


def race(calls: DataFrame) -> DataFrame:
    """(call, model): the successful model (ok) of least latency for each call."""
    return calls.where("ok").groupBy("call").agg(F.min_by("model", F.struct("latency", "model")).alias("model"))


def balance(calls: DataFrame, key: str, order: str, models: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return calls.withColumn("model", (rn % models).cast("long"))
