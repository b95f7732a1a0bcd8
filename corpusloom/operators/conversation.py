"""Windows over conversations and conversion to training formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = ("system", "developer")


def _protected(role: Column) -> Column:
    return role.isin(*PROTECTED)


def keep_last(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` unprotected messages of each conversation (0: all), and a protected first one."""
    w = Window.partitionBy("conv_id")
    tail = F.row_number().over(w.orderBy(F.desc("turn")))
    first = F.min("turn").over(w)
    keep = (F.col("_tail") <= n) | ((F.col("turn") == F.col("_first")) & _protected(F.col("role")))
    out = messages.withColumns({"_tail": tail, "_first": first})
    return (out.where(keep) if n else out).drop("_tail", "_first")


def recency_score(role: Column, keep_rate: float = 0.9) -> Column:
    """``keep_rate`` to the number of unprotected messages from this one to the newest; protected ones have 1."""
    newer = F.sum(F.when(_protected(role), 0).otherwise(1)).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(_protected(role), F.lit(1.0)).otherwise(F.pow(F.lit(keep_rate), newer))


def context_order(messages: DataFrame) -> DataFrame:
    """Position in the context: protected messages first, then by turn."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.when(_protected(F.col("role")), 0).otherwise(1), "turn"))
    return messages.withColumn("position", order.cast("long"))


def to_alpaca(messages: DataFrame) -> DataFrame:
    """(conv_id, instruction, input, output) of conversations with exactly one user and one assistant message."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    conv = messages.groupBy("conv_id").agg(ordered.alias("m"))
    said = F.filter("m", lambda x: x.role.isin("user", "assistant"))
    system = F.array_join(F.transform(F.filter("m", lambda x: x.role == "system"), lambda x: x.text), "\n")
    conv = conv.select("conv_id", said.alias("s"), system.alias("system"))
    pair = (F.size("s") == 2) & (F.get("s", F.lit(0)).role == "user") & (F.get("s", F.lit(1)).role == "assistant")
    text = F.concat(F.col("system"), F.when(F.col("system") != "", "\n").otherwise(""), F.get("s", F.lit(0)).text)
    return conv.where(pair).select("conv_id", text.alias("instruction"), F.lit("").alias("input"), F.get("s", F.lit(1)).text.alias("output"))


def sharegpt_role(role: Column) -> Column:
    return F.when(role == "user", "human").when(role == "assistant", "gpt").when(role.isin("tool", "function"), "observation").otherwise(role)


def to_sharegpt(messages: DataFrame) -> DataFrame:
    """(conv_id, conversations): all turns in order as (from, value)."""
    turns = F.array_sort(F.collect_list(F.struct("turn", sharegpt_role(F.col("role")).alias("from"), F.col("text").alias("value"))))
    conv = messages.groupBy("conv_id").agg(turns.alias("t"))
    return conv.select("conv_id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def valid_flow(messages: DataFrame) -> DataFrame:
    """(conv_id, valid): starts with system or human; tool follows a gpt tool call; gpt follows human or tool."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before, said = F.lag("role").over(w), F.lag("text").over(w)
    role = F.col("role")
    fine = F.when(before.isNull(), role.isin("system", "user")).when(role == "tool", (before == "assistant") & F.contains(said, F.lit("<tool_call>"))).when(role == "assistant", before.isin("user", "tool")).otherwise(F.lit(True))
    return messages.withColumn("_fine", fine).groupBy("conv_id").agg(F.bool_and("_fine").alias("valid"))


def forward_fill(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def running_budget(df: DataFrame, key: str, order: str, size: Column, limit: int) -> DataFrame:
    """Rows in order until the sizes first exceed ``limit``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= limit)


def without_calls(messages: DataFrame) -> DataFrame:
    """Without tool messages and assistant messages that call a tool."""
    call = (F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))
    return messages.where(~F.col("role").isin("tool", "function") & ~call)


def pop_last(messages: DataFrame, n: int) -> DataFrame:
    """All messages with ``kept``: false for the last ``n`` unprotected ones of each conversation."""
    free = ~_protected(F.col("role"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.when(free, 0).otherwise(1), F.desc("turn")))
    return messages.withColumn("kept", ~free | (rank > n))


def sharegpt_rows(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, from, value, call): assistant messages with exactly one tool call are function_call rows and name the tool."""
    from corpusloom.functions.parse import hermes_calls

    calls = hermes_calls(F.col("text"))
    one = (F.col("role") == "assistant") & (F.size(calls) == 1)
    call = F.when(one, F.get(calls, F.lit(0))["name"])
    return messages.select("conv_id", "turn", F.when(one, "function_call").otherwise(sharegpt_role(F.col("role"))).alias("from"), F.col("text").alias("value"), call.alias("call"))


def normalised(messages: DataFrame, system: str) -> DataFrame:
    """(conv_id, turn, from, value); conversations without a system message get ``system`` as turn -1."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), sharegpt_role(F.col("role")).alias("from"), F.col("text").alias("value"))
    bare = messages.groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("has")).where("NOT has")
    return rows.unionByName(bare.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("from"), F.lit(system).alias("value")))


def to_records(messages: DataFrame) -> DataFrame:
    """(conv_id, record): each message as JSON."""
    return messages.select("conv_id", F.to_json(F.struct("turn", "role", F.col("text").alias("content"))).alias("record"))


def from_records(records: DataFrame) -> DataFrame:
    parsed = records.select("conv_id", F.from_json("record", "turn long, role string, content string").alias("r"))
    return parsed.select("conv_id", "r.turn", "r.role", F.col("r.content").alias("text"))


def history(recorded: DataFrame, memory: DataFrame) -> DataFrame:
    """Recorded messages of the conversations that have any, those of memory for the others."""
    return recorded.unionByName(memory.join(recorded.select("conv_id").distinct(), "conv_id", "left_anti"))
