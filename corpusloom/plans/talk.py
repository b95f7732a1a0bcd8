"""Conversations: windows, scores and training formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import conversation as W
from corpusloom.operators import evaluate as V
from corpusloom.plans import register
from corpusloom.session import table


def _talk(spark, d):
    return table(spark, d, "conversations")


@register("w02_keep_last", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, min(turn) OVER (PARTITION BY conv_id) AS lo FROM conversations) WHERE rn <= 2 OR (turn = lo AND role IN ('system', 'developer'))")
def w02(spark, d):
    return W.keep_last(_talk(spark, d), 2).select("conv_id", "turn")


@register("w03_recency", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 1.0::DOUBLE ELSE round(pow(0.9::DOUBLE, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC)), 9) END AS score FROM conversations")
def w03(spark, d):
    return _talk(spark, d).select("conv_id", "turn", F.round(W.recency_score(F.col("role")), 9).alias("score"))


@register("w10_context", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role IN ('system', 'developer') THEN 0 ELSE 1 END, turn) AS position FROM conversations")
def w10(spark, d):
    return W.context_order(_talk(spark, d)).select("conv_id", "turn", "position")


@register("w05_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def w05(spark, d):
    e = table(spark, d, "events").withColumn("seen", F.when(F.col("event_type") == "click", F.col("event_id")))
    return W.forward_fill(e, "user_id", "event_id", "seen").select("event_id", "seen")


@register("w08_budget", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 500")
def w08(spark, d):
    return W.running_budget(_talk(spark, d), "conv_id", "turn", F.length("text"), 500).select("conv_id", "turn")


@register("p21_flow", "WITH l AS (SELECT conv_id, role, lag(role) OVER w AS b, lag(text) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, bool_and(CASE WHEN b IS NULL THEN role IN ('system', 'user') WHEN role = 'tool' THEN b = 'assistant' AND contains(s, '<tool_call>') WHEN role = 'assistant' THEN b IN ('user', 'tool') ELSE true END) AS valid FROM l GROUP BY conv_id")
def p21(spark, d):
    return W.valid_flow(_talk(spark, d))


@register("c01_alpaca", "WITH s AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) FILTER (role IN ('user', 'assistant')) AS m, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS sys FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(sys || chr(10), '') || m[1].t AS instruction, '' AS input, m[2].t AS output FROM s WHERE len(m) = 2 AND m[1].r = 'user' AND m[2].r = 'assistant'")
def c01(spark, d):
    return W.to_alpaca(_talk(spark, d))


@register("c02_sharegpt", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'tool' THEN 'observation' ELSE role END || ':' || text, chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id")
def c02(spark, d):
    turns = F.transform("conversations", lambda x: F.concat(x["from"], F.lit(":"), x["value"]))
    return W.to_sharegpt(_talk(spark, d)).select("conv_id", F.array_join(turns, "\n").alias("conversation"))


@register("x27_message_tokens", "SELECT conv_id, CAST(sum(3 + (length(text) + 3) // 4) + 3 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def x27(spark, d):
    return _talk(spark, d).groupBy("conv_id").agg((F.sum(3 + F.floor((F.length("text") + 3) / 4)) + 3).cast("long").alias("tokens"))


@register("a22_reassemble", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def a22(spark, d):
    pieces = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return _talk(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x.text), "\n").alias("text"))


@register("r26_topic", "SELECT conv_id, arg_max(text, turn) AS topic FROM conversations WHERE role = 'user' GROUP BY conv_id")
def r26(spark, d):
    return _talk(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("topic"))


@register("e01_answers", "SELECT o_orderkey, (o_orderkey % 3 <> 0) AS same FROM orders")
def e01(spark, d):
    key = F.col("o_orderkey").cast("string")
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.concat(key, F.lit("1"))).otherwise(F.concat(F.lit("$"), key))
    return table(spark, d, "orders").select("o_orderkey", V.same_answer(answer, key).alias("same"))
