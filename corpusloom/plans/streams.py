"""The limiter over the event log, and rows of the endless source."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans import register
from corpusloom.session import shared_dir, table
from corpusloom.streaming import endless, limiter
from corpusloom.streaming.limiter import Limits

#: Few and small, so that requests wait: a user's events are days apart on the tables at hand, so a day passes as a minute.
LIMITS = Limits((6, 700), (4, 400), (2, 180))


def limiter_requests(events):
    """Events as requests: users are domains, types providers, the last digit of the id the model; props are the prompt. Time runs 1,440 times as fast."""
    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1440).cast("long"))
    return events.select(F.col("user_id").alias("domain"), fast.alias("ts"), "event_id", F.col("event_type").alias("provider"), (F.col("event_id") % 3).alias("model"), F.greatest(F.lit(1), F.floor((F.length("props") + 3) / 4)).cast("long").alias("tokens"))


def _limiter_sql(limits: Limits, window: int = 60_000_000) -> str:
    """Every user's requests one after the other, with the list of all earlier grants."""
    q = "SELECT e.d, e.i, e.ts AS g0, e.event_id, e.p, e.m, e.tok, r.hist FROM r JOIN e ON e.d = r.d AND e.i = r.i + 1"
    for k, (own, (most, tokens)) in enumerate((("true", limits.domain), ("h.p = p", limits.provider), ("h.p = p AND h.m = m", limits.model)), 1):
        q = f"SELECT *, greatest(g{k - 1}, coalesce(list_max(list_transform(list_filter(hist, lambda h: {own}), lambda h: h.g{k})), 0)) AS n{k} FROM ({q})"
        q = f"SELECT *, list_filter(hist, lambda h: {own} AND h.g{k} >= n{k} - {window}) AS s{k} FROM ({q})"
        free = f"s{k}[1].g{k} + {window} - n{k}"
        full = f"coalesce(list_sum(list_transform(s{k}, lambda h: h.tok)), 0) + tok > {tokens}"
        q = f"SELECT *, n{k} + greatest(0, CASE WHEN len(s{k}) >= {most} THEN {free} END, CASE WHEN {full} THEN CASE WHEN len(s{k}) > 0 THEN {free} ELSE 1000000 END END) AS g{k} FROM ({q})"
    step = f"SELECT d, i, event_id, CAST(g3 - g0 AS BIGINT) AS waited, CAST(g1 - g0 AS BIGINT) AS w1, CAST(g2 - g1 AS BIGINT) AS w2, CAST(g3 - g2 AS BIGINT) AS w3, list_append(hist, struct_pack(g1 := CAST(g1 AS BIGINT), g2 := CAST(g2 AS BIGINT), g3 := CAST(g3 AS BIGINT), p := p, m := m, tok := tok)) AS hist FROM ({q})"
    none = "CAST([] AS STRUCT(g1 BIGINT, g2 BIGINT, g3 BIGINT, p VARCHAR, m BIGINT, tok BIGINT)[])"
    level = "CASE WHEN waited = 0 THEN '' WHEN w1 >= w2 AND w1 >= w3 THEN 'domain' WHEN w2 >= w3 THEN 'provider' ELSE 'model' END"
    return f"""
WITH RECURSIVE q AS (SELECT user_id AS d, event_id, epoch_us(ts) // 1440 AS ts, coalesce(event_type, '') AS p, event_id % 3 AS m, greatest(1, (length(props) + 3) // 4) AS tok FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS i FROM q),
r AS (SELECT DISTINCT d, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS waited, CAST(0 AS BIGINT) AS w1, CAST(0 AS BIGINT) AS w2, CAST(0 AS BIGINT) AS w3, {none} AS hist FROM e UNION ALL {step})
SELECT CAST(d AS VARCHAR) AS domain, event_id, waited, {level} AS level FROM r WHERE i > 0
"""


@register("t01_limiter", _limiter_sql(LIMITS))
def t01_limiter(spark, d):
    """Waiting time of every event under three nested limits; tests hold it, and its stream, against a plain simulation."""
    return limiter.limited(limiter_requests(table(spark, d, "events")), LIMITS).select("domain", "event_id", "waited", "level")


@register("t08_endless")
def t08(spark, d):
    """Three rounds over the seed rows: the stream is read to its set end, flushed in blocks and read back."""
    import uuid

    seeds = table(spark, d, "part").select("p_partkey", "p_name")
    path = f"{shared_dir(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
    total = 3 * seeds.count()
    per = max(endless.BLOCK, total // 5)
    stream = endless.drawn(endless.endless(spark, refill=250, rowsPerTrigger=per, total=total), seeds, "p_partkey")
    query = endless.flush_blocks(stream, f"{path}/out", f"{path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return spark.read.schema("row long, block long, draw long, p_partkey long, p_name string").json(f"{path}/out").select("row", "block", "p_partkey")
