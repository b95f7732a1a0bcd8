"""A rate limiter of three nested levels as a running state: who waits how long.

Each request passes the level of its domain, then of its provider, then of its model there. A level grants at most so many requests and
tokens in any ``SECONDS``: one that finds it full waits until the oldest grant leaves that window. Requests of a level are
granted one after the other, in order of time, then id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECONDS = 60
MICROS = 1_000_000
SCHEMA = "domain string, event_id long, granted long, waited long, level string"


@dataclass(frozen=True)
class Limits:
    """Requests and tokens a window of each level (0: no limit)."""

    domain: tuple[int, int] = (60, 60_000)
    provider: tuple[int, int] = (40, 40_000)
    model: tuple[int, int] = (20, 20_000)


class Levels:
    """Grants of one domain within the last window, by level: [time, tokens] in microseconds, oldest first."""

    def __init__(self, limits: Limits, held: str | None = None):
        self.limits = limits
        self.held: dict[str, list[list[int]]] = json.loads(held) if held else {}

    def grant(self, ts: int, provider: str, model: str, tokens: int) -> tuple[int, str]:
        """The time of the grant, and the level that made it wait longest ("" for none)."""
        now, worst, at = ts, 0, ""
        for level, name, (requests, most) in (("domain", "", self.limits.domain), ("provider", provider, self.limits.provider), ("model", f"{provider}/{model}", self.limits.model)):
            own = self.held.setdefault(f"{level}:{name}", [])
            arrived = now
            now = max(now, own[-1][0] if own else 0)
            inside = [g for g in own if g[0] >= now - SECONDS * MICROS]
            wait = 0
            if 0 < requests <= len(inside):
                wait = inside[0][0] + SECONDS * MICROS - now
            if most > 0 and sum(g[1] for g in inside) + tokens > most:
                wait = max(wait, inside[0][0] + SECONDS * MICROS - now if inside else MICROS)
            now += wait
            self.held[f"{level}:{name}"] = [*inside, [now, max(1, tokens)]]
            if now - arrived > worst:
                worst, at = now - arrived, level
        return now, at

    def pack(self, now: int) -> str:
        """What later requests, none before ``now``, can still meet."""
        kept = {k: [g for g in v if g[0] >= now - SECONDS * MICROS] or v[-1:] for k, v in self.held.items()}
        return json.dumps({k: v for k, v in kept.items() if v[-1][0] >= now - SECONDS * MICROS})


def _rows(domain: str, levels: Levels, requests: list[tuple]) -> pd.DataFrame:
    out = []
    for ts, event_id, provider, model, tokens in requests:
        granted, level = levels.grant(ts, provider, model, tokens)
        out.append((domain, event_id, granted, granted - ts, level))
    return pd.DataFrame(out, columns=["domain", "event_id", "granted", "waited", "level"])


def limited(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(domain, event_id, granted, waited, level) of a table of requests (domain, ts, event_id, provider, model, tokens): microseconds.

    Requests are sorted within their partition and read as they come, so that a task holds the grants of one window only, however
    many requests a domain has. A domain's grants depend on each other, so a domain is one task's. Null tokens count as 0, null names as "".
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, levels = None, Levels(limits)
        for batch in batches:
            for name, part in batch.groupby("domain", sort=False):
                if name != domain:
                    domain, levels = name, Levels(limits)
                rows = list(part[["micros", "event_id", "provider", "model", "tokens"]].itertuples(index=False, name=None))
                yield _rows(domain, levels, rows)
                levels = Levels(limits, levels.pack(rows[-1][0]))

    return _micros(requests).repartition("domain").sortWithinPartitions("domain", "micros", "event_id").mapInPandas(run, SCHEMA)


def _micros(requests: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return requests.select(name("domain"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").cast("long").alias("event_id"), name("provider"), name("model"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))


class LimiterProcessor(StatefulProcessor):
    """Requests of a domain wait in a list until the watermark has passed them; a timer then grants them in order."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, event_id long, provider string, model string, tokens long")
        self.levels = handle.getValueState("levels", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = list(batch[["micros", "event_id", "provider", "model", "tokens"]].itertuples(index=False, name=None))
            self.waiting.appendList([tuple(r) for r in new])
            for at in {r[0] // 1000 + 1 for r in new}:
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] < until]
        if due:
            held = self.levels.get()
            levels = Levels(self.limits, held[0] if held else None)
            yield _rows(key[0], levels, due)
            self.levels.update((levels.pack(due[-1][0]),))
            left = [r for r in waiting if r[0] >= until]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, limits: Limits = Limits(), late: str = "1 minute") -> DataFrame:
    """``limited`` over a stream, in append mode: a request is answered once the watermark, ``late`` behind the newest, has passed it;
    later ones are dropped. State: the requests of the last ``late`` and the grants of one window. Needs the RocksDB state store."""
    rows = _micros(requests).withWatermark("ts", late)
    return rows.groupBy("domain").transformWithStateInPandas(LimiterProcessor(limits), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
