"""The limiter as a running state and the endless source, across restarts."""

import glob
import json

from pyspark.sql import functions as F

from corpusloom.session import table
from corpusloom.streaming import endless, limiter
from corpusloom.streaming.events import append_batches, read_events
from corpusloom.streaming.limiter import Limits
from tests.conftest import DATA

S = limiter.MICROS


def plain(requests, limits):
    """Grants by one pass over all requests in order, with whole histories."""
    out, held = {}, {}
    for domain, ts, event_id, provider, model, tokens in sorted(requests, key=lambda r: (r[1], r[2])):
        now = ts
        for key, (most, most_tokens) in (((domain,), limits.domain), ((domain, provider), limits.provider), ((domain, provider, model), limits.model)):
            own = held.setdefault(key, [])
            now = max([now, *(g for g, _ in own)])
            inside = [(g, t) for g, t in own if g >= now - 60 * S]
            waits = [0]
            if most and len(inside) >= most:
                waits.append(inside[0][0] + 60 * S - now)
            if most_tokens and sum(t for _, t in inside) + tokens > most_tokens:
                waits.append(inside[0][0] + 60 * S - now if inside else S)
            now += max(waits)
            own.append((now, max(1, tokens)))
        out[event_id] = (now, now - ts)
    return out


def fixture():
    rows = []
    for i in range(120):
        rows.append((f"d{i % 3}", 1_700_000_000 * S + (i * 7 % 40) * S + i, i, "p" if i % 2 else "q", f"m{i % 5}", 100 + 37 * (i % 11)))
    return rows + [("d0", 1_700_000_300 * S + i, 500 + i, "p", "m0", 900) for i in range(9)]


LIMITS = Limits((12, 9000), (8, 5000), (4, 2000))


def requests_of(spark, rows):
    df = spark.createDataFrame(rows, "domain string, micros long, event_id long, provider string, model string, tokens long")
    return df.select("domain", F.timestamp_micros("micros").alias("ts"), "event_id", "provider", "model", "tokens")


def test_batch_limiter_is_the_plain_simulation(spark):
    rows = fixture()
    got = {r.event_id: (r.granted, r.waited) for r in limiter.limited(requests_of(spark, rows), LIMITS).collect()}
    want = plain(rows, LIMITS)
    assert got == want and max(w for _, w in want.values()) > 30 * S and min(w for _, w in want.values()) == 0


def test_limiter_over_events(spark):
    from corpusloom.plans.streams import LIMITS as limits
    from corpusloom.plans.streams import limiter_requests

    requests = limiter_requests(table(spark, f"{DATA}/sf0.001", "events"))
    rows = [(r.domain, r.micros, r.event_id, r.provider, r.model, r.tokens) for r in limiter._micros(requests).collect()]
    got = {r.event_id: (r.granted, r.waited) for r in limiter.limited(requests, limits).collect()}
    assert got == plain(rows, limits) and any(w for _, w in got.values())


def test_stream_limiter_across_a_restart(spark, tmp_path):
    rows = sorted(fixture(), key=lambda r: r[1])
    end = [("end", 1_700_009_000 * S, 900, "p", "m", 1), ("end", 1_700_019_000 * S, 901, "p", "m", 1)]
    path, out, kept = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    schema = "domain string, ts timestamp, event_id long, provider string, model string, tokens long"
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limiter.ROCKS)
    try:
        for i, part in enumerate((rows[:50], rows[50:100], rows[100:] + end)):
            requests_of(spark, part).coalesce(1).write.mode("append").parquet(path)
            stream = read_events(spark, path, schema, files_per_trigger=1)
            append_batches(limiter.limited_stream(stream, LIMITS, "30 seconds"), out, kept).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    found = spark.read.parquet(out).where("domain <> 'end'").collect()
    assert len(found) == len(rows)
    assert {r.event_id: (r.granted, r.waited) for r in found} == plain(rows, LIMITS)


def test_endless_source_across_a_restart(spark, tmp_path):
    seeds = table(spark, f"{DATA}/sf0.001", "part").select("p_partkey", "p_name")
    out, kept = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for total in (500, 1300):
        stream = endless.drawn(endless.endless(spark, refill=250, rowsPerTrigger=300, total=total), seeds, "p_partkey")
        query = endless.flush_blocks(stream, out, kept)
        query.processAllAvailable()
        query.stop()
    files = glob.glob(f"{out}/batch=*/*.json")
    read = [[json.loads(line) for line in open(f)] for f in files]
    assert all(len(f) == 100 and len({r["block"] for r in f}) == 1 for f in read)
    rows = sorted((r for f in read for r in f), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(1300))
    keys = sorted(r.p_partkey for r in seeds.collect())
    assert [r["p_partkey"] for r in rows[: len(keys)]] == keys
    assert all(r["p_partkey"] == keys[r["draw"] % len(keys)] for r in rows[len(keys) :])
    assert len({f.split("batch=")[1].split("/")[0] for f in files}) > 3


def test_a_task_reads_and_writes_many_blocks(spark, tmp_path):
    """13,000 rows in one batch are 130 files of a block each, but three tasks, and as many spans of the source."""
    assert len(endless._Reader({"total": 13_000}).partitions({"row": 0}, {"row": 13_000})) == 3
    seeds = table(spark, f"{DATA}/sf0.001", "part").select("p_partkey", "p_name")
    stream = endless.drawn(endless.endless(spark, refill=250, rowsPerTrigger=13_000, total=13_000), seeds, "p_partkey")
    query = endless.flush_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    files = glob.glob(f"{tmp_path}/out/batch=*/*.json")
    read = [[json.loads(line) for line in open(f)] for f in files]
    assert len(files) == 130 and all(len(f) == 100 and len({r["block"] for r in f}) == 1 for f in read)
    assert sorted(r["row"] for f in read for r in f) == list(range(13_000))
    assert len({f.split("/part-")[1].split("-")[0] for f in files}) <= 3
