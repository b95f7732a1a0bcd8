"""Join-, aggregate- and graph-shaped operators over the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluate as V
from corpusloom.operators import events as T
from corpusloom.operators import graph as N
from corpusloom.plans import register
from corpusloom.session import dealt, table


@register("j01_left_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j01(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@register("j03_grid", "SELECT r_name, p_type FROM region, (SELECT DISTINCT p_type FROM part)")
def j03(spark, d):
    return table(spark, d, "region").select("r_name").join(F.broadcast(table(spark, d, "part").select("p_type").distinct()))


@register("j05_delta_wins", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 0.0::DOUBLE FROM orders WHERE o_orderkey % 10 = 0")
def j05(spark, d):
    from corpusloom.operators.vector import upsert

    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return upsert(orders, orders.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_orderkey")


@register("j06_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def j06(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@register("j10_file_changes", "WITH o AS (SELECT p_partkey AS path, p_brand AS h FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE p_brand END AS h FROM part WHERE p_partkey % 3 <> 0) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.h <> n.h")
def j10(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("hash"), F.lit(0).alias("mtime"))
    new = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 7 == 0, "changed").otherwise(F.col("p_brand")).alias("hash"), F.lit(0).alias("mtime"))
    return T.file_changes(old, new)


@register("j11_lateral_top", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def j11(spark, d):
    from corpusloom.operators.lexical import ranked

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return ranked(o, 3).select(F.col("qid").alias("o_custkey"), F.col("id").alias("o_orderkey"))


@register("a01_count_by_key", "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def a01(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@register("a02_exploded", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w")
def a02(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@register("a03_nested", "SELECT p_brand, p_type, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_size)))[1:5], ',') AS sizes FROM part GROUP BY p_brand, p_type")
def a03(spark, d):
    sizes = F.slice(F.array_sort(F.collect_set("p_size")), 1, 5)
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(sizes, lambda x: x.cast("string")), ",").alias("sizes"))


@register("a04_status", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS big FROM orders GROUP BY o_orderstatus")
def a04(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("big"))


@register("a07_metric_stats", "WITH s AS (SELECT event_type AS n, avg(value) AS a, stddev_pop(value) AS b, min(value) AS c, max(value) AS e FROM events GROUP BY 1) SELECT n || ':mean' AS metric, round(a, 6) AS value FROM s UNION ALL SELECT n || ':std', round(b, 6) FROM s UNION ALL SELECT n || ':min', round(c, 6) FROM s UNION ALL SELECT n || ':max', round(e, 6) FROM s")
def a07(spark, d):
    return V.metric_stats(table(spark, d, "events"), "event_type", "value").select("metric", F.round("value", 6).alias("value"))


@register("a08_rmse", "SELECT round(sqrt(avg(pow(n_chars / 10000.0::DOUBLE - quality, 2))), 6) AS rmse FROM documents JOIN labels USING (doc_id)")
def a08(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return both.agg(F.round(V.rmse(F.col("n_chars") / 10000.0, F.col("quality").cast("double")), 6).alias("rmse"))


@register("a09_auroc", "WITH b AS (SELECT n_chars, quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM documents JOIN labels USING (doc_id)) SELECT round((sum(CASE WHEN quality = 1 THEN r END) - sum(quality)::DOUBLE * (sum(quality) + 1) / 2) / (sum(quality)::DOUBLE * sum(1 - quality)), 6) AS auroc FROM b")
def a09(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return V.auroc(both, "n_chars", "quality").select(F.round("auroc", 6).alias("auroc"))


@register("a10_accuracy", "SELECT avg((quality = 1)::INT::DOUBLE) AS accuracy, count(*) AS n FROM labels")
def a10(spark, d):
    return table(spark, d, "labels").agg(V.accuracy(F.col("quality") == 1).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@register("a12_kpis", "SELECT event_type, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6)::DOUBLE AS span_s FROM events GROUP BY event_type")
def a12(spark, d):
    return T.event_kpis(table(spark, d, "events"), "event_type").select("event_type", "n_events", F.round("span_s", 6).cast("double").alias("span_s"))


@register("a16_centrality", "WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT 'p' || l_partkey AS id FROM e UNION ALL SELECT 's' || l_suppkey FROM e), c AS (SELECT id, count(*) AS deg FROM n GROUP BY id) SELECT id, round(deg::DOUBLE / (SELECT count(*) - 1 FROM c), 9) AS centrality FROM c")
def a16(spark, d):
    return N.degree_centrality(_part_supplier(spark, d)).select("id", F.round("centrality", 9).alias("centrality"))


def _part_supplier(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    lines = dealt(lines, lines.count(), "l_partkey", "l_suppkey").distinct()
    return lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


@register("n11_k_hops", "WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT DISTINCT 'p' || l_partkey AS root FROM lineitem WHERE l_partkey % 100 = 0), h1 AS (SELECT DISTINCT root, b AS id FROM u JOIN r ON a = root), h2 AS (SELECT DISTINCT root, u.b AS id FROM u JOIN h1 ON u.a = h1.id) SELECT root, root AS id, 0 AS depth FROM r UNION ALL SELECT root, id, 1 FROM h1 UNION ALL (SELECT root, id, 2 FROM h2 WHERE id <> root AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.root = h2.root AND h1.id = h2.id))")
def n11(spark, d):
    edges = _part_supplier(spark, d)
    start = edges.where("CAST(substring(src, 2) AS BIGINT) % 100 = 0").select(F.col("src").alias("id")).distinct()
    return N.k_hops(edges, start, 2).select("root", "id", "depth")


@register("n02_merge", "SELECT c_nationkey AS subj, 'HAS' AS rel, c_mktsegment AS obj, max(c_custkey) AS ts FROM customer GROUP BY ALL")
def n02(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("subj"), F.lit("HAS").alias("rel"), F.col("c_mktsegment").alias("obj"), F.col("c_custkey").alias("ts"))
    return N.merge_triplets(c.where("ts % 2 = 0"), c.where("ts % 2 = 1"))


@register("n04_match", "SELECT n_name AS subj, r_name AS obj FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def n04(spark, d):
    e = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subj"), F.lit("IN").alias("rel"), F.col("r_name").alias("obj"))
    return N.match(e, rel="IN", obj="ASIA").select("subj", "obj")


@register("d10_renumber", "SELECT p_partkey, hrid FROM (SELECT p_partkey, p_partkey AS hrid FROM part WHERE p_partkey <= 1000 UNION ALL SELECT p_partkey, 1000 + row_number() OVER (ORDER BY p_partkey) FROM part WHERE p_partkey > 1000)")
def d10(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("hrid"))
    return N.delta_merge(part.where("p_partkey <= 1000"), part.where("p_partkey > 1000"), "p_partkey", "hrid")


@register("t01_rate_window", "SELECT event_id, count(*) OVER w AS requests, CAST(sum(length(props)) OVER w AS BIGINT) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)")
def t01(spark, d):
    return T.trailing_load(table(spark, d, "events"), "user_id", 60, F.length("props").cast("long")).select("event_id", "requests", "tokens")


@register("t04_ready", "SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F')")
def t04(spark, d):
    lines = table(spark, d, "lineitem")
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("RUNNING").alias("state"))
    parts = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_linestatus").alias("task_id"), F.when(F.col("l_linestatus") == "F", "DONE").otherwise("OPEN").alias("state"))
    deps = lines.select(F.col("l_orderkey").cast("string").alias("task_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_linestatus").alias("dep_id"))
    ready = T.ready_tasks(tasks.unionByName(parts.withColumn("state", F.when(F.col("state") == "DONE", "DONE").otherwise("WAIT"))), deps)
    return ready.select(F.col("task_id").cast("long").alias("task_id"))


@register("t05_channel", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def t05(spark, d):
    packets = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("event_id").alias("ts"))
    return T.latest_state(packets)


@register("w17_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def w17(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@register("w18_argmax", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def w18(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@register("extra_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
