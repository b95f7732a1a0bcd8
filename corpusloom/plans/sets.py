"""Curation, sets, samples, sheets, windows, trees and the remaining joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.operators import sets as S
from corpusloom.operators import vector as V
from corpusloom.plans import register
from corpusloom.session import table

C, lit = F.col, F.lit


def _t(spark, d, name):
    return table(spark, d, name)


@register("p05_rouge_filter")
def p05(spark, d):
    """Documents, trimmed of long ones by nothing, that no benchmark item resembles; tests hold it against all pairs."""
    docs = _t(spark, d, "documents").select(C("doc_id").alias("id"), "text")
    items = _t(spark, d, "benchmark").select(C("item_id").alias("id"), "text")
    return docs.select("id").join(S.rouge_rejects(docs, items), "id", "left_anti").withColumnRenamed("id", "doc_id")


@register("p16_qa_quality", "SELECT conv_id, turn FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE length(text) >= 10 AND length(answer) >= 5 AND text <> answer AND len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) >= 20".replace("\\\\", "\\"))
def p16(spark, d):
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = _t(spark, d, "conversations").withColumn("answer", answer)
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    return c.where((F.length("text") >= 10) & (F.length("answer") >= 5) & (C("text") != C("answer")) & (words >= 20)).select("conv_id", "turn")


_SC = "least({0} / 3.0::DOUBLE, 1)"


@register("x11_qa_complexity", r"WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), s AS (SELECT conv_id, 0.4::DOUBLE * least((turn % 4) / 3.0::DOUBLE, 1) + 0.3::DOUBLE * least((turn % 3) / 3.0::DOUBLE, 1) + 0.15::DOUBLE * least(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 20.0::DOUBLE, 1) + 0.15::DOUBLE * least(len(list_filter(regexp_split_to_array(answer, '\s+'), lambda w: w <> '')) / 50.0::DOUBLE, 1) AS c FROM q WHERE answer IS NOT NULL), a AS (SELECT conv_id, avg(c) AS c FROM s GROUP BY conv_id) SELECT DISTINCT v.conv_id, round(coalesce(a.c, 0), 6) AS complexity, coalesce(a.c, 0) >= 0.35 AS complex FROM conversations v LEFT JOIN a ON a.conv_id = v.conv_id")
def x11(spark, d):
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = _t(spark, d, "conversations").withColumn("answer", answer)
    one = F.struct(C("text").alias("question"), "answer", (C("turn") % 4).alias("steps"), (C("turn") % 3).alias("facts"))
    qa = c.groupBy("conv_id").agg(F.collect_list(F.when(C("answer").isNotNull(), one)).alias("qa")).select("conv_id", P.complexity(C("qa")).alias("c"))
    return qa.select("conv_id", F.round("c", 6).alias("complexity"), (C("c") >= 0.35).alias("complex"))


@register("p18_score_threshold", "SELECT doc_id, quality >= 0.5 AND toxic >= 0.5 AS every, quality >= 0.5 AND false AS named FROM labels")
def p18(spark, d):
    scores = F.create_map(lit("quality"), C("quality").cast("double"), lit("toxic"), C("toxic").cast("double"))
    r = _t(spark, d, "labels").where(S.score_threshold(scores, 1))  # an int lets everything pass
    return r.select("doc_id", S.score_threshold(scores, 0.5).alias("every"), S.score_threshold(scores, {"quality": 0.5, "depth": 0.1}).alias("named"))


@register("p19_valid_points", "SELECT conv_id, turn, (turn % 3 <> 0 AND trim(text) <> '') AS good FROM conversations")
def p19(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text", F.when(C("turn") % 3 == 0, " ").otherwise(C("role")).alias("answer"))
    good, bad = S.valid_points(c, ("text", "answer"), strict=False, least=1)
    return good.select("conv_id", "turn", lit(True).alias("good")).unionByName(bad.select("conv_id", "turn", lit(False).alias("good")))


@register("p20_task_content", "SELECT p_partkey, p_partkey % 5 >= 3 AS valid FROM part")
def p20(spark, d):
    k = C("p_partkey") % 5
    text = F.when(k == 0, "  ").when(k == 1, F.concat(lit("Sorry, it is Not Possible: "), C("p_name"))).when(k == 2, F.concat(lit(" Error: "), C("p_name"))).otherwise(C("p_name"))
    return _t(spark, d, "part").select("p_partkey", P.valid_task(text).alias("valid"))


@register("p23_remap", "SELECT CASE WHEN p_size % 3 = 0 THEN p_brand WHEN contains(p_name, 'red') THEN 'colour' WHEN p_type = 'ECONOMY' THEN 'economy' ELSE 'unknown' END AS module, count(*) AS n FROM part WHERE NOT (p_size % 3 <> 0 AND contains(p_name, 'ring')) GROUP BY 1")
def p23(spark, d):
    p = _t(spark, d, "part").select("p_name", "p_type", F.when(C("p_size") % 3 == 0, C("p_brand")).otherwise("unknown").alias("module"))
    p = p.where(~((C("module") == "unknown") & F.contains("p_name", lit("ring"))))
    intent = F.when(F.contains("p_name", lit("red")), "colour")
    scenario = spark.createDataFrame([("ECONOMY", "economy")], "p_type string, by_type string")  # a map of the caller's, one row
    p = p.join(F.broadcast(scenario), "p_type", "left")
    new = F.when(C("module") != "unknown", C("module")).otherwise(F.coalesce(intent, C("by_type"), C("module")))
    return p.groupBy(new.alias("module")).agg(F.count(lit(1)).alias("n"))


@register("p25_purge_calls", "SELECT conv_id, turn FROM conversations WHERE role NOT IN ('tool', 'function') AND NOT (role = 'assistant' AND turn % 4 = 1)")
def p25(spark, d):
    c = _t(spark, d, "conversations").withColumn("text", F.when(C("turn") % 4 == 1, F.concat(C("text"), lit("<tool_call>"))).otherwise(C("text")))
    from corpusloom.operators.conversation import without_calls

    return without_calls(c).select("conv_id", "turn")


def _cells(spark, d):
    n = _t(spark, d, "nation")
    return n.select((C("n_nationkey") + 1).alias("row"), F.explode(F.map_from_arrays(F.array(lit(1), lit(2), lit(3)), F.array(C("n_nationkey").cast("string"), C("n_name"), C("n_regionkey").cast("string")))).alias("col", "value"))


@register("p27_find_cells", "SELECT n_nationkey + 1 AS row, 3 AS col FROM nation WHERE n_regionkey = 2")
def p27(spark, d):
    return S.find_cells(_cells(spark, d), "2", 3)


@register("p28_sheet_rows", "SELECT n_nationkey + 1 AS row, CAST(n_nationkey AS VARCHAR) AS c1, n_name AS c2, CAST(n_regionkey AS VARCHAR) AS c3 FROM nation WHERE n_nationkey + 1 BETWEEN 3 AND 9")
def p28(spark, d):
    return S.sheet_rows(S.cell_range(_cells(spark, d), (3, 1), (9, 3)), 3)


@register("p29_sheet_edits", "SELECT CASE WHEN n_nationkey + 1 > 6 THEN n_nationkey - 1 ELSE n_nationkey + 1 END AS row, 2 AS col, CASE WHEN n_nationkey = 0 THEN 'first' ELSE n_name END AS value FROM nation WHERE n_nationkey + 1 NOT IN (5, 6) UNION ALL SELECT 24, 2, 'last'")
def p29(spark, d):
    cells = S.set_cells(_cells(spark, d), spark.createDataFrame([(1, 2, "first")], "row int, col int, value string"))
    cells = S.append_row(cells, spark.createDataFrame([(2, "last")], "col int, value string"))
    return S.delete_lines(cells, 5, 2).where("col = 2")


@register("k06_markdown", "SELECT line FROM (SELECT '| n_name | n_regionkey |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' FROM nation)")
def k06(spark, d):
    return S.markdown_table(_t(spark, d, "nation").select("n_name", "n_regionkey"), ["n_name"])


@register("d02_persona_dedup")
def d02(spark, d):
    """Vectors without an earlier kept one of cosine 0.35; tests hold it against the plain loop."""
    return S.greedy_diverse(_t(spark, d, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("vector")), 0.35)


@register("d03_block_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(concat_ws('‖', text, source, lang, CAST(n_chars AS VARCHAR)))")
def d03_block(spark, d):
    key = F.md5(F.concat_ws("‖", "text", "source", "lang", C("n_chars").cast("string")))
    return _t(spark, d, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("d04_text_qa_dedup", "SELECT min((conv_id, turn)).conv_id AS conv_id FROM (SELECT conv_id, turn, text, role FROM conversations) GROUP BY text, role".replace("min((conv_id, turn)).conv_id", "arg_min(conv_id, conv_id * 1000 + turn)"))
def d04(spark, d):
    key = [F.xxhash64("text", "role").alias("a"), F.xxhash64(lit(3), "text", "role").alias("b")]
    return _t(spark, d, "conversations").groupBy(*key).agg(F.min(F.struct("conv_id", "turn")).alias("m")).select("m.conv_id")


for _n in (100, 300):

    @register(f"d05_prefix_{_n}", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, {_n})")
    def _prefix(spark, d, n=_n):
        return _t(spark, d, "documents").groupBy(F.substring("text", 1, n).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("d06_ordered_union", "WITH a AS (SELECT n_regionkey AS qid, c_mktsegment AS text, 0 AS l, c_custkey AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0 UNION ALL SELECT n_regionkey, n_name, 1, n_nationkey FROM nation UNION ALL SELECT n_regionkey, 'BUILDING', 1, 99 FROM nation), f AS (SELECT qid, text, min((l, pos)) AS k FROM a GROUP BY ALL) SELECT qid, text, row_number() OVER (PARTITION BY qid ORDER BY k) - 1 AS place FROM f")
def d06(spark, d):
    n = _t(spark, d, "nation")
    c = _t(spark, d, "customer").where("c_custkey % 7 = 0").join(n, C("c_nationkey") == C("n_nationkey"))
    first = c.select(C("n_regionkey").alias("qid"), C("c_mktsegment").alias("text"), C("c_custkey").alias("pos"))
    second = n.select(C("n_regionkey").alias("qid"), F.explode(F.array(F.struct(C("n_name").alias("text"), C("n_nationkey").alias("pos")), F.struct(lit("BUILDING").alias("text"), lit(99).alias("pos")))).alias("x")).select("qid", "x.*")
    return S.ordered_union([first, second])


_WORDS = "list_distinct(string_split(p_name, ' '))"


@register("d07_keyword_sets", f"WITH p AS (SELECT p_partkey, {_WORDS} AS a, ['red', 'ring', 'blue'] AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either FROM p")
def d07(spark, d):
    a, b = F.split("p_name", " "), F.array(lit("red"), lit("ring"), lit("blue"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return _t(spark, d, "part").select("p_partkey", text(F.array_intersect(a, b)).alias("both"), text(F.array_except(a, b)).alias("only"), text(F.array_union(a, b)).alias("either"))


@register("d08_overlap", f"WITH p AS (SELECT p_partkey, {_WORDS} AS a, list_distinct([p_type, p_brand]) AS m FROM part), o AS (SELECT p_partkey, len(list_intersect(a, ['red', 'ring', 'blue']))::DOUBLE / greatest(len(a), 1) AS x, len(list_intersect(m, ['ECONOMY', 'Brand#2']))::DOUBLE / greatest(len(m), 1) AS y FROM p) SELECT p_partkey, (x + y) / 2 AS similarity FROM o WHERE x > 0.5 OR y > 0.5")
def d08(spark, d):
    x = S.overlap(F.split("p_name", " "), F.array(lit("red"), lit("ring"), lit("blue")))
    y = S.overlap(F.array("p_type", "p_brand"), F.array(lit("ECONOMY"), lit("Brand#2")))
    return _t(spark, d, "part").where((x > 0.5) | (y > 0.5)).select("p_partkey", ((x + y) / 2).alias("similarity"))


@register("d11_insert_absent", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def d11(spark, d):
    p = _t(spark, d, "part")
    return S.insert_absent(p.where("p_partkey % 3 = 0").select("p_partkey", "p_name"), p.where("p_partkey % 2 = 0").select("p_partkey", C("p_type").alias("p_name")), "p_partkey")


@register("d13_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 16 OFFSET 37")
def d13(spark, d):
    return S.slice_from(_t(spark, d, "documents").select("doc_id"), 16, 37, "doc_id")


@register("d14_mixed_sample", "WITH h AS (SELECT c_name AS i, row_number() OVER (ORDER BY md5('3:' || c_name), c_name) - 1 AS p FROM customer), m AS (SELECT r_name AS i, row_number() OVER (ORDER BY md5('3:' || r_name), r_name) + 5 AS p FROM region WHERE r_regionkey < 1) SELECT r.range AS place, coalesce(h.i, m.i, '') AS instruction FROM range(8) r LEFT JOIN h ON h.p = r.range AND h.p < 6 LEFT JOIN m ON m.p = r.range")
def d14(spark, d):
    return S.mixed_sample(_t(spark, d, "customer").select(C("c_name").alias("instruction")), _t(spark, d, "region").where("r_regionkey < 1").select(C("r_name").alias("instruction")))


@register("d15_shuffled_subset", "SELECT item_id FROM benchmark ORDER BY md5('5:' || item_id), item_id LIMIT 20")
def d15(spark, d):
    return _t(spark, d, "benchmark").orderBy(S.hash_order(5, "item_id"), "item_id").limit(20).select("item_id")


def _edges(spark, d):
    from corpusloom.plans.relational import _part_supplier

    return _part_supplier(spark, d)


@register("d16_random_walk")
def d16(spark, d):
    """Walks of four steps from every supplier; tests check that steps are edges or restarts and that reruns agree."""
    e = _edges(spark, d)
    return S.random_walk(e, e.select(C("dst").alias("id")).distinct(), 4)


@register("d17_neighbour_walk")
def d17(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    e = n.select(C("n_name").alias("src"), C("r_name").alias("dst"))
    ring = _t(spark, d, "nation").select(C("n_name").alias("src"), F.concat(lit("NATION_"), ((C("n_nationkey") + 5) % 25).cast("string")).alias("dst"))
    e = e.unionByName(ring)
    return S.random_walk(e, e.select(C("dst").alias("id")).distinct(), 3, by_neighbours=True)


@register("w01_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w01(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey", rank.cast("long").alias("rank"))


@register("w04_pop", "SELECT conv_id, turn, (role = 'system' OR rn > 2) AND turn % 5 <> 3 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role IN ('system', 'developer') THEN 1 ELSE 0 END, turn DESC) AS rn FROM conversations)")
def w04(spark, d):
    from corpusloom.operators.conversation import pop_last

    kept = pop_last(_t(spark, d, "conversations"), 2).withColumn("kept", C("kept") & (C("turn") % 5 != 3))
    return kept.select("conv_id", "turn", "kept")


_SENT = r"list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@register("w06_lead_triples", f"WITH s AS (SELECT doc_id, {_SENT} AS a FROM documents), t AS (SELECT doc_id, unnest(range(1, greatest(len(a) - 1, 1))) AS i, a FROM s) SELECT doc_id, i - 1 AS i, md5(a[i] || '|' || a[i + 1] || '|' || a[i + 2]) AS triple FROM t WHERE length(a[i]) > 10 AND length(a[i + 1]) > 10")
def w06(spark, d):
    from corpusloom.operators.curate import sentence_triples

    found = sentence_triples(_t(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", C("i").cast("long").alias("i"), F.md5(F.concat_ws("|", "premise", "middle", "conclusion")).alias("triple"))


@register("w07_heading_paths", "WITH h AS (SELECT c_nationkey AS doc, c_custkey AS pos, 1 + abs(CAST(c_acctbal AS BIGINT)) % 12 AS level, c_name AS title FROM customer) SELECT h.doc, h.pos, string_agg(a.title, ' > ' ORDER BY a.pos) AS path FROM h JOIN h a ON a.doc = h.doc AND a.pos <= h.pos WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc = h.doc AND b.pos > a.pos AND b.pos <= h.pos AND b.level <= a.level) GROUP BY h.doc, h.pos")
def w07(spark, d):
    level = 1 + F.abs(F.rint("c_acctbal").cast("long")) % 12
    return S.heading_paths(_t(spark, d, "customer").select(C("c_nationkey").alias("doc"), C("c_custkey").alias("pos"), level.alias("level"), C("c_name").alias("title")))


@register("w09_offsets", "SELECT p_brand, p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS number FROM part")
def w09(spark, d):
    return S.running_offsets(_t(spark, d, "part"), "p_brand", "p_partkey")


@register("w11_interleave", "SELECT conv_id, text_md5, row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) AS place FROM (SELECT conv_id, turn, md5(text) AS text_md5, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 2 END AS k FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, md5('memory'), 1 FROM conversations)")
def w11(spark, d):
    c = _t(spark, d, "conversations")
    first = C("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    chat = c.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.when(first, 0).otherwise(2).alias("k"))
    memory = c.select("conv_id", lit(0).cast("long").alias("turn"), F.md5(lit("memory")).alias("text_md5"), lit(1).alias("k")).distinct()
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("k", "turn"))
    return chat.unionByName(memory).select("conv_id", "text_md5", place.cast("long").alias("place"))


@register("w12_stable_head", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 40")
def w12(spark, d):
    return _t(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(40).select("p_partkey")


@register("w13_top_k_clamped", "SELECT r_regionkey FROM region ORDER BY r_name DESC LIMIT 10")
def w13(spark, d):
    return _t(spark, d, "region").orderBy(F.desc("r_name")).limit(10).select("r_regionkey")


def _tree(spark, d):
    k = C("p_partkey")
    return _t(spark, d, "part").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 3)).alias("parent"), "p_size")


_TREE = "WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent, p_size FROM part)"


@register("w14_post_order", _TREE + ", t AS (SELECT id, lpad(CAST(id AS VARCHAR), 20, '0') AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || lpad(CAST(n.id AS VARCHAR), 20, '0') FROM n JOIN t ON n.parent = t.id) SELECT id, row_number() OVER (ORDER BY path || '~') AS place FROM t")
def w14(spark, d):
    return S.post_order(_tree(spark, d)).select("id", "place")


@register("w15_cycles", "SELECT p_partkey AS id FROM part WHERE p_partkey < 30")
def w15(spark, d):
    k = C("p_partkey")
    chain = _t(spark, d, "part").select(k.alias("task_id"), F.when(k < 10, (k + 1) % 10).when(k < 30, k - 10).when(k < 200, k + 100).alias("dep_id"))
    return S.cyclic(chain)


@register("w16_depths", _TREE + ", t AS (SELECT id, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT id, depth FROM t")
def w16(spark, d):
    return S.depths(_tree(spark, d)).select("id", "depth")


@register("a13_subtree_sums", _TREE + ", t AS (SELECT id AS top, id, p_size FROM n UNION ALL SELECT t.top, n.id, n.p_size FROM n JOIN t ON n.parent = t.id) SELECT top AS id, CAST(sum(p_size) AS BIGINT) AS total FROM t GROUP BY top")
def a13(spark, d):
    return S.subtree_sums(_tree(spark, d), "p_size").select("id", C("total").cast("long").alias("total"))


@register("a03_nested_index", "WITH w AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT p_type, p_brand, list_sort(list_distinct(flatten(list(string_split(p_name, ' ')))))[1:20] AS words FROM part GROUP BY ALL) SELECT p_type, string_agg(p_brand || ':' || n || ':' || array_to_string(words, '+'), ';' ORDER BY p_brand) AS steps FROM w JOIN k USING (p_type, p_brand) GROUP BY p_type")
def a03(spark, d):
    words = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " "))))), 1, 20)
    inner = _t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(lit(1)).alias("n"), words.alias("w"))
    rows = F.array_sort(F.collect_list(F.struct("p_brand", F.concat_ws(":", "p_brand", C("n").cast("string"), F.array_join("w", "+")).alias("s"))))
    return inner.groupBy("p_type").agg(rows.alias("r")).select("p_type", F.array_join(F.transform("r", lambda x: x.s), ";").alias("steps"))


@register("a04_run_summary", "SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders UNION ALL SELECT 'verdict', count(*) FILTER (o_orderpriority <> '' AND o_orderpriority IS NOT NULL) FROM orders UNION ALL SELECT 'new:' || o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)")
def a04(spark, d):
    o = _t(spark, d, "orders")
    by = o.groupBy(C("o_orderstatus").alias("k")).agg(F.count(lit(1)).alias("n"))
    whole = o.agg(F.count(lit(1)).alias("total"), F.count_if(C("o_orderpriority") != "").alias("verdict")).selectExpr("stack(2, 'total', total, 'verdict', verdict) AS (k, n)")
    new = o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select(F.concat(lit("new:"), C("o_orderkey").cast("string")).alias("k"), C("o_custkey").alias("n"))
    return by.unionByName(whole).unionByName(new)


@register("a05_module_stats", "SELECT p_brand, count(*) AS n, count(*) FILTER (contains(p_name, 'red')) AS bugs FROM part GROUP BY p_brand")
def a05(spark, d):
    return _t(spark, d, "part").groupBy("p_brand").agg(F.count(lit(1)).alias("n"), F.count_if(F.contains("p_name", lit("red"))).alias("bugs"))


@register("a06_batches", "WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1), b AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 50 AS batch FROM part) SELECT p_brand, p_partkey, batch, dense_rank() OVER (ORDER BY first) AS place FROM b JOIN f USING (p_brand)")
def a06(spark, d):
    p = _t(spark, d, "part")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    place = first.select("p_brand", F.dense_rank().over(Window.orderBy("first")).cast("long").alias("place"))  # one row for each group
    return S.batches(p, "p_brand", "p_partkey", 50).join(place, "p_brand")


@register("a11_levels", "SELECT c_nationkey % 3 AS level, count(*) AS total, CAST(sum(c_custkey % 2) AS BIGINT) AS correct FROM customer WHERE c_nationkey % 3 IN (0, 2) GROUP BY 1")
def a11(spark, d):
    c = _t(spark, d, "customer").select((C("c_nationkey") % 3).alias("level"), (C("c_custkey") % 2).alias("score"))
    return c.where(C("level").isin(0, 2)).groupBy("level").agg(F.count(lit(1)).alias("total"), F.sum("score").alias("correct"))


@register("a14_schema", "SELECT label, string_agg(DISTINCT k, ',' ORDER BY k) AS properties FROM (SELECT 'Nation' AS label, unnest(['id', 'name']) AS k FROM nation UNION ALL SELECT 'Part', unnest(['size', 'name']) FROM part) GROUP BY label")
def a14(spark, d):
    from corpusloom.operators.graph import node_schema

    a = _t(spark, d, "nation").select(lit("Nation").alias("label"), F.create_map(lit("id"), C("n_nationkey").cast("string"), lit("name"), C("n_name"), lit("bbox"), lit("x")).alias("properties"))
    b = _t(spark, d, "part").select(lit("Part").alias("label"), F.create_map(lit("size"), C("p_size").cast("string"), lit("name"), C("p_name")).alias("properties"))
    return node_schema(a.unionByName(b), exclude=("bbox",)).select("label", F.array_join("properties", ",").alias("properties"))


@register("a15_constraints", "SELECT n_regionkey, array_to_string(list_sort(list_distinct(flatten(list([n_name, CAST(n_nationkey % 2 AS VARCHAR)])))), ',') AS found FROM nation GROUP BY 1")
def a15(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("n_name", (C("n_nationkey") % 2).cast("string")))))), ",").alias("found"))


@register("a17_reward_total", "SELECT doc_id, CAST(quality * 1.0 + toxic * 0.5 + 0.25 AS DOUBLE) AS reward FROM labels")
def a17(spark, d):
    rewards = F.create_map(lit("correctness"), C("quality").cast("double"), lit("style"), C("toxic") * 0.5, lit("base"), lit(0.25))
    return _t(spark, d, "labels").select("doc_id", F.aggregate(F.map_values(rewards), lit(0.0), lambda s, x: s + x).alias("reward"))


@register("a18_matrix", "SELECT c_mktsegment AS a, n_name AS b, CAST(c_custkey % 5 AS BIGINT) AS task, max(c_custkey) AS item FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def a18(spark, d):
    j = _t(spark, d, "customer").join(_t(spark, d, "nation"), C("c_nationkey") == C("n_nationkey"))
    last = j.groupBy(C("c_mktsegment").alias("a"), C("n_name").alias("b"), (C("c_custkey") % 5).alias("task")).agg(F.max("c_custkey").alias("item"))
    items = last.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("task", "item"))).alias("items"))
    return items.select("a", "b", F.explode("items").alias("task", "item"))


@register("a19_batch_metrics", "SELECT user_id, round(100.0::DOUBLE * avg((event_type = 'error')::INT), 6) AS error_rate, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def a19(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.round(100 * F.avg((C("event_type") == "error").cast("double")), 6).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean"))


@register("a21_merge_sources", "WITH s AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS k FROM documents GROUP BY source) SELECT printf('src_%04d', k) AS id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS place, md5('[' || coalesce(lang, 'unknown') || '] ' || coalesce(text, '')) AS text_md5 FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source")
def a21(spark, d):
    return S.merged_pieces(_t(spark, d, "documents")).select("id", "source", "place", F.md5("text").alias("text_md5"))


@register("a23_distinct", "SELECT count(DISTINCT md5(text)) AS n FROM documents")
def a23(spark, d):
    return _t(spark, d, "documents").agg(F.count_distinct(F.md5("text")).alias("n"))


@register("j02_full_outer", "WITH a AS (SELECT o_custkey AS id, count(*) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT id, coalesce(1.0::DOUBLE / a, 0) + coalesce(1.0::DOUBLE / b, 0) AS score FROM a FULL JOIN b USING (id)")
def j02(spark, d):
    part = lambda s, n: _t(spark, d, "orders").where(C("o_orderstatus") == s).groupBy(C("o_custkey").alias("id")).agg(F.count(lit(1)).alias(n))
    return part("O", "a").join(part("F", "b"), "id", "full_outer").select("id", (F.coalesce(1 / C("a"), lit(0.0)) + F.coalesce(1 / C("b"), lit(0.0))).alias("score"))


@register("j04_similar_pairs", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4")
def j04(spark, d):
    v = _t(spark, d, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("vector"))
    return V.similar_pairs(v, 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@register("j07_first_match", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'colour' WHEN contains(p_name, 'ring') THEN 'shape' WHEN contains(p_name, 'blue') THEN 'colour2' END AS module FROM part")
def j07(spark, d):
    return _t(spark, d, "part").select("p_partkey", P.first_rule(C("p_name"), (("colour", ("red",)), ("shape", ("ring",)), ("colour2", ("blue",)))).alias("module"))


@register("j08_pattern", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def j08(spark, d):
    from corpusloom.operators.graph import match

    e = _t(spark, d, "supplier").join(_t(spark, d, "nation"), C("s_nationkey") == C("n_nationkey")).select(C("s_name").alias("subj"), lit("IN").alias("rel"), C("n_name").alias("obj"))
    return match(e, obj="NATION_3").select(C("subj").alias("s_name"), C("obj").alias("n_name"))


@register("j09_two_hops", "WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT DISTINCT a.s AS a, b.s AS b FROM e a JOIN e b ON a.p = b.p AND a.s < b.s")
def j09(spark, d):
    from corpusloom.operators.graph import two_hops

    return two_hops(_t(spark, d, "lineitem").select(C("l_partkey").alias("mid"), C("l_suppkey").alias("member")))


@register("j12_zipped", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest([p_type, p_brand]) AS tag FROM part")
def j12(spark, d):
    both = F.zip_with(F.split("p_name", " "), F.array("p_type", "p_brand"), lambda a, b: F.struct(a.alias("word"), b.alias("tag")))
    return _t(spark, d, "part").select("p_partkey", F.explode(both).alias("z")).select("p_partkey", "z.*")


@register("j13_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def j13(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return V.upsert(s, s.where("s_suppkey % 4 = 0").withColumn("s_acctbal", C("s_acctbal") + 1), "s_suppkey")


@register("j14_shared_memory", "SELECT a.r_regionkey AS agent, n.n_nationkey AS record FROM region a, nation n WHERE a.r_regionkey <> n.n_regionkey")
def j14(spark, d):
    agents = _t(spark, d, "region").select(C("r_regionkey").alias("agent"))
    n = _t(spark, d, "nation")
    own = n.select(C("n_regionkey").alias("agent"), C("n_nationkey").alias("record"))
    return agents.crossJoin(n.select(C("n_nationkey").alias("record"))).join(own, ["agent", "record"], "left_anti")  # agents are few; every one gets all records
