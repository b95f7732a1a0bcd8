"""Retrieval pipelines over documents, benchmark items and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import lexical as L
from corpusloom.operators import retrieve as R
from corpusloom.operators import vector as V
from corpusloom.plans import register
from corpusloom.plans.search import _BM25, _EMB, _text
from corpusloom.session import table

C, lit = F.col, F.lit


def _docs(spark, d):
    return table(spark, d, "documents").select(C("doc_id").alias("id"), "text", "source", "lang")


_PIECES = "SELECT doc_id AS id, i + 1 AS piece_num, substr(text, i * 500 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"


@register("r01_ingest", f"SELECT id, CAST(piece_num AS INT) AS piece_num, md5(text) AS text_md5, CAST(list_sum({_EMB}) AS BIGINT) AS letters FROM ({_PIECES})")
def r01(spark, d):
    found = R.ingest(_docs(spark, d), V.letter_embedding)
    return found.select("id", "piece_num", F.md5("text").alias("text_md5"), F.aggregate("vector", lit(0.0), lambda s, x: s + x).cast("long").alias("letters"))


_COS = "round(list_dot_product(q.v, e.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-10) * greatest(sqrt(list_dot_product(e.v, e.v)), 1e-10)), 6)"


@register("r02_vector_query", f"WITH q AS (SELECT item_id AS qid, {_EMB} AS v FROM benchmark), e AS (SELECT doc_id AS id, {_EMB} AS v FROM documents), t AS (SELECT qid, max({_COS}) AS similarity FROM q, e GROUP BY qid) SELECT q.qid, t.similarity FROM q LEFT JOIN t ON t.qid = q.qid AND similarity >= 0.98")
def r02(spark, d):
    docs = _docs(spark, d).select("id", V.letter_embedding(C("text")).alias("vector"))
    queries = table(spark, d, "benchmark").select(C("item_id").alias("qid"), V.letter_embedding(C("text")).alias("query_vector"))
    return R.vector_query(docs, queries, 1, 0.98).select("qid", F.round("similarity", 6).alias("similarity"))


@register("r05_multi_source", _BM25.replace("FROM documents)", "FROM documents)") + ", m AS (SELECT s.*, d.source FROM s JOIN documents d ON d.doc_id = s.id), px AS (SELECT qid, id, source, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY qid, (source IN ('src0', 'web')) ORDER BY round(score, 6) DESC, id) <= 10) SELECT qid, id, score FROM px QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 12")
def r05(spark, d):
    docs, queries = _text(spark, d)
    scores = L.bm25(docs, queries).withColumn("score", F.round("score", 6)).join(_docs(spark, d).select("id", "source"), "id")
    first = F.coalesce(C("source").isin("src0", "web"), lit(False))
    parts = [L.ranked(scores.where(keep), 10).select("qid", lit("all").alias("source"), "id", "score") for keep in (first, ~first)]
    return R.multi_source(parts, 12).select("qid", "id", "score")


@register("r06_collection_name", "SELECT item_id, substr(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g'), 1, 10) || '_' || substr(md5(text), 1, 6) AS name FROM benchmark")
def r06(spark, d):
    return table(spark, d, "benchmark").select("item_id", R.collection_name(C("text")).alias("name"))


_TOP20 = _BM25 + ", h AS (SELECT qid, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) <= 20)"
_W = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''))"


def _hits(spark, d):
    docs, queries = _text(spark, d)
    found = L.bm25_top(docs, queries, 20).drop("rank")
    return found.join(docs, "id"), queries


@register("r07_rerank", _TOP20 + f", r AS (SELECT h.qid, h.id, len(list_intersect({_W.format('b.text')}, {_W.format('d.text')}))::DOUBLE / greatest(len({_W.format('b.text')}), 1) AS score FROM h JOIN benchmark b ON b.item_id = h.qid JOIN documents d ON d.doc_id = h.id) SELECT qid, id, round(score, 9) AS score FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5")
def r07(spark, d):
    hits, queries = _hits(spark, d)
    both = hits.join(queries.withColumnRenamed("text", "query"), "qid")
    return R.rerank(both, C("query"), C("text"), 5).select("qid", "id", F.round("score", 9).alias("score"))


@register("r08_unified", _TOP20 + ", tx AS (SELECT h.*, d.text, d.source FROM h JOIN documents d ON d.doc_id = h.id), u AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY qid, substr(text, 1, 300) ORDER BY score DESC, id) = 1), b AS (SELECT qid, id, text, round(score + CASE WHEN source = 'web' THEN 0.08::DOUBLE ELSE -0.02::DOUBLE END, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 8) SELECT qid, md5(string_agg(substr(text, 1, 1500), chr(10) || chr(10) ORDER BY score DESC, id)) AS context_md5 FROM b GROUP BY qid")
def r08(spark, d):
    hits, _ = _hits(spark, d)
    kept = R.first_of_prefix(hits, 300, [F.desc("score"), "id"]).join(_docs(spark, d).select("id", "source"), "id")
    top = L.ranked(kept, 8)
    boosted = top.withColumn("score", F.round(L.category_boost(C("score"), F.coalesce("source", lit("")), "web"), 6))
    ordered = F.array_sort(F.collect_list(F.struct((-C("score")).alias("s"), "id", F.substring("text", 1, 1500).alias("t"))))
    return boosted.groupBy("qid").agg(ordered.alias("o")).select("qid", F.md5(F.array_join(F.transform("o", lambda x: x.t), "\n\n")).alias("context_md5"))


@register("r09_query_list", "WITH q AS (SELECT c_nationkey AS qid, c_mktsegment AS query, CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE c_custkey % 4 END AS p, c_custkey AS pos FROM customer WHERE c_nationkey % 2 = 1), o AS (SELECT qid, query, min((p, pos)) AS k FROM q GROUP BY ALL), n AS (SELECT qid, count(*) AS n FROM o GROUP BY qid), m AS (SELECT n_nationkey AS qid, CASE WHEN n_nationkey % 3 = 0 THEN 'BUILDING' ELSE n_name END AS query FROM nation), a AS (SELECT qid, query, k FROM o UNION ALL SELECT m.qid, m.query, CASE WHEN coalesce(n.n, 0) < 2 THEN (-1, 0) ELSE (2147483647, 0) END FROM m LEFT JOIN n USING (qid) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.qid = m.qid AND o.query = m.query)) SELECT qid, query, CAST(row_number() OVER (PARTITION BY qid ORDER BY k) - 1 AS INT) AS place FROM a")
def r09(spark, d):
    c = table(spark, d, "customer").where("c_nationkey % 2 = 1")
    asked = c.select(C("c_nationkey").alias("qid"), C("c_custkey").alias("pos"), C("c_mktsegment").alias("query"), F.when(C("c_custkey") % 5 != 0, C("c_custkey") % 4).alias("priority"))
    main = table(spark, d, "nation").select(C("n_nationkey").alias("qid"), F.when(C("n_nationkey") % 3 == 0, "BUILDING").otherwise(C("n_name")).alias("query"))
    return R.query_list(asked, main)


@register("r10_score", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND value <> 0 THEN value WHEN event_id % 2 = 0 THEN 0.5::DOUBLE WHEN event_id % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events")
def r10(spark, d):
    sim = F.when(C("event_id") % 3 == 0, C("value")).otherwise(0.0)
    return table(spark, d, "events").select("event_id", R.resolved_score(sim, F.when(C("event_id") % 2 == 0, 0.5), F.when(C("event_id") % 5 == 0, 0.25)).alias("score"))


_CASES = (("Load over TCP", "https page", 0.02), ("https check", "an HTTP host", -0.03), ("http or ftp", "http and sftp", 0.07), ("ldap bind", "LDAPS", 0.02), ("no name", "tcp", 0.0), ("udp relay", "plain text", 0.0), ("TCP, SSH", "ssh; telnet", 0.07), ("dns and dhcp", "dns dhcp", 0.1))


@register("r12_protocol_boost", "WITH k(i, boost) AS (VALUES " + ", ".join(f"({i}, {b}::DOUBLE)" for i, (_, _, b) in enumerate(_CASES)) + ") SELECT p_partkey, boost FROM part JOIN k ON p_partkey % 8 = i")
def r12(spark, d):
    pick = lambda j: F.element_at(F.array(*[lit(c[j]) for c in _CASES]), (C("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(R.protocol_boost(R.protocols(pick(0)), R.protocols(pick(1))), 9).alias("boost"))


def _geo(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n, n.join(r, C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("src"), C("r_name").alias("dst"))


_PROX = "SELECT q.n_nationkey AS qid, s_suppkey AS id, CASE WHEN q.n_nationkey = s_nationkey THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS proximity FROM nation q, supplier JOIN nation n ON s_nationkey = n.n_nationkey WHERE q.n_regionkey = n.n_regionkey"


def _proximity(spark, d):
    n, edges = _geo(spark, d)
    queries = n.select(C("n_nationkey").alias("qid"), C("n_name").alias("entity"))
    docs = table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select(C("s_suppkey").alias("id"), C("n_name").alias("entity"))
    return R.graph_proximity(queries, docs, edges)


@register("r13_proximity", _PROX)
def r13(spark, d):
    return _proximity(spark, d)


@register("r14_combined", f"SELECT qid, id, round(id + 0.05::DOUBLE + 0.4::DOUBLE * proximity, 6) AS score FROM ({_PROX})")
def r14(spark, d):
    return _proximity(spark, d).select("qid", "id", F.round(R.combined_boost(C("id").cast("double"), lit(0.05), C("proximity")), 6).alias("score"))


@register("r15_entities", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'licence') OR contains(lower(text), 'license') THEN 'Licence' END, CASE WHEN contains(lower(text), 'the') THEN 'The' END, CASE WHEN contains(lower(text), 'und') OR contains(lower(text), 'der') OR contains(lower(text), 'die') THEN 'Und' END], lambda x: x IS NOT NULL), ',') AS entities FROM documents")
def r15(spark, d):
    names = {"Licence": ("license",), "The": (), "Und": ("der", "die")}
    return table(spark, d, "documents").select("doc_id", F.array_join(R.entities(C("text"), names), ",").alias("entities"))


@register("r16_prefix_bonus", "SELECT p_partkey, (contains(lower(p_name), 'red')::INT + contains(lower(p_name), 'ring')::INT) / 2.0::DOUBLE + CASE WHEN p_size % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def r16(spark, d):
    prefix = F.when(C("p_size") % 3 == 0, "Red").otherwise("blue")
    return table(spark, d, "part").select("p_partkey", L.keyword_score(F.array(lit("red"), lit("ring")), C("p_name"), prefix, lit("red ring")).alias("score"))


@register("r17_prefix_search", r"WITH e AS (SELECT p_partkey AS id, p_type AS prefix, p_name || ' ' || p_brand AS text FROM part), q AS (SELECT r_regionkey AS qid, CASE r_regionkey WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'none' END AS prefix, ['red', CASE r_regionkey WHEN 3 THEN 'ring' ELSE 'widget' END] AS terms FROM region), x AS (SELECT qid, id, text, 2.0::DOUBLE AS score FROM q JOIN e USING (prefix)), f AS (SELECT qid, id, text, len(list_intersect(terms, regexp_split_to_array(lower(text), '\W+')))::DOUBLE / 2 AS score FROM q, e), a AS (SELECT qid, id, any_value(text) AS text, max(score) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM f WHERE score > 0) GROUP BY qid, id), u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid, substr(text, 1, 100) ORDER BY score DESC, id) = 1) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM u QUALIFY rank <= 10")
def r17(spark, d):
    entries = table(spark, d, "part").select(C("p_partkey").alias("id"), C("p_type").alias("prefix"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    key = C("r_regionkey")
    queries = table(spark, d, "region").select(key.alias("qid"), F.array(F.when(key == 0, "ECONOMY").when(key == 1, "PROMO").otherwise("none")).alias("prefixes"), F.array(lit("red"), F.when(key == 3, "ring").otherwise("widget")).alias("terms"))
    return R.prefix_search(entries, queries)


@register("r18_similar_tests", "SELECT p_partkey AS id, (contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT + contains(p_name, 'gear')::INT) / 3.0::DOUBLE AS score FROM part WHERE (contains(p_name, 'red') OR contains(p_name, 'ring') OR contains(p_name, 'gear')) AND (p_size % 4 = 0 OR contains(p_brand, '#2'))")
def r18(spark, d):
    tests = table(spark, d, "part").select(C("p_partkey").alias("id"), C("p_name").alias("text"), F.when(C("p_size") % 4 == 0, "").otherwise(C("p_brand")).alias("module"))
    return R.similar_tests(tests, F.array(lit("red"), lit("ring"), lit("gear")), "brand#2")


_ROUTES = (("show slb virtual syntax of http2 settings", "cli"), ("review checklist for func spec", "rules,design"), ("已有测试 test list", "test"), ("nothing of note", "design"), ("什么是命令格式 test case", "cli,design,test"))


@register("r19_layers", "WITH k(i, layers) AS (VALUES " + ", ".join(f"({i}, '{w}')" for i, (_, w) in enumerate(_ROUTES)) + ") SELECT p_partkey, layers FROM part JOIN k ON p_partkey % 5 = i")
def r19(spark, d):
    query = F.element_at(F.array(*[lit(q) for q, _ in _ROUTES]), (C("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(R.layers(query), ",").alias("layers"))


@register("r21_adaptive", _TOP20 + ", tx AS (SELECT h.*, d.text FROM h JOIN documents d ON d.doc_id = h.id), a AS (SELECT qid, id, text FROM tx QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 2), m AS (SELECT qid FROM a GROUP BY qid HAVING NOT (bool_or(contains(lower(text), 'licensed')) AND bool_or(contains(lower(text), ' und ')))) SELECT qid, id FROM a UNION SELECT qid, id FROM tx WHERE qid IN (SELECT qid FROM m)")
def r21(spark, d):
    hits, _ = _hits(spark, d)
    first = L.ranked(hits, 2).select("qid", "id", "text")
    return R.adaptive([first, hits.select("qid", "id", "text")], ("licensed", " und ")).select("qid", "id")


@register("r22_enriched", "SELECT s_suppkey, s_name || ' [module: ' || n_name || ', ' || r_name || ']' || CASE WHEN s_suppkey % 2 = 0 THEN ' [protocol: tcp]' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN ' [scenario: s1]' ELSE '' END AS query FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def r22(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    s = table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).join(r, C("n_regionkey") == C("r_regionkey"))
    query = R.enriched_query(C("s_name"), F.array("n_name", "r_name"), F.when(C("s_suppkey") % 2 == 0, "tcp"), F.when(C("s_suppkey") % 3 == 0, "s1").otherwise("unknown"), lit(None).cast("string"))
    return s.select("s_suppkey", query.alias("query"))


@register("r23_uniform", "SELECT 'source' AS kind, CAST(doc_id AS VARCHAR) AS id, md5(text) AS text, 0.5::DOUBLE AS score FROM documents UNION ALL SELECT 'entity', CAST(n_nationkey AS VARCHAR), md5(n_name), 0.3 FROM nation UNION ALL SELECT 'relationship', CAST(s_suppkey AS VARCHAR), md5(s_name), CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE 0.2 END FROM supplier UNION ALL SELECT 'report', CAST(r_regionkey AS VARCHAR), md5(r_name), 0.4 FROM region")
def r23(spark, d):
    pick = lambda t, i, n: table(spark, d, t).select(C(i).alias("id"), F.md5(n).alias("text"))
    rel = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), F.md5("s_name").alias("text"), F.when(C("s_suppkey") % 2 == 0, C("s_acctbal")).alias("score"))
    return R.uniform_hits(pick("documents", "doc_id", "text"), pick("nation", "n_nationkey", "n_name"), rel, pick("region", "r_regionkey", "r_name"))


@register("r24_hybrid_graph", _TOP20 + ", tx AS (SELECT h.*, d.text FROM h JOIN documents d ON d.doc_id = h.id), g AS (SELECT item_id AS qid, -1 - item_id AS id, text, 0.5::DOUBLE AS score FROM benchmark), a AS (SELECT *, 0 AS o FROM tx UNION ALL SELECT qid, id, score, text, 1 FROM g), u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid, substr(text, 1, 200) ORDER BY o, score DESC, id) = 1) SELECT qid, id, round(score + CASE WHEN contains(text, 'licens') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score + CASE WHEN contains(text, 'licens') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END DESC, id) <= 8")
def r24(spark, d):
    hits, queries = _hits(spark, d)
    graph = queries.select("qid", (-1 - C("qid")).alias("id"), "text", lit(0.5).alias("score"))
    boost = F.when(F.contains("text", lit("licens")), 0.1).otherwise(0.0)
    return R.hybrid_graph(hits.select("qid", "id", "text", "score"), graph, boost).select("qid", "id", F.round("score", 6).alias("score"))


@register("r25_sections", "WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), '### '), '### ') AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS body, generate_subscripts(a, 1) - 1 AS section FROM p), n AS (SELECT doc_id AS id, section, contains(lower(body), 'the')::INT + contains(lower(body), ' und ')::INT + contains(lower(body), ' la ')::INT AS n FROM u WHERE section > 0 AND trim(body) <> '') SELECT id, CAST(section AS INT) AS section, n FROM n WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, section) <= 4")
def r25(spark, d):
    files = table(spark, d, "documents").select(C("doc_id").alias("id"), F.replace("text", lit("\n"), lit("### ")).alias("text"))
    return R.section_search(files, ("the", " und ", " la "))


@register("r27_files", _TOP20 + ", f AS (SELECT qid, d.source AS file, max(score) AS score FROM h JOIN documents d ON d.doc_id = h.id WHERE d.source IS NOT NULL GROUP BY ALL), w AS (SELECT source AS file, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS text_md5 FROM documents GROUP BY source) SELECT qid, file, score, text_md5 FROM f JOIN w USING (file)")
def r27(spark, d):
    hits, _ = _hits(spark, d)
    named = hits.join(_docs(spark, d).select("id", C("source").alias("file")), "id").where("file IS NOT NULL")
    chunks = _docs(spark, d).select(C("source").alias("file"), C("id").alias("piece_num"), "text")
    return R.files_of_hits(named, chunks).select("qid", "file", "score", F.md5("text").alias("text_md5"))


@register("p11_metadata_filter", "SELECT s_suppkey, s_nationkey = 3 AND s_suppkey % 2 = 0 AS strict, (s_nationkey IN (3, 4) OR s_suppkey % 5 = 0) AND (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AS relaxed FROM supplier".replace("s_nationkey = 3 AND s_suppkey % 2 = 0", "(s_nationkey IN (3, 4) AND s_suppkey % 5 <> 0) AND s_suppkey % 2 = 0"))
def p11(spark, d):
    s = table(spark, d, "supplier")
    module = F.when(C("s_suppkey") % 5 != 0, C("s_nationkey").cast("string"))
    held = F.when(C("s_suppkey") % 2 == 0, F.array(lit("tcp"), lit("http"))).when(C("s_suppkey") % 3 != 0, F.array(lit("udp")))
    how = lambda mode: R.metadata_matches(module, held, lit(None).cast("string"), ("3", "4"), "http", "s9", mode)
    return s.select("s_suppkey", how("strict").alias("strict"), how("relaxed").alias("relaxed"))
