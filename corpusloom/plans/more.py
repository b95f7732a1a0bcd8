"""Sources and sinks read back, chunkers, chats, scorers, graphs, tasks and event logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.functions import text as X
from corpusloom.operators import chunk, scorers
from corpusloom.operators import events as T
from corpusloom.operators import graph as N
from corpusloom.plans import register
from corpusloom.session import shared_dir, table
from corpusloom.sources import files as K

C, lit = F.col, F.lit


def _t(spark, d, name):
    return table(spark, d, name)


def _folder(spark):
    return f"{shared_dir(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def _named(spark, d):
    """Files made of documents: one in three a text, a JSON record or a page."""
    k = C("doc_id") % 3
    body = F.when(k == 0, C("text")).when(k == 1, F.to_json(F.struct(C("doc_id").alias("id"), C("source").alias("src")))).otherwise(F.concat(lit("<html><p>"), C("source"), lit("</p>\n  \n<b>x &amp; y</b></html>")))
    name = F.concat(C("doc_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".json").otherwise(".html"))
    return _t(spark, d, "documents").select(name.alias("name"), body.cast("binary").alias("raw"))


_FILES = r"SELECT doc_id || '.txt' AS name, regexp_replace(regexp_replace(text, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS page_content FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id || '.json', '{\"id\":' || doc_id || coalesce(',\"src\":\"' || source || '\"', '') || '}' FROM documents WHERE doc_id % 3 = 1".replace('\\"', '"')


@register("s01_file_reader", _FILES)
def s01(spark, d):
    path = _folder(spark)
    rows = _named(spark, d).where(~F.endswith("name", lit(".html")))
    rows.write.parquet(path)  # files as rows: the reader of a folder of files gives the same columns
    return K.text_documents(K.raw_documents(spark, spark.read.parquet(path))).select("name", "page_content")


@register("s02_raw_bytes", "SELECT doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.json' ELSE '.html' END AS name, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'json' ELSE 'html' END AS extension FROM documents")
def s02(spark, d):
    return K.raw_documents(spark, _named(spark, d)).select("name", "extension")


@register("s04_json_document", "SELECT doc_id, '{\"id\":' || doc_id || ',\"n\":' || n_chars || '}' AS content FROM documents")
def s04(spark, d):
    raw = F.to_json(F.struct(C("doc_id").alias("id"), C("n_chars").alias("n")))
    return _t(spark, d, "documents").select("doc_id", F.to_json(F.try_parse_json(F.concat(lit("  "), raw, lit(" ")))).alias("content"))


@register("s05_html_text")
def s05(spark, d):
    """The text of every page; tests hold it against hand-made pages."""
    return _t(spark, d, "pages").select("page_id", K.html_text(C("html")).alias("text"))


@register("s09_elements", r"WITH p AS (SELECT doc_id AS id, regexp_split_to_array(text, '\n\s*\n|\n') AS a FROM documents), u AS (SELECT id, generate_subscripts(a, 1) - 1 AS i, trim(unnest(a)) AS t FROM p) SELECT id, CAST(i AS INT) AS i, CASE WHEN regexp_matches(t, '^(?:[-*\x{2022}]|\d+[.)])\s+') THEN 'ListItem' WHEN length(t) <= 60 AND NOT regexp_matches(t, '[.,;:!?]$') THEN 'Title' ELSE 'NarrativeText' END AS kind FROM u WHERE t <> ''")
def s09(spark, d):
    return chunk.elements(_t(spark, d, "documents").select(C("doc_id").alias("id"), "text")).select("id", "i", "kind")


_PART = "SELECT p_partkey, p_name, p_size FROM part"


def _part(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_name", "p_size")


_SCHEMA = "p_partkey long, p_name string, p_size int"


@register("s12_csv", _PART)
def s12(spark, d):
    path = _folder(spark)
    K.write_csv(_part(spark, d), path)
    return K.read_csv(spark, path, _SCHEMA)


@register("s16_jsonl", _PART + " WHERE p_partkey % 10 <> 0")
def s16(spark, d):
    path = _folder(spark)
    good = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    _part(spark, d).select(F.when(C("p_partkey") % 10 != 0, good).when(C("p_partkey") % 20 == 0, "  ").otherwise("{broken").alias("value")).write.text(path)
    return K.read_jsonl(spark, path, _SCHEMA, strict=False)[0]


@register("s17_json_array", _PART)
def s17(spark, d):
    path = _folder(spark)
    p = _part(spark, d).withColumn("page", F.floor(C("p_partkey") / 500))
    p.groupBy("page").agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("value")).select("value").write.text(path)  # an array of 500 on each line
    return spark.read.text(path).select(F.explode(F.from_json("value", f"array<struct<{_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("r.*")


@register("s18_in_memory", "SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) t(i, v)")
def s18(spark, d):
    return spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, v string")


@register("s19_seed_instructions", "SELECT trim(p_name) AS instruction, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY 1")
def s19(spark, d):
    path = _folder(spark)
    _t(spark, d, "part").select(F.when(C("p_size") % 4 != 0, F.concat(lit(" "), C("p_name"), lit(" "))).otherwise(" ").alias("instruction")).write.json(path)
    seeds = spark.read.schema("instruction string").json(path).select(F.trim("instruction").alias("instruction")).where("instruction <> ''")
    return seeds.groupBy("instruction").agg(F.count(lit(1)).alias("n"))


@register("s20_key_values", "SELECT event_id, event_type AS kind FROM events")
def s20(spark, d):
    path = _folder(spark)
    e = _t(spark, d, "events").select("event_id", C("event_type").alias("kind"))
    K.write_jsonl(e.where("event_id % 2 = 0"), path)
    K.write_jsonl(e.where("event_id % 2 = 1"), path, append=True)
    return spark.read.schema("event_id long, kind string").json(path)


@register("s23_crawl", "WITH RECURSIVE l AS (SELECT page_id AS a, (page_id * 2) % 97 AS b FROM pages UNION SELECT page_id, (page_id * 3 + 1) % 97 FROM pages), c AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION SELECT l.b, c.depth + 1 FROM c JOIN l ON l.a = c.id WHERE c.depth < 3) SELECT id, CAST(min(depth) AS INT) AS depth FROM c GROUP BY id")
def s23(spark, d):
    p = _t(spark, d, "pages").select(C("page_id").alias("src"))
    links = p.select("src", ((C("src") * 2) % 97).alias("dst")).unionByName(p.select("src", ((C("src") * 3 + 1) % 97).alias("dst"))).distinct()
    return N.crawl(links, spark.createDataFrame([(1,)], "id long"), 3)


@register("k01_json_array", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part")
def k01(spark, d):
    path = _folder(spark)
    K.write_json_array(_part(spark, d), path, "p_partkey")
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\[|[\],]$", "").alias("line"))
    return lines.select(F.from_json("line", _SCHEMA).alias("r")).agg(F.count("r.p_partkey").alias("n"), F.sum("r.p_size").alias("sizes"))


@register("k02_jsonl", _PART)
def k02(spark, d):
    path = _folder(spark)
    K.write_jsonl(_part(spark, d).where("p_size < 20"), path)
    K.write_jsonl(_part(spark, d).where("p_size >= 20"), path, append=True)
    return K.read_jsonl(spark, path, _SCHEMA)[0]


@register("k05_csv_quotes", "SELECT p_partkey, 'a, \"b\" ' || p_name AS p_name, p_size FROM part")
def k05(spark, d):
    path = _folder(spark)
    K.write_csv(_part(spark, d).withColumn("p_name", F.concat(lit('a, "b" '), C("p_name"))), path)
    return K.read_csv(spark, path, _SCHEMA)


@register("k07_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def k07(spark, d):
    e = _t(spark, d, "embeddings").select(C("vec_id").alias("id"), "label")
    return K.upsert_records(e, e.where("id % 5 = 0").withColumn("label", C("label") + 100))


@register("k09_exports", "SELECT item_id AS id, '{\"data\":{\"text\":\"' || replace(replace(text, '\"', '\\\"'), chr(10), '\\n') || '\",\"ref_id\":' || item_id || '}}' AS json FROM benchmark")
def k09(spark, d):
    return K.exports(_t(spark, d, "benchmark").select(C("item_id").alias("id"), "text"), "label_studio")


@register("k10_versions", _PART)
def k10(spark, d):
    path = _folder(spark)
    K.versioned_write(_part(spark, d).where("p_size < 5"), path, 1)
    return spark.read.parquet(K.versioned_write(_part(spark, d), path, 2))


@register("k11_node_link", "SELECT n_name AS id, n_regionkey AS region FROM nation")
def k11(spark, d):
    path = _folder(spark)
    n = _t(spark, d, "nation").select(C("n_name").alias("id"), C("n_regionkey").alias("region"))
    N.to_node_link(n, n.select(C("id").alias("source"), C("region").cast("string").alias("target"))).write.json(path)
    return N.from_node_link(spark.read.schema("kind string, json string").json(path), "id string, region int", "source string, target string")[0]


@register("x14_title_chunks")
def x14(spark, d):
    """Title chunks of all documents; tests check their sizes and that no text is lost."""
    return chunk.title_chunks(_t(spark, d, "documents").select(C("doc_id").alias("id"), "text"))


@register("x15_markdown_sections", "SELECT p_partkey, unnest(['# A' || chr(10) || repeat(p_name || ' ', 20), '## B' || chr(10) || repeat(p_type || ' ', 20) || chr(10) || '# C']) AS section FROM part".replace("repeat(p_name || ' ', 20)", "trim(repeat(p_name || ' ', 20))"))
def x15(spark, d):
    rep = lambda c: F.repeat(F.concat(C(c), lit(" ")), 20)
    text = F.concat(lit("# A\n"), F.trim(rep("p_name")), lit("\n## B\n"), rep("p_type"), lit("\n# C"))
    return _t(spark, d, "part").select("p_partkey", F.explode(chunk.markdown_sections(text)).alias("section"))


@register("x13_code_chunks", "SELECT p_partkey, i AS chunk, 'def f' || i || '():' || chr(10) || repeat('    ' || p_name || chr(10), 9) || '    end' AS code FROM part, range(3) t(i)")
def x13(spark, d):
    block = lambda i: F.concat(lit(f"def f{i}():\n"), F.repeat(F.concat(lit("    "), C("p_name"), lit("\n")), 9), lit("    end"))
    text = F.concat_ws("\n", block(0), lit("![image](x.png)"), block(1), block(2))
    return _t(spark, d, "part").select("p_partkey", F.posexplode(chunk.code_chunks(text, 64, early=0.5)).alias("chunk", "code"))


@register("x12_instances", "SELECT p_partkey, 'yes' AS label, p_name AS input FROM part UNION ALL SELECT p_partkey, 'no', p_type FROM part")
def x12(spark, d):
    text = F.concat(lit("Class label: yes\nInput: "), C("p_name"), lit("\nClass label: no\n"), C("p_type"))
    return _t(spark, d, "part").select("p_partkey", F.explode(chunk.labelled_instances(text)).alias("x")).select("p_partkey", "x.*")


@register("x12_generations", "SELECT p_partkey, p_name AS input, p_type AS output FROM part UNION ALL SELECT p_partkey, '', p_brand FROM part")
def x12b(spark, d):
    text = F.concat(lit("Example 1\n"), C("p_name"), lit("\nOutput: "), C("p_type"), lit("\nExample 2\nOutput: "), C("p_brand"))
    return _t(spark, d, "part").select("p_partkey", F.explode(chunk.generated_instances(text)).alias("x")).select("p_partkey", "x.*")


_FROM = "CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'tool' THEN 'observation' ELSE role END"


@register("c03_normalised", f"SELECT conv_id, turn, {_FROM} AS \"from\", text AS value FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'You are helpful.' FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def c03(spark, d):
    from corpusloom.operators.conversation import normalised

    return normalised(_t(spark, d, "conversations"), "You are helpful.")


@register("c04_roles", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'function_call' WHEN role = 'assistant' THEN 'gpt' WHEN role = 'user' THEN 'human' ELSE role END AS \"from\", CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN role END AS call FROM conversations")
def c04(spark, d):
    from corpusloom.operators.conversation import sharegpt_rows

    call = P.hermes_format(C("role"), lit("{}"))
    c = _t(spark, d, "conversations").withColumn("text", F.when((C("role") == "assistant") & (C("turn") % 4 == 1), call).otherwise(F.lit("plain")))
    return sharegpt_rows(c).select("conv_id", "turn", "from", "call")


@register("c05_round_trip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def c05(spark, d):
    from corpusloom.operators.conversation import from_records, to_records

    return from_records(to_records(_t(spark, d, "conversations"))).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register("c06_history", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 = 1 AND turn % 2 = 0 UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 1")
def c06(spark, d):
    from corpusloom.operators.conversation import history

    c = _t(spark, d, "conversations").select("conv_id", "turn")
    return history(c.where("conv_id % 3 = 1 AND turn % 2 = 0"), c)


@register("e01_answer_kinds", "SELECT p_partkey, p_partkey % 6 IN (0, 2, 4) AS same FROM part")
def e01(spark, d):
    from corpusloom.operators.evaluate import same_answer

    k, name = C("p_partkey") % 6, C("p_name")
    answer = F.when(k == 0, lit("$1,200")).when(k == 1, lit("about 12")).when(k == 2, F.concat(name, lit("; 3.0"))).when(k == 3, F.concat(name, lit(", 3, 4"))).when(k == 4, F.concat(F.upper(name), lit("!"))).otherwise(C("p_type"))
    truth = F.when(k == 0, lit("1200")).when(k == 1, lit("12")).when(k == 2, F.concat(name, lit(",3"))).when(k == 3, F.concat(name, lit(",3"))).when(k == 4, name).otherwise(name)
    return _t(spark, d, "part").select("p_partkey", same_answer(answer, truth).alias("same"))


@register("e02_call_equality", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS same FROM part")
def e02(spark, d):
    k, n = C("p_partkey") % 4, C("p_size").cast("string")
    a = F.when(k < 3, F.concat(lit("find(name='x', size="), n, lit(")"))).otherwise("not a call (")
    b = F.when(k == 0, F.concat(lit("find(size="), n, lit(", name='x'); other()"))).when(k == 1, F.concat(lit("find(size="), n, lit(", name='y')"))).when(k == 2, F.concat(lit("look(size="), n, lit(", name='x')"))).otherwise("neither )")
    return _t(spark, d, "part").select("p_partkey", scorers.same_call(a, b).alias("same"))


@register("e03_api_match", "SELECT p_partkey, p_partkey % 3 = 0 AS correct FROM part")
def e03(spark, d):
    k, n = C("p_partkey") % 3, C("p_size").cast("string")
    code = F.when(k == 0, F.concat(lit("x = hub.load('a', size="), n, lit(")"))).when(k == 1, lit("x = hub.load('b')")).otherwise("hub.list()")
    return _t(spark, d, "part").select("p_partkey", scorers.call_in_code(code, lit("hub.load"), F.array(lit("'a'"), F.concat(lit("size="), n))).alias("correct"))


@register("e05_metrics", "WITH b AS (SELECT quality = 1 AS ok, n_chars / 10000.0::DOUBLE AS s, quality AS q FROM documents JOIN labels USING (doc_id)) SELECT round(sqrt(avg(pow(s - q, 2))), 6) AS rmse, count(*) AS n FROM b")
def e05(spark, d):
    from corpusloom.operators.evaluate import rmse

    both = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return both.agg(F.round(rmse(C("n_chars") / 10000.0, C("quality").cast("double")), 6).alias("rmse"), F.count(lit(1)).alias("n"))


@register("e07_math", "SELECT p_partkey, p_partkey % 4 <> 2 AS same FROM part")
def e07(spark, d):
    k, n = C("p_partkey") % 4, C("p_size").cast("string")
    a = F.when(k == 0, F.concat(lit(r"\frac{"), n, lit("}{4}"))).when(k == 1, F.concat(lit(r"\sqrt{"), n, lit("} + 1"))).when(k == 2, F.concat(n, lit(".001"))).otherwise("x + y")
    b = F.when(k == 0, (C("p_size") / 4).cast("string")).when(k == 1, F.concat(lit("1+"), n, lit("^{0.5}"))).when(k == 2, n).otherwise("x+y")
    return _t(spark, d, "part").select("p_partkey", scorers.same_math(a, b).alias("same"))


@register("e09_quantities", "SELECT p_partkey, p_partkey % 3 = 0 AS same FROM part")
def e09(spark, d):
    k, n = C("p_partkey") % 3, C("p_size")
    q = lambda v, u: F.struct(v.cast("string").alias("value"), lit(u).alias("unit"))
    same = F.when(k == 0, scorers.same_quantity(q(n * 1000, "m"), q(n, "km"))).when(k == 1, scorers.same_quantity(q(n * 1000, "g"), q(n, "km"))).otherwise(scorers.same_quantity(q(n * 1000, "g"), q(n * 2, "kg")))
    return _t(spark, d, "part").select("p_partkey", same.alias("same"))


@register("e10_verified", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL OR doc_id % 7 = 0 THEN 'error' WHEN quality = 1 THEN 'success' ELSE 'failure' END AS status FROM labels) GROUP BY status")
def e10(spark, d):
    check = F.when(C("doc_id") % 7 != 0, C("quality") == 1)
    return scorers.verified(_t(spark, d, "labels"), check).groupBy("status").agg(F.count(lit(1)).alias("n"))


@register("e11_extractors", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS answer FROM part")
def e11(spark, d):
    k = C("p_partkey") % 3
    text = F.when(k == 0, F.concat(lit(r"so \boxed{"), C("p_name"), lit("}"))).when(k == 1, F.concat(lit("FINAL ANSWER: "), C("p_type"))).otherwise(C("p_name"))
    final = lambda t: F.when(F.contains(t, lit("FINAL ANSWER: ")), X.final_answer(t))
    return _t(spark, d, "part").select("p_partkey", scorers.first_extracted(text, [[X.boxed_simple, final], [F.trim]]).alias("answer"))


@register("e12_environment", "SELECT doc_id AS index, CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.5 * toxic AS reward FROM labels")
def e12(spark, d):
    states = _t(spark, d, "labels").select(C("doc_id").alias("index"), C("toxic").alias("truth"))
    actions = _t(spark, d, "labels").select(C("doc_id").alias("index"), C("quality").alias("answer"))
    return scorers.step_environment(states, actions, F.when(C("answer") == C("truth"), 1.0).otherwise(0.0) + 0.5 * C("truth")).select("index", "reward")


@register("g08_personas", "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS place, unnest(string_split(p_name, ' ')) AS name, 'likes ' || p_type AS description FROM part")
def g08(spark, d):
    each = F.array_join(F.transform(F.split("p_name", " "), lambda w, i: F.concat((i + 1).cast("string"), lit(". persona_name: "), w, lit("; persona_description: likes "), C("p_type"))), "\n")
    found = _t(spark, d, "part").select("p_partkey", F.posexplode(P.personas(each)).alias("i", "p"))
    return found.select("p_partkey", (C("i") + 1).alias("place"), "p.name", "p.description")


@register("g09_prompt_grid", "SELECT 'As ' || r_name || ', write of ' || p_type || '.' AS prompt FROM region, (SELECT DISTINCT p_type FROM part)")
def g09(spark, d):
    roles, topics = _t(spark, d, "region").select("r_name"), _t(spark, d, "part").select("p_type").distinct()
    return roles.crossJoin(topics).select(F.format_string("As %s, write of %s.", "r_name", "p_type").alias("prompt"))  # the grid is the feature


def _triples(spark, d):
    return _t(spark, d, "supplier").join(_t(spark, d, "nation"), C("s_nationkey") == C("n_nationkey")).select(C("s_name").alias("subj"), lit("IN").alias("rel"), C("n_name").alias("obj"))


@register("n03_delete", "WITH e AS (SELECT s_name AS subj, n_name AS obj, s_suppkey % 3 = 0 AS gone FROM supplier JOIN nation ON s_nationkey = n_nationkey), l AS (SELECT * FROM e WHERE NOT gone) SELECT id FROM (SELECT s_name AS id FROM supplier UNION ALL SELECT n_name FROM nation) WHERE id NOT IN (SELECT subj FROM e WHERE gone UNION SELECT obj FROM e WHERE gone) OR id IN (SELECT subj FROM l UNION SELECT obj FROM l)")
def n03(spark, d):
    e = _triples(spark, d)
    nodes = _t(spark, d, "supplier").select(C("s_name").alias("id")).unionByName(_t(spark, d, "nation").select(C("n_name").alias("id")))
    gone = e.where(F.substring("subj", -9, 9).cast("int") % 3 == 0)
    return N.delete_triplets(nodes, e, gone)[0]


@register("n05_bulk", "SELECT r_name AS subj, 'HAS' AS rel, n_name AS obj FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'doc', 'MENTIONS', n_name FROM nation UNION SELECT 'doc', 'MENTIONS', r_name FROM region")
def n05(spark, d):
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    node = lambda c, t: F.struct(C(c).alias("id"), lit(t).alias("type"))
    elements = rows.select(lit("doc").alias("source"), F.array(node("n_name", "Nation"), node("r_name", "Region")).alias("nodes"), F.array(F.struct(C("r_name").alias("subj"), C("n_name").alias("obj"), lit("HAS").alias("type"))).alias("relations"))
    return N.bulk_elements(elements, mentions=True)[1]


@register("n06_patterns", "SELECT DISTINCT 'Supplier' AS start, 'IN' AS rel, 'Nation' AS \"end\" FROM supplier")
def n06(spark, d):
    nodes = _t(spark, d, "supplier").select(C("s_name").alias("id"), lit("Supplier").alias("label")).unionByName(_t(spark, d, "nation").select(C("n_name").alias("id"), lit("Nation").alias("label")))
    return N.edge_patterns(nodes, _triples(spark, d))


@register("n08_graph", "WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), u AS (SELECT a AS id, b AS other, n FROM e UNION ALL SELECT b, a, n FROM e) SELECT id, count(*) AS degree, CAST(sum(n) AS BIGINT) AS multi_degree, min(other) AS first FROM u GROUP BY id")
def n08(spark, d):
    """The undirected multigraph of parts and suppliers: neighbours, parallel edges and first neighbour of every node."""
    ends = (F.concat(lit("p"), C("l_partkey").cast("string")), F.concat(lit("s"), C("l_suppkey").cast("string")))
    e = _t(spark, d, "lineitem").groupBy(ends[0].alias("a"), ends[1].alias("b")).agg(F.count(lit(1)).alias("n"))
    both = e.select(C("a").alias("id"), C("b").alias("other"), "n").unionByName(e.select(C("b").alias("id"), C("a").alias("other"), "n"))
    return both.groupBy("id").agg(F.count(lit(1)).alias("degree"), F.sum("n").alias("multi_degree"), F.min("other").alias("first"))


@register("n09_shortest_path", "WITH s AS (SELECT n_regionkey AS r FROM nation WHERE n_name = 'NATION_3') SELECT n_name AS id, CASE WHEN n_name = 'NATION_3' THEN 0.0::DOUBLE ELSE 5.0::DOUBLE + n_nationkey END AS cost, CASE WHEN n_name = 'NATION_3' THEN n_name ELSE 'NATION_3>' || r_name || '>' || n_name END AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = (SELECT r FROM s) UNION ALL SELECT r_name, 4.0::DOUBLE, 'NATION_3>' || r_name FROM region WHERE r_regionkey = (SELECT r FROM s)")
def n09(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    e = n.select(C("n_name").alias("src"), C("r_name").alias("dst"), (C("n_nationkey") + 1.0).alias("weight"))
    return N.shortest_paths(e, "NATION_3").select("id", "cost", F.array_join("path", ">").alias("path"))


@register("n12_delta_merge", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey > 60 THEN 60 + rn ELSE s_suppkey END AS hrid FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 5 = 0 OR s_suppkey > 60 ORDER BY s_suppkey) AS rn FROM supplier)")
def n12(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", C("s_suppkey").alias("hrid"))
    return N.delta_merge(s.where("s_suppkey <= 60"), s.where("s_suppkey % 5 = 0 OR s_suppkey > 60"), "s_suppkey", "hrid")


@register("n13_inspect", "WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), n AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id) SELECT id, degree, dense_rank() OVER (ORDER BY degree DESC) AS rank FROM n")
def n13(spark, d):
    from corpusloom.plans.relational import _part_supplier

    return N.entity_frequency(_part_supplier(spark, d))


@register("n16_scenarios", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) <= 5) SELECT p_brand, p_type, r_name AS protocol FROM t, (SELECT r_name FROM region ORDER BY r_name LIMIT 5)")
def n16(spark, d):
    counts = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(lit(1)).alias("n"))
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("rn <= 5")
    five = _t(spark, d, "region").select(C("r_name").alias("protocol")).orderBy("protocol").limit(5)
    return top.select("p_brand", "p_type").crossJoin(five)  # five rows


@register("a12_full_kpis", "WITH e AS (SELECT user_id, event_id, event_type, ts FROM events), f AS (SELECT user_id, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'error') AS bad FROM e GROUP BY 1) SELECT (SELECT count(*) FROM f) AS created, (SELECT count(*) FROM f WHERE done) AS completed, (SELECT count(*) FROM f WHERE bad AND NOT done) AS failed, (SELECT count(*) FROM f WHERE NOT bad AND NOT done) AS pending, round(((SELECT count(*) FROM f WHERE done)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7::DOUBLE), 6) AS per_minute FROM e")
def a12(spark, d):
    e = _t(spark, d, "events").select(C("user_id").alias("task_id"), F.when(C("event_type") == "purchase", "completed").when(C("event_type") == "error", "failed").otherwise("created").alias("kind"), "ts")
    return T.workforce_kpis(e).withColumn("per_minute", F.round("per_minute", 6))


@register("t02_current_rate", "SELECT user_id, arg_max(requests, event_id) AS requests, arg_max(tokens, event_id) AS tokens FROM (SELECT user_id, event_id, count(*) OVER w AS requests, CAST(sum(length(props)) OVER w AS BIGINT) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)) GROUP BY user_id")
def t02(spark, d):
    load = T.trailing_load(_t(spark, d, "events"), "user_id", 60, F.length("props").cast("long"))
    return load.groupBy("user_id").agg(F.max_by("requests", "event_id").alias("requests"), F.max_by("tokens", "event_id").alias("tokens"))


@register("t03_event_log", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t03(spark, d):
    """The event log as a stream of files, counted to its end and read back."""
    from corpusloom.streaming.events import drain, read_events

    path = _folder(spark)
    _t(spark, d, "events").repartition(4).write.parquet(f"{path}/in")
    counts = read_events(spark, f"{path}/in").groupBy("event_type").agg(F.count(lit(1)).alias("n"))
    return drain(counts, f"{path}/out", f"{path}/checkpoint")


@register("t04_auto", "SELECT o_orderkey AS task_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'FAIL' ELSE 'READY' END AS decision FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def t04(spark, d):
    tasks = _t(spark, d, "orders").select(C("o_orderkey").alias("task_id"))
    state = F.when(C("l_returnflag") == "R", "FAILED").when(C("l_returnflag") == "N", "OPEN").otherwise("DONE")
    return T.auto_ready(tasks, _t(spark, d, "lineitem").select(C("l_orderkey").alias("task_id"), state.alias("dep_state")))


@register("t06_pipeline", "SELECT 'n' || n_nationkey AS task_id, 'r' || n_regionkey AS dep_id FROM nation UNION ALL SELECT 'join', 'n' || n_nationkey FROM nation")
def t06(spark, d):
    n = _t(spark, d, "nation").select(F.concat(lit("n"), C("n_nationkey").cast("string")).alias("task_id"), F.concat(lit("r"), C("n_regionkey").cast("string")).alias("dep_id"))
    return T.fork_join(n, "join")


@register("t07_new_tasks", "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents".replace("generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i", "CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS i"))
def t07(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    piece = F.concat(F.when(C("at") > 0, "sk>").otherwise("<task>"), lit("a task</task>\n<ta"))  # the next tag is cut
    return T.new_tasks(lines.select("doc_id", "at", piece.alias("piece")), "doc_id", "at", "piece").where("i = at AND content = 'a task'").select("doc_id", "i")


@register("t11_race", "SELECT user_id, arg_min(event_id, (value, event_id)) AS winner FROM events WHERE event_type <> 'error' GROUP BY user_id")
def t11(spark, d):
    return T.race(_t(spark, d, "events").select(C("user_id").alias("call"), C("event_id").alias("model"), (C("event_type") != "error").alias("ok"), C("value").alias("latency"))).select(C("call").alias("user_id"), C("model").alias("winner"))


@register("t11_balance", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3 AS model FROM events")
def t11b(spark, d):
    return T.balance(_t(spark, d, "events"), "user_id", "event_id", 3).select("event_id", "model")


@register("f05_grouped_median", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def f05(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))
