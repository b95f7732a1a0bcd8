"""Queries over the functions that read structure out of text. Where no table holds the form, it is built from its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.functions import text as X
from corpusloom.plans import register
from corpusloom.session import table

C, L = F.col, F.lit


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _parts(spark, d):
    return table(spark, d, "part")


def _cleaner(name, sql):
    @register(f"x01_{name}", f"SELECT doc_id, {sql} AS t FROM documents")
    def run(spark, d):
        return _docs(spark, d).select("doc_id", X.clean(C("text"), (name,)).alias("t"))


_cleaner("bullets", r"regexp_replace(text, '^[\x{2022}\x{25E6}\x{25AA}\x{00B7}*]\s*', '')")
_cleaner("ordered_bullets", r"regexp_replace(text, '^\s*(\d+\.)+\d*\s+', '')")
_cleaner("dashes", r"trim(regexp_replace(text, '[-\x{2013}]', ' ', 'g'))")
_cleaner("trailing_punctuation", "rtrim(trim(text), '.,:;')")
_cleaner("punctuation", r"regexp_replace(text, '\p{P}', '', 'g')")
_cleaner("unicode_quotes", "translate(text, '‘’“”', '''''\"\"')")


@register("x01_prefix_postfix", r"SELECT doc_id, regexp_replace(regexp_replace(text, '^(The|La|Der)[\s.,]*', ''), '[\s.,]*(une|the|der)\.?$', '') AS t FROM documents")
def x01_prefix_postfix(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_postfix(X.clean_prefix(C("text"), "(The|La|Der)"), r"(une|the|der)\.?").alias("t"))


@register("x01_bytes_string", "SELECT n_nationkey, n_name || ' é' AS t FROM nation")
def x01_bytes(spark, d):
    raw = F.concat(L("b'"), C("n_name"), L(r" \xc3\xa9'"))
    return table(spark, d, "nation").select("n_nationkey", X.bytes_string(raw).alias("t"))


@register("x02_dates", r"SELECT o_orderkey, array_to_string(regexp_extract_all('due ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ' or ' || strftime(o_orderdate, '%Y-%m-%d'), '\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?'), ',') AS dates FROM orders")
def x02_dates(spark, d):
    ts = C("o_orderdate").cast("timestamp")
    text = F.concat(L("due "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), L(" or "), F.date_format(ts, "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(P.dates(text), ",").alias("dates"))


@register("x02_mapi_ids", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'), ',') AS ids FROM documents")
def x02_mapi(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.mapi_ids(C("text")), ",").alias("ids"))


@register("x02_ordered_bullets", r"SELECT part_no AS p_partkey, a, b, c FROM (SELECT p_partkey AS part_no, '1' AS a, CAST(p_size AS VARCHAR) AS b, '' AS c FROM part)")
def x02_bullets(spark, d):
    got = X.ordered_bullet_parts(F.concat(L("1."), C("p_size").cast("string"), L(" "), C("p_name")))
    return _parts(spark, d).select("p_partkey", *[F.get(got, L(i)).alias(n) for i, n in enumerate("abc")])


@register("x02_text_around", "SELECT p_partkey, split_part(p_name, ' ', 1) AS before, split_part(p_name, ' ', 2) AS after FROM part")
def x02_around(spark, d):
    return _parts(spark, d).select("p_partkey", F.trim(X.text_before(C("p_name"), " ")).alias("before"), F.trim(X.text_after(C("p_name"), " ")).alias("after"))


@register("x02_phones", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\+?\d?[ -]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}'), ',') AS phones FROM documents")
def x02_phones(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.us_phones(C("text")), ",").alias("phones"))


@register("x03_chunk_clean", r"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '(\w+)-\s+(\w+)', '\1\2', 'g'), '\s+', ' ', 'g')), '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]', '', 'g') AS t FROM documents")
def x03(spark, d):
    return _docs(spark, d).select("doc_id", P.chunk_clean(C("text")).alias("t"))


@register("x04_keyword_list", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(lower(text), '[a-z]{3,}'), regexp_extract_all(text, '[A-Z]{2,}')), list_transform(regexp_extract_all('配置虚拟' || text || '服务', '[一-龥]{2}'), lambda x: x)))), ' ') AS words FROM documents")
def x04_list(spark, d):
    text = F.concat(L("配置虚拟"), C("text"), L("服务"))
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.concat(X.keywords(C("text")), X.han_grams(text, 2, step=2)))), " ").alias("words"))


_RULES = (("licence", ("licensed", "copyright")), ("contact", ("@", "phone")), ("german", (" und ", " der ")), ("french", (" la ", " des ")))


def _any(words, text="lower(text)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _n(words, text="lower(text)"):
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


@register("x05_rule_metadata", f"SELECT doc_id, CASE {' '.join(f'''WHEN {_any(w)} THEN '{n}' ''' for n, w in _RULES)} ELSE 'general' END AS intent, array_to_string(list_filter([{', '.join(f'''CASE WHEN {_any(w)} THEN '{n}' END''' for n, w in _RULES)}], lambda x: x IS NOT NULL), ',') AS protocols FROM documents")
def x05(spark, d):
    return _docs(spark, d).select("doc_id", P.first_rule(C("text"), _RULES, "general").alias("intent"), F.array_join(P.all_rules(C("text"), _RULES), ",").alias("protocols"))


@register("x06_step_detection", f"WITH h AS (SELECT doc_id, [{', '.join(f'''struct_pack(n := {_n(w)}, p := {-i}, name := '{n}')''' for i, (n, w) in enumerate(_RULES))}] AS a FROM documents) SELECT doc_id, CASE WHEN list_max(a).n > 0 THEN list_max(a).name END AS step FROM h")
def x06(spark, d):
    return _docs(spark, d).select("doc_id", P.best_rule(C("text"), _RULES).alias("step"))


_FILES = ("test_list_v1.xlsx", "Func Spec.docx", "regress TEST.xlsx", "notes.docx", "table.xlsx", "readme.txt")


@register("x07_document_classes", "WITH k(i, class, c1, c2) AS (VALUES (0, 'test/test_list', 0.9, 0.9), (1, 'spec/func_spec', 0.9, 0.9), (2, 'test/test_list', 0.8, 0.8), (3, 'spec/func_spec', 0.3, 0.7), (4, 'test/test_list', 0.4, 0.7), (5, 'unknown', 0.0, 0.7)) SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND c2 = 0.7 THEN 'spec/prd' ELSE class END AS class, CAST(CASE WHEN doc_id % 4 = 0 THEN c2 ELSE c1 END AS DOUBLE) AS confidence FROM documents JOIN k ON doc_id % 6 = i")
def x07(spark, d):
    name = F.element_at(F.array(*[L(f) for f in _FILES]), (C("doc_id") % 6 + 1).cast("int"))
    text = F.when(C("doc_id") % 4 == 0, F.concat(C("text"), L("\nProduct Requirement (PRD)"))).otherwise(C("text"))
    found = P.classify_document(name, text)
    return _docs(spark, d).select("doc_id", found["class"].alias("class"), found["confidence"].alias("confidence"))


@register("x08_heading", r"SELECT p_partkey, CAST(2 + p_size % 2 AS INT) AS level, p_name AS title FROM part UNION ALL SELECT -1 - n_nationkey, 1, n_name FROM nation UNION ALL SELECT -1000 - r_regionkey, 0, r_name FROM region")
def x08(spark, d):
    number = F.when(C("p_size") % 2 == 0, "3.1. ").otherwise("3.1.4 ")
    a = _parts(spark, d).select("p_partkey", F.concat(number, C("p_name")).alias("t"))
    b = table(spark, d, "nation").select((-1 - C("n_nationkey")).cast("long").alias("p_partkey"), F.concat(L("第12章 "), C("n_name")).alias("t"))
    c = table(spark, d, "region").select((-1000 - C("r_regionkey")).cast("long").alias("p_partkey"), C("r_name").alias("t"))
    return a.unionAll(b).unionAll(c).select("p_partkey", P.heading_level(C("t")).alias("level"), P.strip_heading(C("t")).alias("title"))


@register("x09_markdown_table", "SELECT p_partkey, 0 AS row_no, 'name;type' AS cells FROM part UNION ALL SELECT p_partkey, 1, p_name || ';' || p_type FROM part UNION ALL SELECT p_partkey, 2, p_brand || ';' FROM part")
def x09(spark, d):
    text = F.concat(L("before\n| name | type |\n| --- | :-: |\n| "), C("p_name"), L(" | "), C("p_type"), L("|\n| "), C("p_brand"), L(" | |\nafter"))
    return _parts(spark, d).select("p_partkey", F.posexplode(P.markdown_rows(text)).alias("row_no", "cells")).select("p_partkey", "row_no", F.array_join("cells", ";").alias("cells"))


_HEADS = ("the", "and", "la ", "un", "der", "of")


@register("x10_header_line", f"WITH l AS (SELECT doc_id, string_split(lower(text), chr(10))[1:10] AS a FROM documents) SELECT doc_id, CAST(coalesce(list_position(list_transform(a, lambda x: {_n(_HEADS, 'x')} >= 3), true), 0) - 1 AS INT) AS header FROM l")
def x10(spark, d):
    return _docs(spark, d).select("doc_id", P.header_line(C("text"), _HEADS).alias("header"))


@register("x16_alpaca_round", "SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS output, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS input, 'Say it as ' || role AS instruction FROM conversations WHERE trim(text) <> ''".replace("\\\\", "\\"))
def x16(spark, d):
    c = table(spark, d, "conversations").where(F.trim("text") != "")
    text = P.render_alpaca(F.concat(L("Say it as "), C("role")), F.when(C("turn") % 2 == 0, C("role")), C("text"))
    return c.select("conv_id", "turn", P.parse_alpaca(text).alias("a")).select("conv_id", "turn", "a.*")


@register("x17_triplets", "SELECT s_suppkey, n_name AS subj, r_name AS obj, 'IN' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def x17(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "supplier").join(F.broadcast(n), C("s_nationkey") == C("n_nationkey")).join(F.broadcast(r), C("n_regionkey") == C("r_regionkey"))  # 25 and 5 rows
    node = lambda c, t: F.concat(L("Node(id='"), c, L(f"', type='{t}')"))
    edge = lambda a, b, t: F.concat(L("Relationship(subj="), a, L(", obj="), b, L(f", type='{t}', timestamp='1')"))
    text = F.concat_ws("\n", node(C("n_name"), "Nation"), node(C("r_name"), "Region"), edge(node(C("n_name"), "Nation"), node(C("r_name"), "Region"), "IN"))
    found = rows.select("s_suppkey", F.explode(P.graph_relations(text)).alias("e"))
    return found.select("s_suppkey", "e.*")


@register("x19_tasks", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS content, generate_subscripts(a, 1) - 1 AS i FROM l) SELECT doc_id || '.' || i AS task_id, trim(content) AS content FROM u")
def x19(spark, d):
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(L("<task>"), x, L("</task>"))), "\n")
    found = _docs(spark, d).select("doc_id", F.posexplode(P.tasks(F.concat(text, L("<task>open")))).alias("i", "content"))
    return found.select(F.concat_ws(".", "doc_id", "i").alias("task_id"), "content")


@register("x20_fences", "SELECT p_partkey, 0 AS n, 'text' AS kind, '' AS lang, p_name AS body FROM part UNION ALL SELECT p_partkey, 1, 'code', 'sql', 'SELECT ' || p_size || ';' FROM part UNION ALL SELECT p_partkey, 2, 'text', '', p_type FROM part")
def x20(spark, d):
    text = F.concat(C("p_name"), L("\n```sql\nSELECT "), C("p_size").cast("string"), L(";\n```\n"), C("p_type"))
    return _parts(spark, d).select("p_partkey", F.posexplode(P.fences(text)).alias("n", "f")).select("p_partkey", "n", "f.*")


@register("x21_boxed", r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a {' || p_name || '} b' WHEN p_partkey % 3 = 1 THEN p_name || '\}' END AS answer FROM part")
def x21(spark, d):
    text = F.when(C("p_partkey") % 3 == 0, F.concat(L(r"so \boxed{a {"), C("p_name"), L("} b} end"))).when(C("p_partkey") % 3 == 1, F.concat(L(r"\boxed{"), C("p_name"), L(r"\}}"))).otherwise(F.concat(L(r"\boxed{"), C("p_name")))
    return _parts(spark, d).select("p_partkey", P.boxed(text).alias("answer"))


@register("x23_final_answer", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name ELSE p_type END AS answer FROM part")
def x23(spark, d):
    text = F.when(C("p_size") > 10, F.concat(C("p_type"), L(". FINAL ANSWER: "), C("p_name"))).otherwise(C("p_type"))
    return _parts(spark, d).select("p_partkey", X.final_answer(text).alias("answer"))


@register("x24_api_call", "SELECT p_partkey, CASE WHEN p_size > 10 THEN '[Find(name=''' || p_name || ''')]' END AS call FROM part")
def x24(spark, d):
    text = F.when(C("p_size") > 10, F.concat(L("API-Request: [Find(name='"), C("p_name"), L("')] ok"))).otherwise(C("p_name"))
    return _parts(spark, d).select("p_partkey", P.api_call(text).alias("call"))


@register("x27_image_tokens", "WITH s AS (SELECT p_partkey, 200 + 37 * p_size AS w, 100 + CAST(p_partkey % 3000 AS INT) AS h FROM part), a AS (SELECT p_partkey, CASE WHEN greatest(w, h) > 2048 THEN w * 2048.0::DOUBLE / greatest(w, h) ELSE w END AS w, CASE WHEN greatest(w, h) > 2048 THEN h * 2048.0::DOUBLE / greatest(w, h) ELSE h END AS h FROM s), b AS (SELECT p_partkey, CASE WHEN least(w, h) > 768 THEN w * 768.0::DOUBLE / least(w, h) ELSE w END AS w, CASE WHEN least(w, h) > 768 THEN h * 768.0::DOUBLE / least(w, h) ELSE h END AS h FROM a) SELECT p_partkey, CAST(85 + 170 * ceil(h / 512) * ceil(w / 512) AS BIGINT) AS tokens FROM b")
def x27_image(spark, d):
    return _parts(spark, d).select("p_partkey", X.image_tokens(200 + 37 * C("p_size"), 100 + (C("p_partkey") % 3000).cast("int")).alias("tokens"))


@register("x28_command_prefix", r"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'slb virtual ' || split_part(p_name, ' ', 1) || ',slb virtual,show slb virtual,show slb' WHEN 1 THEN 'no ' || split_part(p_name, ' ', 1) ELSE p_name || ',' || split_part(p_name, ' ', 1) END AS prefixes FROM part")
def x28(spark, d):
    query = F.when(C("p_partkey") % 3 == 0, F.concat(L("Show SLB virtual "), C("p_name"))).when(C("p_partkey") % 3 == 1, F.concat(L("No "), C("p_name"))).otherwise(C("p_name"))
    return _parts(spark, d).select("p_partkey", F.array_join(P.command_prefixes(query), ",").alias("prefixes"))


@register("x29_inline_header", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS header, event_type AS body FROM events")
def x29(spark, d):
    text = F.when(C("event_id") % 2 == 0, F.concat(L("META_JSON:"), C("props"), L("\n"), C("event_type"))).otherwise(C("event_type"))
    return table(spark, d, "events").select("event_id", P.inline_header(text).alias("h")).select("event_id", "h.*")


@register("x30_value_unit", r"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || 'e14' ELSE p_size || ' x' END AS value, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '$\mathrm{m}$' ELSE 'kg' END AS unit FROM part")
def x30(spark, d):
    size = C("p_size").cast("string")
    text = F.when(C("p_partkey") % 3 == 0, size).when(C("p_partkey") % 3 == 1, F.concat(size, L(r" \times 10^{14} $\mathrm{m}$"))).otherwise(F.concat(size, L(" x kg")))
    both = P.value_and_unit(text)
    return _parts(spark, d).select("p_partkey", P.clean_scientific(both.value).alias("value"), both.unit.alias("unit"))


@register("x31_tool_calls", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"arguments\": ' || props || ', \"tool_name\": \"' || event_type || '\"}' WHEN 1 THEN '{\"tool_name\": \"' || event_type || '\"}' ELSE '' END AS calls FROM events")
def x31(spark, d):
    fenced = F.concat(L('Calling\n```json\n{"tool_name": "'), C("event_type"), L('", "arguments": '), C("props"), L("}\n```"))
    loose = F.concat(L("use {'tool_name': '"), C("event_type"), L("'} and {broken"))
    text = F.when(C("event_id") % 3 == 0, fenced).when(C("event_id") % 3 == 1, loose).otherwise(C("props"))
    return table(spark, d, "events").select("event_id", F.array_join(P.tool_calls(text), ";").alias("calls"))


@register("x32_hermes", "SELECT event_id, event_type AS name, props AS arguments FROM events WHERE event_id % 3 <> 2")
def x32(spark, d):
    e = table(spark, d, "events")
    good = P.hermes_format(C("event_type"), C("props"))
    single = F.concat(L("<tool_call>{'name': '"), C("event_type"), L("', 'arguments': "), F.translate(C("props"), '"', "'"), L("}</tool_call>"))
    text = F.when(C("event_id") % 3 == 0, good).when(C("event_id") % 3 == 1, single).otherwise(L("<tool_call>{nothing}</tool_call>"))
    found = e.select("event_id", F.explode(P.hermes_calls(text)).alias("c"))
    return found.select("event_id", "c.name", F.regexp_replace("c.arguments", ":", ": ").alias("arguments"))


@register("x33_function_tag", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS function, CASE WHEN event_id % 2 = 0 THEN props END AS arguments FROM events")
def x33(spark, d):
    args = F.when(C("event_id") % 2 == 0, C("props")).otherwise(L("{broken"))
    text = F.concat(L("so <function="), C("event_type"), L(">"), args, L("</function>"))
    return table(spark, d, "events").select("event_id", P.function_call(text).alias("f")).select("event_id", "f.*")


@register("x34_literals", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE '[' || array_to_string(list_sort([CAST(p_size AS VARCHAR), CAST(p_size + 100 AS VARCHAR), '9']), ', ') || ']' END AS list FROM part")
def x34(spark, d):
    size = C("p_size")
    text = F.concat(L(" ["), (size + 100).cast("string"), L(", 9, "), size.cast("string"), F.when(C("p_partkey") % 4 == 3, L("")).otherwise("]"))
    return _parts(spark, d).select("p_partkey", P.literal(text).alias("list"))


@register("x35_short_lists", "SELECT p_partkey, CASE WHEN p_size * 8 < 128 THEN CAST(p_size * 8 AS INT) ELSE -1 END AS n FROM part")
def x35(spark, d):
    values = F.sequence(L(1), C("p_size") * 8)
    return _parts(spark, d).select("p_partkey", F.coalesce(F.size(P.short_lists(values)), L(-1)).alias("n"))


@register("x38_arithmetic", "SELECT o_orderkey, CAST(round_even(o_totalprice + 0.12::DOUBLE, 2) AS DOUBLE) AS plus, CAST(round_even(o_totalprice - o_custkey, 2) AS DOUBLE) AS minus, CAST(round_even(o_totalprice * 2, 2) AS DOUBLE) AS times, CASE WHEN o_custkey % 7 > 0 THEN round(o_totalprice / (o_custkey % 7), 6) END AS per FROM orders")
def x38(spark, d):
    p, c = C("o_totalprice"), C("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.bround(p + 0.12, 2).alias("plus"), F.bround(p - c, 2).alias("minus"), F.bround(p * 2, 2).alias("times"), F.round(F.try_divide(p, c % 7), 6).alias("per"))


@register("x40_is_close", "SELECT event_id, abs(value - round(value)) <= greatest(0.001::DOUBLE * greatest(abs(value), abs(round(value))), 0.05::DOUBLE) AS near FROM events")
def x40(spark, d):
    return table(spark, d, "events").select("event_id", P.is_close(C("value"), F.round("value"), 0.001, 0.05).alias("near"))


@register("x41_seconds", "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6)::DOUBLE AS seconds FROM events GROUP BY user_id")
def x41(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", F.round(P.seconds_between(C("a"), C("b")), 6).alias("seconds"))


@register("x44_time_labels", "SELECT o_orderkey, (o_orderkey % 3 = 0) AS valid FROM orders")
def x44(spark, d):
    good = F.date_format(C("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(C("o_orderkey") % 3 == 0, good).when(C("o_orderkey") % 3 == 1, L("2024-13-45T10:00:00")).otherwise(F.date_format(C("o_orderdate").cast("timestamp"), "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(P.valid_time_label(text), L(False)).alias("valid"))
