"""Filters, text functions and sources over ``documents``, ``pages`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import curate as C
from corpusloom.plans import register
from corpusloom.session import table

_W = r"len(list_filter(regexp_split_to_array(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+'), lambda w: w <> ''))"


def _docs(spark, d):
    return table(spark, d, "documents")


@register("p01_length_filter", f"SELECT doc_id FROM documents WHERE {_W} BETWEEN 5 AND 200")
def p01(spark, d):
    return _docs(spark, d).where(C.length_filter(F.col("text"))).select("doc_id")


@register("p02_keyword_filter", "SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'image') AND NOT contains(lower(text), 'data')")
def p02(spark, d):
    return _docs(spark, d).where(C.keyword_filter(F.col("text"))).select("doc_id")


@register("p03_punctuation_filter", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '^[^\p{L}\p{N}_\s]')")
def p03(spark, d):
    return _docs(spark, d).where(C.punctuation_filter(F.col("text"))).select("doc_id")


@register("p04_english_start", "SELECT doc_id FROM documents WHERE regexp_matches(text, '^[A-Za-z]')")
def p04(spark, d):
    return _docs(spark, d).where(C.english_start_filter(F.col("text"))).select("doc_id")


@register("p06_reward_filter", "SELECT doc_id FROM labels WHERE CAST(quality AS DOUBLE) >= 0.7")
def p06(spark, d):
    return table(spark, d, "labels").where(F.col("quality").cast("double") >= 0.7).select("doc_id")


_FAILED = f"list_filter([CASE WHEN NOT ({_W} BETWEEN 5 AND 200) THEN 'length' END, CASE WHEN contains(lower(text), 'image') OR contains(lower(text), 'data') THEN 'keyword' END, CASE WHEN NOT regexp_matches(text, '^[A-Za-z]') THEN 'non_english' END], lambda x: x IS NOT NULL)"


@register("p07_filter_chain", f"SELECT doc_id, array_to_string({_FAILED}, ',') AS failed FROM documents")
def p07(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(C.failed_filters(F.col("text"), ("length", "keyword", "non_english")), ",").alias("failed"))


@register("p09_multi_threshold", "SELECT doc_id FROM labels WHERE quality >= 1 AND toxic >= 0")
def p09(spark, d):
    scores = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))
    return table(spark, d, "labels").withColumn("scores", scores).where(C.all_at_least(F.col("scores"), {"quality": 1.0, "toxic": 0.0})).select("doc_id")


@register("p12_strict_relaxed", "SELECT doc_id, source FROM (SELECT *, bool_or(n_chars >= 20000) OVER (PARTITION BY source) AS anyone FROM documents) WHERE n_chars >= 20000 OR (NOT anyone AND n_chars >= 10000)")
def p12(spark, d):
    return C.strict_then_relaxed(_docs(spark, d), "source", F.col("n_chars") >= 20000, F.col("n_chars") >= 10000).select("doc_id", "source")


@register("p14_quality_gate", r"SELECT doc_id FROM documents WHERE length(text) - length(replace(text, '.', '')) >= 2 AND CAST(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS DOUBLE) / length(text) <= CAST(0.3 AS DOUBLE)")
def p14(spark, d):
    t = F.col("text")
    return _docs(spark, d).where((X.count_of(t, ".") >= 2) & (X.special_ratio(t) <= 0.3)).select("doc_id")


@register("p15_length_gate", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) BETWEEN 50 AND 512")
def p15(spark, d):
    return _docs(spark, d).where(F.length(X.strip(F.col("text"))).between(50, 512)).select("doc_id")


@register("p22_alpaca_markers", "SELECT conv_id, turn FROM conversations WHERE NOT contains(text, '### Response') AND NOT contains(text, '### Instruction') AND NOT contains(text, '### Input')")
def p22(spark, d):
    c = table(spark, d, "conversations")
    for mark in ("### Response", "### Instruction", "### Input"):
        c = c.where(~F.contains("text", F.lit(mark)))
    return c.select("conv_id", "turn")


@register("p24_browse", "SELECT doc_id, substr(text, 1, 500) AS text FROM documents WHERE lang = 'en' AND contains(text, 'the') ORDER BY doc_id LIMIT 20 OFFSET 10")
def p24(spark, d):
    return _docs(spark, d).where((F.col("lang") == "en") & F.contains("text", F.lit("the"))).orderBy("doc_id").offset(10).limit(20).select("doc_id", F.substring("text", 1, 500).alias("text"))


@register("p26_grep", "SELECT doc_id, CAST(n AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE contains(lower(line), 'licens')")
def p26(spark, d):
    lines = _docs(spark, d).where(F.contains(F.lower("text"), F.lit("licens"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.contains(F.lower("line"), F.lit("licens"))).select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")


@register("s03_txt", r"SELECT doc_id, md5(text) AS file_id, regexp_replace(regexp_replace(text, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content FROM documents")
def s03(spark, d):
    return _docs(spark, d).select("doc_id", F.md5("text").alias("file_id"), X.strip(X.collapse_newlines(F.col("text"))).alias("content"))


@register("s08_newlines", r"SELECT page_id, regexp_replace(html, '\s*\n\s*', chr(10), 'g') AS html FROM pages")
def s08(spark, d):
    return table(spark, d, "pages").select("page_id", X.collapse_newlines(F.col("html")).alias("html"))


@register("s15_parquet", "SELECT n_nationkey, n_name FROM nation")
def s15(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name")


@register("s22_numbered", r"SELECT doc_id, regexp_replace(text, '^\S* ?', '') AS rest FROM documents")
def s22(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_replace("text", r"^\S* ?", "").alias("rest"))


@register("s28_upsert", "SELECT p_partkey, p_size FROM part WHERE p_partkey > 100 UNION ALL SELECT p_partkey, p_size + 1 FROM part WHERE p_partkey <= 100")
def s28(spark, d):
    from corpusloom.sources.files import upsert_records

    part = table(spark, d, "part").select("p_partkey", "p_size")
    return upsert_records(part, part.where("p_partkey <= 100").withColumn("p_size", F.col("p_size") + 1), "p_partkey")


@register("k08_finite", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def k08(spark, d):
    from corpusloom.sources.files import finite

    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return finite(e)


@register("x01_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS t FROM documents")
def x01(spark, d):
    return _docs(spark, d).select("doc_id", X.clean(F.col("text"), ("extra_whitespace",)).alias("t"))


@register("x01_ascii", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM documents")
def x01b(spark, d):
    return _docs(spark, d).select("doc_id", X.clean(F.col("text"), ("non_ascii",)).alias("t"))


@register("x02_emails", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ',') AS emails FROM documents")
def x02(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.emails(F.col("text")), ",").alias("emails"))


@register("x02_ips", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?:\d{1,3}\.){3}\d{1,3}'), ',') AS ips FROM documents")
def x02b(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.ip_addresses(F.col("text")), ",").alias("ips"))


@register("x04_keywords", "SELECT doc_id, CAST(len(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z]{3,}'), regexp_extract_all(text, '[A-Z]{2,}')))) AS BIGINT) AS n FROM documents")
def x04(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.keywords(F.col("text"))).cast("long").alias("n"))


@register("x08_section", r"SELECT doc_id, trim(regexp_replace(text, '^(?:\d+\.)+\s*', '')) AS t FROM documents")
def x08(spark, d):
    return _docs(spark, d).select("doc_id", X.strip_section_number(F.col("text")).alias("t"))


@register("x18_node_id", r"SELECT n_nationkey, regexp_replace(n_name, '[^a-zA-Z0-9\x{4E00}-\x{9FA5}]', '', 'g') AS id, upper(replace(n_name, ' ', '_')) AS rel FROM nation")
def x18(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.node_id(F.col("n_name")).alias("id"), X.relation_type(F.col("n_name")).alias("rel"))


@register("x22_normalise", r"SELECT doc_id, regexp_replace(lower(regexp_replace(text, '\s', '', 'g')), '[!-/:-@\[-`{-~]', '', 'g') AS t FROM documents")
def x22(spark, d):
    return _docs(spark, d).select("doc_id", X.normalise_answer(F.col("text")).alias("t"))


@register("x26_tokens", "SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS est, CAST(length(text) // 4 + 100 AS BIGINT) AS gateway FROM documents")
def x26(spark, d):
    return _docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("est"), X.gateway_token_estimate(F.col("text")).alias("gateway"))


@register("x38_round", "SELECT event_id, CAST(round_even(value, 2) AS DOUBLE) AS v FROM events")
def x38(spark, d):
    return table(spark, d, "events").select("event_id", F.bround("value", 2).cast("double").alias("v"))


@register("d03_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def d03(spark, d):
    return C.first_by_key(_docs(spark, d), [F.md5("text")], ["doc_id"]).select("doc_id")


@register("d05_prefix_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 200)")
def d05(spark, d):
    return C.first_by_key(_docs(spark, d), [F.substring("text", 1, 200)], ["doc_id"]).select("doc_id")


@register("d12_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('7:', doc_id)), doc_id LIMIT 100")
def d12(spark, d):
    return C.seeded_sample(_docs(spark, d), 100, "doc_id", 7).select("doc_id")


@register("d09_new_values", "SELECT DISTINCT source FROM documents WHERE lang = 'en' EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'es'")
def d09(spark, d):
    docs = _docs(spark, d)
    return docs.where("lang = 'en'").select("source").distinct().join(docs.where("lang = 'es'").select("source"), "source", "left_anti")


@register("a20_coverage", "SELECT avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS quality, avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS toxic FROM labels")
def a20(spark, d):
    return table(spark, d, "labels").agg(F.avg(F.col("quality").isNotNull().cast("double")).alias("quality"), F.avg((F.col("toxic") == 1).cast("double")).alias("toxic"))
