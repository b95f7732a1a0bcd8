"""Generation loops, plug points, archives and the remaining entries."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.functions import text as X
from corpusloom.operators import events as T
from corpusloom.operators import generate as G
from corpusloom.operators import graph as N
from corpusloom.operators import scorers
from corpusloom.plans import register
from corpusloom.plans.more import _folder, _part, _t
from corpusloom.sources import files as K

C, lit = F.col, F.lit


@register("g01_self_instruct")
def g01(spark, d):
    """Two words of a seed swapped in, until 12 new instructions; tests check filters and ROUGE."""
    seeds = _t(spark, d, "part").where("p_size < 10").select(C("p_partkey").alias("id"), F.concat(lit("Write a short note on the "), C("p_name")).alias("text"))

    def model(df):
        text = F.concat(lit("Explain in round "), C("round").cast("string"), lit(" how "), F.md5("text"), lit(" relates to "), F.md5(F.reverse("text")))
        return df.select((C("id") + 1_000_000 * (1 + C("round"))).alias("id"), text.alias("text"))

    return G.self_instruct(seeds, model, 12)


@register("g02_evolve", "SELECT p_partkey AS id, p_name AS text, 0 AS generation FROM part UNION ALL SELECT p_partkey, p_name || ' in detail' || CASE WHEN p_size % 2 = 0 THEN '!' ELSE '' END, 1 FROM part")
def g02(spark, d):
    def model(df):
        made = F.array(F.struct(lit(0).alias("place"), F.concat("text", lit(" now")).alias("text")), F.struct(lit(1).alias("place"), F.concat("text", lit(" in detail")).alias("text")), F.struct(lit(2).alias("place"), F.when(C("size") % 2 == 0, F.concat("text", lit(" in detail!"))).otherwise("text").alias("text")))
        sizes = _t(spark, d, "part").select(C("p_partkey").alias("id"), C("p_size").alias("size"))
        return df.join(sizes, "id").select("id", F.explode(made).alias("m")).select("id", "m.*")

    return G.evolve(_t(spark, d, "part").select(C("p_partkey").alias("id"), C("p_name").alias("text")), model, F.length("text"))


@register("g04_first_error", "SELECT l_orderkey AS id, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS first_bad FROM lineitem GROUP BY 1")
def g04(spark, d):
    return G.first_error(_t(spark, d, "lineitem").select(C("l_orderkey").alias("id"), C("l_linenumber").alias("place"), (C("l_returnflag") != "R").alias("ok")))


@register("g05_rejection_sampling", "SELECT l_orderkey AS id, arg_max(l_extendedprice, (l_discount >= 0.05 AND l_tax >= 0.05, (l_discount + l_tax) / 2, -l_linenumber, -l_extendedprice)) AS text, bool_or(l_discount >= 0.05 AND l_tax >= 0.05) AS passed FROM lineitem GROUP BY 1")
def g05(spark, d):
    tries = _t(spark, d, "lineitem").select(C("l_orderkey").alias("id"), (C("l_linenumber") * 10_000_000 + C("l_extendedprice")).alias("place"), C("l_extendedprice").alias("text"), C("l_discount").alias("a"), C("l_tax").alias("b"))
    return G.rejection_sample(tries, ("a", "b"), 0.05)


@register("g07_verified", "SELECT DISTINCT p_name || ' ' || r.range AS text FROM part, range(2) r WHERE p_size > 10 ORDER BY 1 LIMIT 150")
def g07(spark, d):
    names = _t(spark, d, "part").where("p_size > 10").select("p_name").distinct()
    n = names.count()
    wanted = min(150, 2 * n)
    return G.verified_rows(lambda df: df.select(F.concat_ws(" ", "p_name", C("round").cast("string")).alias("text")), names, F.length("text") > 0, wanted) if wanted > n else G.verified_rows(lambda df: df.select(F.explode(F.array(F.concat_ws(" ", "p_name", lit("0")), F.concat_ws(" ", "p_name", lit("1")))).alias("text")), names, F.length("text") > 0, wanted)


@register("f04_plugged_filter", "SELECT doc_id, length(text) % 2 = 0 AS passed FROM documents")
def f04(spark, d):
    return G.plugged(_t(spark, d, "documents"), "even", lambda t: F.length(t) % 2 == 0).select("doc_id", "passed")


@register("p08_registry", "SELECT doc_id FROM documents WHERE contains(text, 'the')")
def p08(spark, d):
    return G.plugged(_t(spark, d, "documents"), "has_the", lambda t: F.contains(t, lit("the")), keep=True).select("doc_id")


@register("p17_complexity_gate", r"SELECT p_partkey FROM part WHERE 0.4::DOUBLE * least(p_size / 3.0::DOUBLE, 1) + 0.3::DOUBLE * least((p_size % 3) / 3.0::DOUBLE, 1) + 0.15::DOUBLE * len(string_split(p_name, ' ')) / 20 + 0.15::DOUBLE * len(string_split(p_type, ' ')) / 50 >= 0.5")
def p17(spark, d):
    qa = F.array(F.struct(C("p_name").alias("question"), C("p_type").alias("answer"), C("p_size").alias("steps"), (C("p_size") % 3).alias("facts")))
    return _t(spark, d, "part").where(P.complexity(qa) >= 0.5).select("p_partkey")


@register("x25_rouge_l", "SELECT p_partkey, round(2.0::DOUBLE * len(string_split(p_name, ' ')) / (2 * len(string_split(p_name, ' ')) + 2), 9) AS f FROM part")
def x25(spark, d):
    a, b = F.split("p_name", " "), F.split(F.concat(lit("aa "), C("p_name"), lit(" zz")), " ")
    return _t(spark, d, "part").select("p_partkey", F.round(P.rouge_l(a, b), 9).alias("f"))


@register("x37_nested_finite", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM events")
def x37(spark, d):
    values = F.array(C("value"), F.when(C("event_id") % 3 == 0, lit(float("nan"))).otherwise(1.0), lit(float("inf")))
    return _t(spark, d, "events").select("event_id", F.size(F.array_compact(X.finite_values(values))).alias("n"))


@register("e04_api_calls", "SELECT round(avg((p_size % 3 = 0)::INT::DOUBLE), 4) AS accuracy, count(*) AS n FROM part")
def e04(spark, d):
    n = C("p_size").cast("string")
    said = F.concat(lit("API-Request: [Find(size="), F.when(C("p_size") % 3 == 0, n).otherwise("0"), lit(")]"))
    right = F.trim(F.translate(P.api_call(said), "[]", "")) == F.concat(lit("Find(size="), n, lit(")"))
    return _t(spark, d, "part").agg(F.round(F.avg(right.cast("double")), 4).alias("accuracy"), F.count(lit(1)).alias("n"))


def _few(spark, d):
    return [(r.r_regionkey, r.r_name) for r in _t(spark, d, "region").select("r_regionkey", "r_name").collect()]  # five rows


@register("e06_decrypt", "SELECT r_regionkey, r_name AS answer FROM region")
def e06(spark, d):
    rows = [(k, scorers.encrypted(name, "key"), "key") for k, name in _few(spark, d)]
    return spark.createDataFrame(rows, "r_regionkey int, c string, p string").select("r_regionkey", scorers.decrypt("c", "p").alias("answer"))


def _zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


@register("s07_docx", "SELECT r_regionkey || '.docx' AS name, r_name AS value FROM region")
def s07(spark, d):
    rows = [(f"{k}.docx", _zipped({"word/document.xml": f'<w:document xmlns:w="x"><w:p><w:t>{name}</w:t></w:p></w:document>'})) for k, name in _few(spark, d)]
    return K.office_cells(spark.createDataFrame(rows, "name string, raw binary")).select("name", "value")


def _books(spark, d):
    cell = '<c r="{0}" t="inlineStr"><is><t>{1}</t></is></c>'
    sheet = lambda k, name: f'<worksheet xmlns="x"><sheetData><row r="2">{cell.format("A2", k)}{cell.format("C2", name)}</row></sheetData></worksheet>'
    rows = [(f"{k}.xlsx", _zipped({"xl/worksheets/sheet1.xml": sheet(k, name), "xl/worksheets/sheet2.xml": sheet("x", "y")})) for k, name in _few(spark, d)]
    return spark.createDataFrame(rows, "name string, raw binary")


@register("s13_xlsx", "SELECT r_regionkey || '.xlsx' AS name, 3 AS col, r_name AS value FROM region UNION ALL SELECT r_regionkey || '.xlsx', 1, CAST(r_regionkey AS VARCHAR) FROM region")
def s13(spark, d):
    return K.office_cells(_books(spark, d)).where("sheet = 'sheet1'").select("name", "col", "value")


@register("s14_sheets", "SELECT r_regionkey || '.xlsx' AS name, 'sheet1' AS sheet FROM region")
def s14(spark, d):
    return K.sheets(K.office_cells(_books(spark, d)), skip=("sheet2", "readme"))


@register("s21_chat_archive", "SELECT 'a_b' AS roles, r_regionkey + 1 AS place, r_name AS message FROM region")
def s21(spark, d):
    import json

    chat = {"role_ASSISTANT": "a", "role_USER": "b", **{f"message_{k + 1}": name for k, name in _few(spark, d)}}
    raw = _zipped({"one.json": json.dumps(chat), "two.json": json.dumps({"role_USER": "b", "message_1": "lost"})})
    return K.zip_chats(spark.createDataFrame([("z.zip", raw)], "name string, raw binary")).select("roles", "place", "message")


@register("s11_batch_load", "SELECT p_partkey, p_name, p_size FROM part")
def s11(spark, d):
    a, b = _folder(spark), _folder(spark)
    _part(spark, d).where("p_size < 25").write.parquet(a)
    _part(spark, d).where("p_size >= 25").write.parquet(b)
    return K.load_all(spark, [a, b])


@register("k03_micro_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k03(spark, d):
    from corpusloom.streaming.events import append_batches, read_events

    path = _folder(spark)
    _t(spark, d, "events").repartition(3).write.parquet(f"{path}/in")
    append_batches(read_events(spark, f"{path}/in", files_per_trigger=1), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count(lit(1)).alias("n"))


@register("k04_append_clear", "SELECT count(*) AS n FROM part WHERE p_size >= 25")
def k04(spark, d):
    path = _folder(spark)
    K.write_jsonl(_part(spark, d).where("p_size < 25"), path)
    K.write_jsonl(_part(spark, d).limit(0), path)  # clears
    K.write_jsonl(_part(spark, d).where("p_size >= 25"), path, append=True)
    return spark.read.schema("p_partkey long").json(path).agg(F.count(lit(1)).alias("n"))


@register("t10_file_changes", "SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 3 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 3 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_size > 40)")
def t10(spark, d):
    p = _t(spark, d, "part")
    row = lambda mtime: [C("p_partkey").alias("path"), C("p_brand").alias("hash"), mtime.alias("mtime")]
    return T.file_changes(p.where("p_partkey % 5 <> 0").select(*row(lit(0))), p.where("p_partkey % 3 <> 0").select(*row(F.when(C("p_size") > 40, 1).otherwise(0))))


@register("t12_newest_delta", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 20")
def t12(spark, d):
    path = _folder(spark)
    K.versioned_write(_part(spark, d), path, 7)
    K.versioned_write(_part(spark, d).where("p_size < 20"), path, 12)
    return spark.read.parquet(K.newest_version(spark, path))


@register("n10_centrality", "WITH e AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id) SELECT id, round(n::DOUBLE / (SELECT count(*) - 1 FROM c), 9) AS centrality FROM c")
def n10(spark, d):
    e = _t(spark, d, "nation").join(_t(spark, d, "region"), C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("src"), C("r_name").alias("dst"))
    return N.degree_centrality(e).select("id", F.round("centrality", 9).alias("centrality"))


@register("n14_validation", "SELECT * FROM (VALUES ('nation.parquet', true), ('region.parquet', true), ('none.parquet', false)) t(name, present)")
def n14(spark, d):
    return K.present(spark, d, ("nation.parquet", "region.parquet", "none.parquet"))


@register("n15_command_tree", "SELECT DISTINCT p_type AS prefix, 1 AS depth, p_type AS module FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand, 2, p_type FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand || ' ' || split_part(p_name, ' ', 1), 3, p_type FROM part")
def n15(spark, d):
    xml = F.concat(lit('<cmd name="'), C("p_type"), lit('"><cmd name="'), C("p_brand"), lit('"><cmd name="'), F.substring_index("p_name", " ", 1), lit('"/></cmd></cmd>'))
    return N.command_tree(_t(spark, d, "part").select(xml.alias("xml")))
