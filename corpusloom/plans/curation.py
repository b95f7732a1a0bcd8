"""Filters, deduplication, sampling and the curation flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.functions import text as X
from corpusloom.operators import curate as C
from corpusloom.plans import register
from corpusloom.session import table


@register(
    "g06_source2synth",
    r"""
WITH base AS (
  SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) BETWEEN 50 AND 20000
), gated AS (
  SELECT doc_id, t FROM base
  WHERE length(t) - length(replace(t, '.', '')) >= 2
    AND CAST(length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) AS DOUBLE) / length(t) <= CAST(0.3 AS DOUBLE)
), s AS (
  SELECT doc_id, t, list_filter(list_transform(string_split(t, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM gated
), q AS (
  SELECT doc_id, t, list_filter(list_transform(range(1, greatest(len(ss) - 1, 1)), lambda i: struct_pack(p := ss[i], m := ss[i + 1], c := ss[i + 2])),
    lambda z: length(z.p) > 10 AND length(z.m) > 10 AND length(z.c) >= 5) AS qa FROM s
), u AS (
  SELECT doc_id, t, len(qa) AS n_qa, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM q WHERE len(qa) > 0
)
SELECT doc_id, CAST(n_qa AS BIGINT) AS n_qa, CAST(length(t) AS BIGINT) AS n_text FROM u WHERE rn = 1
""",
)
def g06_source2synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and quality gates, sentence triples with rule-based questions, exact dedup."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.strip(F.col("text")).alias("t"))
    docs = docs.where(F.length("t").between(50, 20000))
    dots = F.length("t") - F.length(F.replace("t", F.lit("."), F.lit("")))
    special = F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", "")).cast("double") / F.length("t")
    docs = docs.where((dots >= 2) & (special <= 0.3))
    docs = docs.withColumn("qa", _triples(F.filter(F.transform(F.split("t", r"\."), lambda x: X.strip(x)), lambda x: x != ""))).where(F.size("qa") > 0)
    key = [F.xxhash64("t").alias("a"), F.xxhash64(F.lit(3), "t").alias("b")]  # not the text itself
    first = docs.groupBy(*key).agg(F.min(F.struct("doc_id", F.size("qa").cast("long").alias("n_qa"), F.length("t").cast("long").alias("n_text"))).alias("d"))
    return first.select("d.doc_id", "d.n_qa", "d.n_text")


def _triples(ss: Column, conclusion: int = 5) -> Column:
    """Neighbouring sentences as (p, m, c): three slices side by side, so that no lambda splits the text again."""
    n = F.greatest(F.size(ss) - 2, F.lit(0))
    pair = F.zip_with(F.slice(ss, F.lit(1), n), F.slice(ss, F.lit(2), n), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    whole = F.zip_with(pair, F.slice(ss, F.lit(3), n), lambda x, c: F.struct(x.p.alias("p"), x.m.alias("m"), c.alias("c")))
    return F.filter(whole, lambda z: (F.length(z.p) > 10) & (F.length(z.m) > 10) & (F.length(z.c) >= conclusion))


@register(
    "g06_full",
    r"""
WITH base AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) BETWEEN 50 AND 512),
gated AS (SELECT doc_id, t FROM base WHERE length(t) - length(replace(t, '.', '')) >= 2
  AND CAST(length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) AS DOUBLE) / length(t) <= CAST(0.3 AS DOUBLE)),
s AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM gated),
q AS (SELECT doc_id, t, list_transform(list_filter(list_transform(range(1, greatest(len(ss) - 1, 1)), lambda i: struct_pack(p := ss[i], m := ss[i + 1], c := ss[i + 2])),
    lambda z: length(z.p) > 10 AND length(z.m) > 10 AND length(z.c) >= 1), lambda z: struct_pack(question := 'What follows from "' || z.p || '" and "' || z.m || '"?', answer := z.c)) AS qa FROM s),
k AS (SELECT doc_id, t, qa, list_sum(list_transform(qa, lambda x: 0.7::DOUBLE + 0.15::DOUBLE * least(len(list_filter(regexp_split_to_array(x.question, '\s+'), lambda w: w <> '')) / 20.0::DOUBLE, 1)
    + 0.15::DOUBLE * least(len(list_filter(regexp_split_to_array(x.answer, '\s+'), lambda w: w <> '')) / 50.0::DOUBLE, 1))) / len(qa) AS complexity FROM q WHERE len(qa) > 0),
f AS (SELECT * FROM k WHERE len(list_filter(qa, lambda x: NOT (length(x.question) >= 10 AND length(x.answer) >= 5 AND x.question <> x.answer))) = 0
  AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 20 AND complexity >= 0.5),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1)
SELECT doc_id, CAST(len(qa) AS BIGINT) AS n_qa, round(complexity, 6) AS complexity FROM u ORDER BY md5('9:' || doc_id), doc_id LIMIT 200
""",
)
def g06_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow: length and quality gates, sentence triples with rule-based questions, quality of questions and answers,
    complexity, exact dedup by text and questions, seeded sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.strip(F.col("text")).alias("t"))
    docs = docs.where(F.length("t").between(50, 512))
    docs = docs.where((X.count_of(F.col("t"), ".") >= 2) & (X.special_ratio(F.col("t")) <= 0.3))
    triples = _triples(F.filter(F.transform(F.split("t", r"\."), lambda x: X.strip(x)), lambda x: x != ""), 1)
    asked = F.transform(triples, lambda z: F.struct(F.concat(F.lit('What follows from "'), z.p, F.lit('" and "'), z.m, F.lit('"?')).alias("question"), z.c.alias("answer"), F.lit(3).alias("steps"), F.lit(3).alias("facts")))
    docs = docs.withColumn("qa", asked).where(F.size("qa") > 0)
    fine = F.forall("qa", lambda x: (F.length(x.question) >= 10) & (F.length(x.answer) >= 5) & (x.question != x.answer))
    docs = docs.where(fine & (X.word_count(F.col("t")) >= 20)).withColumn("complexity", P.complexity(F.col("qa"))).where("complexity >= 0.5")
    seen = F.to_json(F.struct("t", "qa"))
    one = docs.groupBy(F.xxhash64(seen).alias("a"), F.xxhash64(F.lit(3), seen).alias("b")).agg(F.min(F.struct("doc_id", F.size("qa").cast("long").alias("n_qa"), F.round("complexity", 6).alias("complexity"))).alias("d"))
    return C.seeded_sample(one.select("d.*"), 200, "doc_id", 9)
