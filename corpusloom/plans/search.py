"""Vector and lexical search, fusion, routing and boosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import ann
from corpusloom.operators import lexical as L
from corpusloom.operators import vector as V
from corpusloom.plans import register
from corpusloom.session import table

_E = "list_transform(embedding, lambda x: x::DOUBLE)"


_EMB_OF = "list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda c: (length(lower(text)) - length(replace(lower(text), c, '')))::DOUBLE)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e, e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))


def _top(score):
    return f"WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS id, {score} AS s FROM e JOIN e AS q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) SELECT qid, id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 5"


def _run(metric, profile="flat"):
    def run(spark, d):
        t, q = _vectors(spark, d)
        return V.topk(t, q, 5, metric, profile, exclude_self=True).select("qid", "id", F.round("similarity", 6).alias("similarity"))

    return run


_DOT = "list_dot_product(q.v, e.v)"
_L2 = "list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_L1 = "list_sum(list_transform(list_zip(q.v, e.v), lambda z: abs(z[1] - z[2])))"
for _name, _metric, _profile, _sql in (
    ("v01_topk_cosine", "cosine", "flat", "list_cosine_similarity(q.v, e.v)"),
    ("v02_topk_dot", "dot", "flat", _DOT),
    ("v03_topk_euclidean", "euclidean", "flat", f"1 / (1 + {_L2})"),
    ("v04_half_cosine", "cosine", "half", "greatest(0.0::DOUBLE, 1 - (1 - list_cosine_similarity(q.v, e.v)) / 2)"),
    ("v04_root_euclidean", "euclidean", "root", f"1 / (1 + sqrt({_L2}))"),
    ("v04_logistic_dot", "dot", "logistic", f"1 / (1 + exp(-{_DOT}))"),
    ("v04_manhattan", "manhattan", "flat", f"1 / (1 + {_L1})"),
    ("v04_exponential", "euclidean", "exponential", f"exp(-sqrt({_L2}))"),
):
    register(_name, _top(_sql))(_run(_metric, _profile))


@register("v04_clipped_dot", _top(f"greatest(0.0::DOUBLE, {_DOT})"))
def v04_clipped_dot(spark, d):
    return _run("dot", "clipped")(spark, d)


@register("v04_clipped_cosine", _top("least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_cosine_similarity(q.v, e.v)))"))
def v04_clipped_cosine(spark, d):
    return _run("cosine", "clipped")(spark, d)


def _payloads(spark, d):
    payload = F.when(F.col("vec_id") % 7 > 0, F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("half"), (F.col("vec_id") % 2).cast("string")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload"))


@register("v05_inverted_lists")
def v05(spark, d):
    """The 10 most similar rows by the approximate index; tests measure its recall against the exact search."""
    t, q = _vectors(spark, d)
    index = V.InvertedLists(t, lists=IVF_LISTS)
    return index.topk(q, 10, probes=IVF_PROBES).select("qid", "id", "rank")


IVF_LISTS, IVF_PROBES = 32, 24


@register("v05_product_codes")
def v05_product_codes(spark, d):
    """The 10 most similar rows by product codes, ranked by vectors among a tenth of the rows; tests measure its recall."""
    t, q = _vectors(spark, d)
    return ann.QuantizedLists(t).topk(q, 10).select("qid", "id", "rank")


@register("v06_neighbor_graph")
def v06(spark, d):
    """The 10 most similar rows by a beam over the neighbour graph; tests measure its recall and the rows it reads."""
    t, q = _vectors(spark, d)
    return ann.NeighborGraph(t).topk(q, 10)[0].select("qid", "id", "rank")


@register("v07_add", "SELECT count(*) AS n FROM embeddings")
def v07(spark, d):
    e = _vectors(spark, d)[0]
    return V.add(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 64).agg(F.count("vector").alias("n"))


@register("v09_update", "SELECT vec_id AS id, CASE WHEN vec_id % 7 > 0 THEN CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE CAST(label AS VARCHAR) END WHEN vec_id % 3 = 0 THEN 'new' END AS label, CASE WHEN vec_id % 7 > 0 THEN CAST(vec_id % 2 AS VARCHAR) END AS half FROM embeddings")
def v09(spark, d):
    t = _payloads(spark, d)
    changes = t.where("id % 3 = 0").select("id", F.create_map(F.lit("label"), F.lit("new")).alias("payload"))
    return V.update_payload(t, changes).select("id", F.col("payload")["label"].alias("label"), F.col("payload")["half"].alias("half"))


def _topk_sql(where="true", k=5):
    return f"WITH e AS (SELECT vec_id, label, {_E} AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.label, list_cosine_similarity(q.v, e.v) AS s FROM e JOIN e AS q ON q.vec_id % 100 = 0 WHERE {where}), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= {k})"


@register("v11_payloads", _topk_sql() + " SELECT qid, id, rank, CAST(label AS VARCHAR) AS label FROM t WHERE id % 7 > 0")
def v11(spark, d):
    return V.payloads(_payloads(spark, d), _vectors(spark, d)[1], 5).select("qid", "id", "rank", F.col("payload")["label"].alias("label"))


@register("v13_embed", f"SELECT item_id, array_to_string(list_transform({_EMB_OF}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS vector FROM benchmark")
def v13(spark, d):
    vector = V.letter_embedding(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(vector, lambda x: x.cast("long").cast("string")), ",").alias("vector"))


@register("v15_pairwise", f"WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def v15(spark, d):
    e = _vectors(spark, d)[0]
    after = e.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("vector").alias("w"))
    return e.join(after, "id").select(F.col("id").alias("a"), "b", F.round(V.cosine(F.col("vector"), F.col("w")), 6).alias("similarity"))


@register("p10_payload_filter", _topk_sql("e.label = 3 AND e.vec_id % 2 = 1 AND e.vec_id % 7 > 0") + " SELECT qid, id, rank FROM t")
def p10(spark, d):
    return V.filtered_topk(_payloads(spark, d), _vectors(spark, d)[1], 5, {"label": "3", "half": "1"}).select("qid", "id", "rank")


@register("p10_post_filter", _topk_sql(k=10) + " SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM t WHERE id % 2 = 1 AND id % 7 > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 5")
def p10_post(spark, d):
    return V.filtered_topk(_payloads(spark, d), _vectors(spark, d)[1], 5, {"half": "1"}, post=True).select("qid", "id", "rank")


@register("v08_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id >= 50 AND label <> 3")
def v08(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return V.delete(e, e.where("id < 50"), F.col("label") == 3).select("id")


@register("v10_status", "SELECT CAST(max(len(embedding)) AS BIGINT) AS vector_dim, count(*) AS vector_count FROM embeddings")
def v10(spark, d):
    return V.status(_vectors(spark, d)[0])


@register("p13_threshold", f"WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS s FROM e JOIN e AS q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 5) SELECT q.vec_id AS qid, t.id FROM e AS q LEFT JOIN t ON t.qid = q.vec_id AND t.s >= 0.38 WHERE q.vec_id % 100 = 0")
def p13(spark, d):
    t, q = _vectors(spark, d)
    return V.with_threshold(V.topk(t, q, 5, exclude_self=True), q, 0.38).select("qid", "id")


@register("d01_semantic_dedup", f"WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON b.vec_id < a.vec_id) SELECT id, j AS target_id FROM s WHERE s > 0.38 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, j) = 1")
def d01(spark, d):
    return V.semantic_duplicates(_vectors(spark, d)[0], 0.38).select("id", "target_id")


def _text(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


_BM25 = """
WITH t AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS term, len(string_split(text, ' ')) AS dl FROM documents),
p AS (SELECT term, id, count(*) AS tf, max(dl) AS dl FROM t GROUP BY term, id),
st AS (SELECT count(*) AS n, avg(len(string_split(text, ' '))) AS avgdl FROM documents),
i0 AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, st GROUP BY term, n),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT item_id AS qid, unnest(string_split(text, ' ')) AS term FROM benchmark),
s AS (SELECT qid, p.id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN i USING (term), st GROUP BY qid, p.id)
"""


_TOP = "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s QUALIFY rank <= 50"


@register("r03_bm25", _BM25 + "SELECT qid, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) <= 50")
def r03(spark, d):
    docs, queries = _text(spark, d)
    return L.bm25_top(docs, queries, 50).select("qid", "id", "score")


_EMB = _EMB_OF
_NEAR = f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT q.item_id AS qid, e.doc_id AS id, round(list_dot_product(q.v, e.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-10) * greatest(sqrt(list_dot_product(e.v, e.v)), 1e-10)), 9) AS s FROM (SELECT item_id, {_EMB} AS v FROM benchmark) q, (SELECT doc_id, {_EMB} AS v FROM documents) e) WHERE s >= 0.5 QUALIFY rank <= 50"


def _near(docs, queries, k=50):
    """The ``k`` documents most similar to each query by the stand-in encoder, at least 0.5."""
    hits = V.topk(docs.select("id", V.letter_embedding(F.col("text")).alias("vector")), queries.select("qid", V.letter_embedding(F.col("text")).alias("query_vector")), 2 * k)
    return V.first_k(hits.drop("rank").withColumn("similarity", F.round("similarity", 9)).where("similarity >= 0.5"), k)


@register("r04_rrf", _BM25 + f", b AS ({_TOP}), a AS ({_NEAR}), tx AS (SELECT doc_id AS id, text FROM documents), av AS (SELECT qid, text, max(rank) AS rank FROM a JOIN tx USING (id) GROUP BY qid, text), bv AS (SELECT qid, text, min(rank) AS rank FROM b JOIN tx USING (id) GROUP BY qid, text), f AS (SELECT qid, md5(text) AS text_md5, text, round(coalesce(0.8::DOUBLE / (60 + av.rank), 0) + coalesce(0.2::DOUBLE / (60 + bv.rank), 0), 9) AS rrf FROM av FULL JOIN bv USING (qid, text)) SELECT qid, text_md5, rrf FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, text_md5) <= 20")
def r04(spark, d):
    docs, queries = _text(spark, d)
    texts = docs.withColumn("text_md5", F.md5("text"))
    lexical = L.bm25_top(docs, queries, 50).join(texts, "id").select("qid", F.col("text_md5").alias("text"), "rank")
    near = _near(docs, queries).join(texts, "id").select("qid", F.col("text_md5").alias("text"), "rank")
    fused = L.fused_by_text(near, lexical, k=10**6).select("qid", F.col("text").alias("id"), F.round("rrf", 9).alias("rrf"))
    return L.ranked(fused, 20, "rrf").select("qid", F.col("id").alias("text_md5"), "rrf")


@register("r11_category", "SELECT p_partkey, round(p_retailprice + CASE WHEN p_type = 'A/B' THEN 0.08::DOUBLE WHEN string_split(p_type, '/')[1] = 'A' THEN 0.03::DOUBLE ELSE -0.02::DOUBLE END, 6) AS score FROM part")
def r11(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(L.category_boost(F.col("p_retailprice"), F.col("p_type"), "A/B"), 6).alias("score"))


@register("r16_keywords", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'licensed')::INT) / 3.0::DOUBLE AS score FROM documents")
def r16(spark, d):
    terms = F.array(F.lit("the"), F.lit("und"), F.lit("licensed"))
    return table(spark, d, "documents").select("doc_id", L.keyword_score(terms, F.col("text")).alias("score"))


@register("r20_budget", "SELECT r_regionkey, CAST(floor(8000 * (r_regionkey + 1)::DOUBLE / (SELECT sum(r_regionkey + 1) FROM region)) AS BIGINT) AS chars FROM region")
def r20(spark, d):
    r = table(spark, d, "region")
    total = r.agg(F.sum(F.col("r_regionkey") + 1).alias("total"))
    return r.join(F.broadcast(total)).select("r_regionkey", L.budget(8000, (F.col("r_regionkey") + 1).cast("double"), F.col("total")).alias("chars"))  # one row
