"""Retrieval pipelines composed of search, fusion, boosts and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import vector as V

#: Names of protocols, which of them a name also stands for, and their levels of security (others: 1).
PROTOCOLS = "https?|tcp|udp|ftp|ftps|sftp|dns|dhcp|sip|rtsp|smtp|pop3|imap|ssh|telnet|ldap|ldaps|nfs|smb|cifs|mysql|postgresql|redis"
GENERAL = {"http": ("https",), "ftp": ("ftps", "sftp"), "ldap": ("ldaps",), "tcp": ("http", "https", "ftp", "ssh", "smtp"), "udp": ("dns", "dhcp", "sip", "rtsp")}
SECURITY = {"http": 1, "https": 2, "ftp": 1, "ftps": 2, "sftp": 2, "ldap": 1, "ldaps": 2, "telnet": 0, "ssh": 2}
#: What a query says that belongs to a layer of knowledge; layers of equal count keep this order.
LAYERS = (
    ("cli", (r"\b(cli|命令|command|syntax|语法)\b", r"\b(slb|llb|gslb|ha|ssl)\s+(virtual|real|health|group|policy)", r"\b(show|no|enable|disable|clear)\s+\w+", r"\b(health\s+request|health\s+response|health\s+server)\b", r"\b(ip\s+route|ip\s+arp|ip\s+dhcp)\b", r"\b(http2\s+settings)\b", r"命令[格式语法参数]", r"配置命令", r"\bcli\s+ref")),
    ("rules", (r"测试[规范模板标准模版]", r"用例[模板模版格式规范]", r"\b(case\s*id|测试编号)\b", r"测试类型", r"优先级[定义标准分配]", r"评审[标准检查清单]", r"\b(review|checklist)\b", r"(boundary|negative|configuration|functional|load|integration)\s*[测试类]", r"测试[分类编写]规[则范]")),
    ("design", (r"设计文档", r"(功能|产品)[规格说明描述]", r"func.*spec", r"architecture", r"(原理|机制|实现)[是什么]", r"(什么是|如何|怎样|为什么)", r"(prd|需求)")),
    ("test", (r"已有[的]?测试", r"现有[的]?[测试用例]", r"类似[的]?测试", r"参考.*测试", r"测试[列表清单]", r"test\s*(list|case)", r"相似[的]?用例", r"重复.*用例")),
)


def pieces(docs: DataFrame, size: int = 500) -> DataFrame:
    """(id, piece_num, text): consecutive pieces of ``size`` characters, numbered from 1; blank texts have none."""
    n = F.ceil(F.length("text") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * size + 1, F.lit(size)))
    return docs.where(F.length("text") > 0).select("id", F.posexplode(cut).alias("i", "piece")).select("id", (F.col("i") + 1).alias("piece_num"), F.col("piece").alias("text"))


def ingest(docs: DataFrame, embed, size: int = 500) -> DataFrame:
    """Pieces with their vectors; ``embed`` maps a text column to an array column."""
    return pieces(docs, size).withColumn("vector", embed(F.col("text")))


def collection_name(content: Column) -> Column:
    """Up to ten letters and digits of the content, and six of its md5."""
    return F.concat(F.substring(F.regexp_replace(content, "[^a-zA-Z0-9]", ""), 1, 10), F.lit("_"), F.substring(F.md5(content), 1, 6))


def multi_source(per_source: list[DataFrame], k: int) -> DataFrame:
    """The first ``k`` of each query over the hits (qid, source, id, score) of all sources; hits without a score come last."""
    hits = reduce(DataFrame.unionByName, per_source)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "source", "id"))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def rerank(hits: DataFrame, query: Column, text: Column, k: int, score=None) -> DataFrame:
    """Hits with ``score(query, text)`` in place of theirs, the first ``k`` of each query; by default the share of query words that the text has."""
    if score is None:
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
        score = lambda q, t: F.size(F.array_intersect(words(q), words(t))) / F.greatest(F.size(words(q)), F.lit(1))
    scored = hits.withColumn("score", score(query, text))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def first_of_prefix(hits: DataFrame, n: int, order: list) -> DataFrame:
    """Of each query's hits with equal first ``n`` characters, the first in order."""
    w = Window.partitionBy("qid", F.substring("text", 1, n)).orderBy(*order)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def query_list(queries: DataFrame, main: DataFrame) -> DataFrame:
    """(qid, place, query): queries (qid, pos, query, priority) by priority (none: 99), each once; the main query
    (qid, query) comes first if they are fewer than two, else last, unless it is among them."""
    asked = queries.select("qid", F.trim("query").alias("query"), F.coalesce("priority", F.lit(99)).alias("priority"), "pos").where("query <> ''")
    once = asked.groupBy("qid", "query").agg(F.min(F.struct("priority", "pos")).alias("key"))
    held = once.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    mine = main.join(held, "qid", "left").join(once.select("qid", "query"), ["qid", "query"], "left_anti")
    mine = mine.select("qid", "query", F.struct(F.when(F.coalesce("n", F.lit(0)) < 2, -1).otherwise(2**31 - 1).alias("priority"), F.lit(0).alias("pos")).alias("key"))
    both = once.select("qid", "query", F.struct(F.col("key.priority").cast("int").alias("priority"), F.col("key.pos").cast("int").alias("pos")).alias("key")).unionByName(mine)
    return both.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("key")) - 1).alias("place"), "query")


def resolved_score(similarity: Column, rrf: Column, score: Column) -> Column:
    """The similarity if it isn't 0, else the fused score, else the plain one, else 0."""
    return F.coalesce(F.nullif(similarity, F.lit(0.0)), rrf, score, F.lit(0.0))


def protocols(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({PROTOCOLS})\b"), F.lit(1)))


def protocol_boost(asked: Column, held: Column, exact: float = 0.05, partial: float = 0.02, mismatch: float = -0.03) -> Column:
    """``asked`` and ``held``: protocols of the query and of the document."""
    level = F.create_map(*[F.lit(x) for item in SECURITY.items() for x in item])
    general = F.create_map(*[x for k, v in GENERAL.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    of = lambda p: F.coalesce(level[p], F.lit(1))
    none = F.array().cast("array<string>")
    same = F.array_intersect(asked, held)
    near = F.flatten(F.transform(F.array_except(asked, same), lambda q: F.transform(F.array_intersect(F.coalesce(general[q], none), held), lambda p: F.when(of(p) >= of(q), partial).otherwise(partial * 0.5))))
    total = exact * F.size(same) + F.aggregate(near, F.lit(0.0), lambda s, x: s + x)
    missed = (F.size(held) > 0) & (F.size(same) == 0) & (F.size(near) == 0)
    return F.when(F.size(asked) == 0, 0.0).otherwise(total + F.when(missed, mismatch).otherwise(0.0))


def graph_proximity(queries: DataFrame, docs: DataFrame, edges: DataFrame, scores: tuple[float, float, float] = (1.0, 0.5, 0.25)) -> DataFrame:
    """(qid, id, proximity) of queries (qid, entity) and documents (id, entity): for each query entity its score at the
    least distance, up to two steps, at which the document has entities, times their number; over the number of query entities."""
    q = queries.select("qid", F.lower("entity").alias("entity")).distinct()
    d = docs.select("id", F.lower("entity").alias("near")).distinct()
    e = edges.select(F.lower("src").alias("entity"), F.lower("dst").alias("near"))
    e = e.unionByName(e.select(F.col("near").alias("entity"), F.col("entity").alias("near"))).distinct()
    mine = e.join(q.select("entity").distinct(), "entity", "left_semi")
    two = mine.select("entity", F.col("near").alias("via")).join(e.withColumnsRenamed({"entity": "via"}), "via").select("entity", "near").where("entity <> near")
    hops = q.select("entity", F.col("entity").alias("near"), F.lit(0).alias("hop")).distinct().unionByName(mine.withColumn("hop", F.lit(1))).unionByName(two.distinct().withColumn("hop", F.lit(2)))
    hops = hops.groupBy("entity", "near").agg(F.min("hop").alias("hop"))
    met = q.join(hops, "entity").join(d, "near").groupBy("qid", "entity", "id", "hop").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("qid", "entity", "id").agg(F.min(F.struct("hop", "n")).alias("m"))
    worth = F.element_at(F.array(*[F.lit(s) for s in scores]), F.col("m.hop") + 1) * F.col("m.n")
    total = best.groupBy("qid", "id").agg(F.sum(worth).alias("total"))
    size = q.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    return total.join(size, "qid").select("qid", "id", (F.col("total") / F.col("size")).alias("proximity"))


def combined_boost(base: Column, protocol: Column, proximity: Column, weight: float = 0.4) -> Column:
    return base + protocol + weight * F.coalesce(proximity, F.lit(0.0))


def entities(query: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """Names that the query contains themselves or by one of their keywords."""
    low = F.lower(query)
    found = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in (name, *words)]), F.lit(name)) for name, words in names.items()]
    return F.array_compact(F.array(*found))


def prefix_search(entries: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, rank) of entries (id, prefix, text) whose prefix is one of the query's (qid, prefixes, terms), then of those
    that contain most terms as words; of equal first 100 characters the first stays."""
    exact = queries.select("qid", F.explode("prefixes").alias("prefix")).distinct().join(entries, "prefix").select("qid", "id", "text", F.lit(2.0).alias("score")).distinct()
    terms = queries.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("term")).distinct()
    words = entries.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("term"))
    filled = terms.join(words, "term").groupBy("qid", "id").agg((F.count(F.lit(1)) / F.max("n")).alias("score")).join(entries.select("id", "text"), "id")
    both = exact.unionByName(filled.select("qid", "id", "text", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"), F.first("text").alias("text"))
    kept = first_of_prefix(both, 100, [F.desc("score"), "id"])
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return kept.select("qid", "id", rank.cast("long").alias("rank")).where(F.col("rank") <= k)


def similar_tests(tests: DataFrame, terms: Column, module: str = "") -> DataFrame:
    """(id, score): share of the terms that a test's text contains, if any; another module's tests are left out, those without a module aren't."""
    low = F.lower("text")
    n = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    mine = tests if not module else tests.where(F.coalesce(F.col("module") == "", F.lit(True)) | F.contains(F.lower("module"), F.lit(module.lower())))
    return mine.select("id", (n / F.greatest(F.size(terms), F.lit(1))).alias("score")).where("score > 0")


def layers(query: Column) -> Column:
    """Layers with patterns in the query, most first; the design layer if there are none."""
    low = F.lower(query)
    count = lambda patterns: sum((F.rlike(low, F.lit(p)).cast("int") for p in patterns), F.lit(0))
    scored = F.array_compact(F.array(*[F.when(count(p) > 0, F.struct((-count(p)).alias("n"), F.lit(i).alias("place"), F.lit(name).alias("name"))) for i, (name, p) in enumerate(LAYERS)]))
    return F.when(F.size(scored) > 0, F.transform(F.array_sort(scored), lambda x: x["name"])).otherwise(F.array(F.lit("design")))


def enriched_query(query: Column, modules: Column, protocol: Column, scenario: Column, step: Column, tags: tuple[str, str, str, str] = ("module", "protocol", "scenario", "step")) -> Column:
    """The query with a tag in brackets for whatever is known of it."""
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" [{name}: "), c, F.lit("]"))).otherwise("")
    return F.concat(query, tag(tags[0], F.array_join(modules, ", ")), tag(tags[1], protocol), tag(tags[2], F.when(scenario != "unknown", scenario)), tag(tags[3], step))


def metadata_matches(module: Column, held: Column, scenario: Column, modules: tuple[str, ...] = (), protocol: str = "", wanted_scenario: str = "", mode: str = "strict") -> Column:
    """Whether a hit's metadata fit: ``strict`` wants what is asked for to be there, ``relaxed`` rejects only what differs, ``none`` nothing."""
    if mode == "none":
        return F.lit(True)
    out = F.lit(True)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    if modules:
        out = out & F.when(empty(module), mode != "strict").otherwise(module.isin(*modules))
    if protocol:
        out = out & F.when(F.coalesce(F.size(held), F.lit(0)) <= 0, mode != "strict").otherwise(F.array_contains(held, protocol))
    if mode == "strict" and wanted_scenario not in ("", "unknown"):
        out = out & (empty(scenario) | (scenario == wanted_scenario))
    return out


def covered_steps(hits: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """(qid, missing): the required steps that none of a query's hits mentions."""
    low = F.lower("text")
    seen = hits.groupBy("qid").agg(*[F.bool_or(F.contains(low, F.lit(s.lower()))).alias(f"s{i}") for i, s in enumerate(steps)])
    return seen.select("qid", F.array_compact(F.array(*[F.when(~F.coalesce(f"s{i}", F.lit(False)), F.lit(s)) for i, s in enumerate(steps)])).alias("missing"))


def adaptive(rounds: list[DataFrame], steps: tuple[str, ...]) -> DataFrame:
    """Hits (qid, id, text) of query rounds in order of priority; a query's next round counts only while steps are missing."""
    out = rounds[0]
    for more in rounds[1:]:
        open_ = covered_steps(out, steps).where(F.size("missing") > 0).select("qid")
        out = out.unionByName(more.join(open_, "qid", "left_semi")).dropDuplicates(["qid", "id"])
    return out


def uniform_hits(sources: DataFrame, entities_: DataFrame, relations: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, id, text, score) of the four record kinds of a graph index; records without a score have their kind's."""
    out = None
    for kind, df, default in (("source", sources, 0.5), ("entity", entities_, 0.3), ("relationship", relations, 0.2), ("report", reports, 0.4)):
        score = F.coalesce(F.col("score"), F.lit(default)) if "score" in df.columns else F.lit(default)
        part = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "text", score.cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def section_search(files: DataFrame, keywords: tuple[str, ...], k: int = 4, mark: str = "### ") -> DataFrame:
    """(id, section, n): the ``k`` sections of each file (id, text) with most of the keywords; what stands before the first mark is none."""
    parts = files.select("id", F.posexplode(F.split("text", mark)).alias("section", "body")).where("section > 0 AND trim(body) <> ''")
    low = F.lower("body")
    found = parts.withColumn("n", sum((F.contains(low, F.lit(w.lower())).cast("int") for w in keywords), F.lit(0))).where("n > 0")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "section"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "section", "n")


def files_of_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, file, score, text): each file with a hit (qid, file, piece_num, score), rebuilt from its chunks (file, piece_num, text), with its best score."""
    best = hits.groupBy("qid", "file").agg(F.max("score").alias("score"))
    wanted = chunks.join(best.select("file").distinct(), "file", "left_semi")
    whole = wanted.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("piece_num", "text"))).alias("p"))
    return best.join(whole.select("file", F.array_join(F.transform("p", lambda x: x.text), "\n").alias("text")), "file")


def hybrid_graph(vector: DataFrame, graph: DataFrame, boost: Column, k: int = 8) -> DataFrame:
    """Vector hits before graph hits (qid, id, text, score), one of each first 200 characters, boosted, the first ``k`` of each query."""
    both = vector.withColumn("_o", F.lit(0)).unionByName(graph.withColumn("_o", F.lit(1)))
    kept = first_of_prefix(both, 200, ["_o", F.desc("score"), "id"]).drop("_o")
    boosted = kept.withColumn("score", F.col("score") + boost)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return boosted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def vector_query(pieces_: DataFrame, queries: DataFrame, k: int = 1, threshold: float = 0.7) -> DataFrame:
    """The ``k`` most similar pieces of each query from ``threshold`` up; a query without any has one row of nulls."""
    return V.with_threshold(V.topk(pieces_, queries, k), queries, threshold)
