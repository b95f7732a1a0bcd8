"""Communities of a graph, their reports, and searches over both; one row per hit, ranked within each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import voting
from corpusloom.session import Scratch

HUB = 1 << 22  # links of a node that one task holds


def _both(edges: DataFrame) -> DataFrame:
    """Every edge (src, dst, weight) in both directions, parallel ones summed; loops and edges without an end are left out."""
    e = edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _turn(seed: int, *parts) -> F.Column:
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _coded(names: DataFrame, seed: int) -> DataFrame:
    """(name, code): a long for each name, in the order of its seeded hash, then the name; names of one hash are numbered."""
    hashed = names.withColumn("hash", _turn(seed, F.col("name")))
    place = F.row_number().over(Window.partitionBy("hash").orderBy("name")) - 1
    return hashed.select("name", (F.shiftleft("hash", 31) + place).alias("code"))


def _by_rows(links: DataFrame, named: DataFrame, seed: int, level: int, most_rounds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What ``voting.propagate`` gives, with votes as rows summed by node and label. They are kept from round to round: once under a quarter of the nodes
    move, only the links of those that have moved are read into them."""
    one = F.lit(1).cast("long")

    def summed(rows: DataFrame) -> DataFrame:
        """(id, label, w, n) of links that give their weight to a label: those with n = 0 are gone."""
        return rows.repartition("id").groupBy("id", "label").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).where("n > 0")

    labels = scratch.keep(named.select(F.col("code").alias("id"), "name", F.col("code").alias("label")))
    nodes = labels.count()
    votes, kept = links.select(F.col("dst").alias("id"), F.col("src").alias("label"), F.col("weight").alias("w"), one.alias("n")), None
    for at in range(most_rounds):
        ranked_votes = votes.join(labels.select("id", F.col("label").alias("own")), "id") if at else votes.withColumn("own", F.col("id"))
        best = ranked_votes.groupBy("id").agg(F.min(F.struct(-F.col("w"), F.col("label") != F.col("own"), "label"))["label"].alias("best"))
        moves = _turn(seed, F.lit(level), F.lit(at), F.col("name")) % 2 == 0
        wish = labels.join(best, "id", "left").withColumn("best", F.coalesce("best", "label"))
        wish = scratch.keep(wish.withColumn("next", F.when(moves, F.col("best")).otherwise(F.col("label"))))
        left = wish.agg(F.count_if(F.col("best") != F.col("label")).alias("open"), F.count_if(F.col("next") != F.col("label")).alias("moved")).first()  # one row
        scratch.drop(labels)
        labels = wish.select("id", "name", F.col("next").alias("label"))
        if not left["open"] or at == most_rounds - 1:
            break
        if 4 * left["moved"] > nodes:
            fresh = links.join(labels, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label", F.col("weight").alias("w"), one.alias("n"))
        else:
            moved = wish.where("next <> label").select(F.col("id").alias("src"), F.explode(F.array(F.struct(F.col("label").alias("label"), F.lit(-1).cast("long").alias("n")), F.struct(F.col("next").alias("label"), one.alias("n")))).alias("to"))
            fresh = votes.unionByName(links.join(moved, "src").select(F.col("dst").alias("id"), "to.label", (F.col("weight") * F.col("to.n")).alias("w"), "to.n"))
        votes = scratch.keep(summed(fresh))
        if kept is not None:
            scratch.drop(kept)
        kept = votes
    labels = scratch.keep(labels.select("id", "label"))
    ends = {side: labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}")) for side in ("src", "dst")}
    return labels, links.join(ends["src"], "src").join(ends["dst"], "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")


def communities(edges: DataFrame, levels: int = 2, most_rounds: int = 20, seed: int = 0) -> DataFrame:
    """(id, level, community) of every node of undirected edges (src, dst, weight in whole numbers); a community is named by its least node.

    Level 0 is label propagation: each round a half of the nodes, drawn by hash, takes the label of the greatest summed weight among its
    neighbours; a node keeps its own where that is among the greatest, and other ties go by a seeded hash of the label, then the label.
    It ends when no node would move, or after ``most_rounds``. Each further level does the same with the communities as nodes. Nodes are longs inside, see ``_coded``;
    their links lie in blocks, see ``voting``. Where a node has over ``HUB`` links or a weight is no whole number, votes are rows, see ``_by_rows``.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))
    names = scratch.keep(_coded(e.select(F.explode(F.array("src", "dst")).alias("name")).distinct(), seed))
    end = lambda side: names.select(F.col("name").alias(side), F.col("code").alias(f"_{side}"))
    links = scratch.keep(_both(e.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")))
    home = names.select("name", "code", F.col("code").alias("node"))  # node: where a name has come to
    out = None
    for level in range(levels):
        nodes = scratch.keep(home.select(F.col("node").alias("code")).distinct().join(names, "code"))
        size = links.groupBy("dst").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()  # one row
        if size["most"] > HUB or links.schema["weight"].dataType.typeName() != "long":
            labels, between = _by_rows(links, nodes, seed, level, most_rounds, scratch)
        else:
            linked, between = voting.propagate(links, nodes, size["n"], f"{seed}:{level}", most_rounds, scratch)
            labels = scratch.keep(nodes.select(F.col("code").alias("id")).join(linked, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
        joined = home.join(labels.withColumnRenamed("id", "node"), "node")
        least = joined.groupBy("label").agg(F.min(F.struct("name", "code")).alias("least")).select("label", F.col("least.name").alias("community"), F.col("least.code").alias("to"))
        placed = scratch.keep(joined.join(least, "label").select("name", "code", F.col("to").alias("node"), "community"))
        home = placed.select("name", "code", "node")
        rows = placed.select(F.col("name").alias("id"), F.lit(level).alias("level"), "community")
        out = rows if out is None else out.unionByName(rows)
        if level < levels - 1:
            to = scratch.keep(least.select("label", "to"))
            summed = between.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
            links = scratch.keep(summed.join(to.select(F.col("label").alias("src"), F.col("to").alias("a")), "src").join(to.select(F.col("label").alias("dst"), F.col("to").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"))
    return out


def ranked(hits: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` hits (query_id, kind, id, score) of each query and kind with their place; ties go by id."""
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id"))
    return hits.select("query_id", "kind", F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score")).withColumn("place", place).where(F.col("place") <= top_k)


def community_reports(edges: DataFrame, members: DataFrame, most_named: int = 5) -> DataFrame:
    """(level, community, size, rating, text) of communities (id, level, community): the rating is the share of its weight that stays
    inside, the text names its ``most_named`` nodes of greatest weight. Only these reach the row, however large the community is."""
    at = lambda side, name: members.select(F.col("id").alias(side), "level", F.col("community").alias(name))
    e = edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))
    placed = e.join(at("src", "a"), "src").join(at("dst", "b"), ["dst", "level"])  # each edge once; parallel ones add up below
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("a").alias("community")), F.struct(F.col("dst").alias("id"), F.col("b").alias("community"))))
    each = placed.select("level", "weight", F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0).alias("inside"), ends.alias("end"))
    node = each.groupBy("level", "end.community", "end.id").agg(F.sum("weight").alias("w"), F.sum("inside").alias("inside"))
    first = F.row_number().over(Window.partitionBy("level", "community").orderBy(F.desc("w"), "id"))
    named = node.withColumn("n", first).where(F.col("n") <= most_named).groupBy("level", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), " ").alias("text"))
    sums = node.groupBy("level", "community").agg(F.count(F.lit(1)).alias("size"), F.when(F.sum("w") > 0, F.sum("inside") / F.sum("w")).otherwise(0.0).alias("rating"))
    return sums.join(named, ["level", "community"]).select("level", "community", "size", "rating", "text")


def local_search(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, members: DataFrame | None = None, reports: DataFrame | None = None, level: int = 0, top_k: int = 10) -> DataFrame:
    """(query_id, kind, id, score, place) around the entities (query_id, id) that a query names: entities and relationships by weight,
    sources by the weight of their mentions (unit, id, weight), and the reports of the seeds' communities by rating."""
    seeds = Scratch(edges.sparkSession).keep(seeds.select("query_id", "id").dropna().distinct())
    asked = seeds.select("id").distinct()
    near = seeds.join(_both(edges).join(asked.withColumnRenamed("id", "src"), "src", "left_semi"), F.col("id") == F.col("src"))  # before the sums, by Catalyst
    mentions = mentions.join(asked, "id", "left_semi")
    others = near.groupBy("query_id", F.col("dst").alias("id")).agg(F.sum("weight").alias("score")).join(seeds, ["query_id", "id"], "left_anti")
    kind = lambda df, name: df.select("query_id", F.lit(name).alias("kind"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    pair = F.concat(F.least("src", "dst"), F.lit("-"), F.greatest("src", "dst"))
    hits = kind(others, "entity").unionByName(kind(near.select("query_id", pair.alias("id"), F.col("weight").alias("score")).distinct(), "relationship"))
    hits = hits.unionByName(kind(seeds.join(mentions, "id").groupBy("query_id", F.col("unit").alias("id")).agg(F.sum("weight").alias("score")), "source"))
    if members is not None:
        own = seeds.join(members.where(F.col("level") == level), "id").select("query_id", "community").distinct()
        hits = hits.unionByName(kind(own.join(reports.where(F.col("level") == level), "community").select("query_id", F.col("community").alias("id"), F.col("rating").alias("score")), "report"))
    return ranked(hits, top_k)


def global_search(queries: DataFrame, reports: DataFrame, level: int = 0, top_k: int = 10) -> DataFrame:
    """Reports for queries (query_id, text): the number of the query's distinct words in a report, times one more than its rating."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where("word <> ''")
    shared = words(queries, "query_id").join(words(reports.where(F.col("level") == level), "community", "rating"), "word")
    hits = shared.groupBy("query_id", F.col("community").alias("id")).agg((F.count(F.lit(1)) * (1 + F.first("rating"))).alias("score"))
    return ranked(hits.withColumn("kind", F.lit("report")), top_k)


def drift_search(queries: DataFrame, seeds: DataFrame, edges: DataFrame, mentions: DataFrame, members: DataFrame, reports: DataFrame, level: int = 0, primer: int = 3, top_k: int = 10) -> DataFrame:
    """A local search that begins at the seeds and at what the ``primer`` best reports of a global search name."""
    best = global_search(queries, reports, level, primer).select("query_id", F.col("id").alias("community"))
    named = best.join(reports.where(F.col("level") == level), "community").select("query_id", F.explode(F.split("text", " ")).alias("id"))
    return local_search(seeds.select("query_id", "id").unionByName(named), edges, mentions, members, reports, level, top_k)
