"""Property graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import blocks as B
from corpusloom.session import Scratch, dealt


def merge_triplets(edges: DataFrame, new: DataFrame) -> DataFrame:
    """(subj, rel, obj, ts): distinct triplets; the later timestamp wins."""
    return edges.unionByName(new).groupBy("subj", "rel", "obj").agg(F.max("ts").alias("ts"))


def match(edges: DataFrame, subj: str | None = None, rel: str | None = None, obj: str | None = None) -> DataFrame:
    for name, value in (("subj", subj), ("rel", rel), ("obj", obj)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(id, centrality): edges at a node over the number of other nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = ends.agg((F.count(F.lit(1)) - 1).alias("others"))
    return ends.join(F.broadcast(n)).select("id", (F.col("degree") / F.greatest("others", F.lit(1))).alias("centrality"))


def k_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(root, id, depth): nodes within ``hops`` undirected steps of each root (id), at their least depth.

    Each step joins the frontier alone and drops what has been reached before. Steps are counted by degrees before they are made, and dealt to as many tasks as they need.
    """
    scratch = Scratch(edges.sparkSession)
    both, degree = both_ways(edges, scratch)
    seen = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, hops + 1):
        rows = step_rows(frontier, degree)
        step = dealt(frontier, rows, "id").join(both, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"))
        step = dealt(step, rows, "root", "id").distinct()
        frontier = scratch.keep(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


HELD = 4096  # members of a middle node that are paired within its row


def two_hops(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct pairs of members that share a middle node, from edges (mid, member).

    Middle nodes are dealt by ranges: neighbours among them tend to have members in common, so most repeated pairs meet in one task
    and only distinct ones of a task move. Nodes of more than ``HELD`` members are paired by a join, which Spark splits.
    """
    e = edges.select("mid", "member").dropna()
    many = Scratch(e.sparkSession).keep(e.groupBy("mid").count().where(F.col("count") > HELD).select("mid"))
    few = e.join(many, "mid", "left_anti").repartitionByRange("mid").groupBy("mid").agg(F.collect_set("member").alias("members"))
    pairs = few.where(F.size("members") > 1).select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b")).where("a < b")
    if not many.isEmpty():
        hot = e.join(many, "mid", "left_semi").distinct()
        pairs = pairs.unionByName(hot.withColumnRenamed("member", "a").join(hot.withColumnRenamed("member", "b"), "mid").where("a < b").select("a", "b"))
    return pairs.distinct()


def both_ways(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (src, dst) in both directions and the degree (src, n) of each node, written."""
    edges = scratch.keep(edges.select("src", "dst"))
    twice = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = scratch.keep(dealt(twice, 2 * edges.count(), "src", "dst").distinct())
    scratch.drop(edges)
    return both, scratch.keep(both.groupBy("src").agg(F.count(F.lit(1)).alias("n")))


def step_rows(frontier: DataFrame, degree: DataFrame) -> int:
    """How many rows the next step from ``frontier`` (id) makes."""
    return frontier.join(degree, F.col("id") == F.col("src")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def shortest_paths(edges: DataFrame, source: str, most_rounds: int | None = None) -> DataFrame:
    """(id, cost, path): least-cost undirected paths from ``source``; ties take the path that sorts first. Weights can't be negative.

    Each round relaxes the edges of nodes that improved, until none does, or raises after ``most_rounds``.
    """
    scratch = Scratch(edges.sparkSession)
    spark = edges.sparkSession
    if edges.where("weight < 0").limit(1).count():
        raise ValueError("a weight is negative")
    both = edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    best = spark.createDataFrame([(source, 0.0, [source])], "id string, cost double, path array<string>")
    frontier, rounds = best, 0
    while True:
        step = frontier.join(both, frontier["id"] == both["src"]).select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        both_best = best.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.lit(True)))
        now = scratch.keep(both_best.groupBy("id").agg(F.min(F.struct("cost", "path", "new")).alias("m")).select("id", "m.cost", "m.path", "m.new"))
        frontier = now.where("new").drop("new")
        best = now.drop("new")
        rounds += 1
        if frontier.isEmpty():
            return best
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"paths still change after {rounds} rounds")


INTEGRAL = ("byte", "short", "integer", "long")
LANDMARKS = 64  # sources whose costs rule out edges for the others, where there are over four times as many


def numbered(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, no): distinct ids numbered from 0 in their order, by ranges and the counts of the ranges before."""
    from pyspark.sql import Window

    ranged = scratch.keep(nodes.select("id").distinct().repartitionByRange("id").withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("_range", (F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("_before"))  # one row for each range
    rn = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    return scratch.keep(ranged.join(F.broadcast(before), "_range").select("id", (F.col("_before") + rn - 1).cast("long").alias("no")))


def _least_costs(e: DataFrame, roots: DataFrame, scratch: Scratch, nodes: int, delta: float | None, most_rounds: int | None) -> DataFrame:
    """(root, id, cost, hops, up) from each of ``roots`` (root), all nodes by number; a source is its own ``up``.

    A round takes the least (cost, hops, up) of each node. While the three fit one long they are compared as such, which Spark sums up by hashing; otherwise as a struct, by sorting.
    """
    kind = e.schema["weight"].dataType
    bounds = e.agg(F.coalesce(F.max(F.abs("weight")), F.lit(0)).alias("most"), F.coalesce(F.min("weight"), F.lit(0)).alias("least")).first()  # one row
    negative, places = bounds.least < 0, max(1, nodes.bit_length())
    best = scratch.keep(roots.select("root", F.col("root").alias("id"), F.lit(0).cast(kind).alias("cost"), F.lit(0).alias("hops"), F.col("root").alias("up"), F.lit(True).alias("open")))
    rounds, limit, reach = 0, delta, 0
    while True:
        now_open = F.col("open") if delta is None or negative else F.col("open") & (F.col("cost") < limit)
        front = best.where(now_open).select("root", F.col("id").alias("up"), "cost", "hops")
        step = front.join(e, F.col("up") == F.col("src")).select("root", F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).cast(kind).alias("cost"), (F.col("hops") + 1).alias("hops"), "up")
        tens = (rounds + 2).bit_length()  # no path has more hops than there were rounds
        if kind.typeName() in INTEGRAL and (int(reach) + int(bounds.most)).bit_length() + tens + places < 63:
            key = F.col("cost").cast("long") * (1 << (tens + places)) + F.col("hops") * (1 << places) + F.col("up")
            cost, hops, up = F.shiftright("key", tens + places).cast(kind), F.shiftright("key", places).bitwiseAND((1 << tens) - 1).cast("int"), F.col("key").bitwiseAND((1 << places) - 1)
            better = F.shiftright("key", places) < F.shiftright("old", places)  # another predecessor alone opens nothing
        else:
            key = F.struct("cost", "hops", "up")
            cost, hops, up = F.col("key.cost"), F.col("key.hops"), F.col("key.up")
            better = F.struct("key.cost", "key.hops") < F.struct("old.cost", "old.hops")
        held = best.select("root", "id", key.alias("key"), key.alias("old"), (F.col("open") & ~now_open).alias("open"))
        both = held.unionByName(step.select("root", "id", key.alias("key")), allowMissingColumns=True)
        met = both.groupBy("root", "id").agg(F.min("key").alias("key"), F.min("old").alias("old"), F.max("open").alias("open"))
        after = scratch.keep(met.select("root", "id", cost.alias("cost"), hops.alias("hops"), up.alias("up"), (F.col("old").isNull() | better | F.coalesce("open", F.lit(False))).alias("open")))
        scratch.drop(best)
        best, rounds = after, rounds + 1
        left = best.agg(F.min(F.when(F.col("open"), F.col("cost"))).alias("least"), F.max(F.abs("cost")).alias("reach"), F.count_if((F.col("root") == F.col("id")) & (F.col("cost") < 0)).alias("below")).first()  # one row
        if left.below or (negative and rounds > nodes and left.least is not None):
            raise ValueError("a source reaches a negative cycle")
        if left.least is None:
            return best.drop("open")
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"paths still change after {rounds} rounds")
        limit = None if delta is None else (left.least // delta + 1) * delta
        reach = left.reach


def _on_least_paths(e: DataFrame, costs: DataFrame, scratch: Scratch) -> DataFrame:
    """Undirected edges but those that cost more than the way by one of the landmarks, ``costs`` (root, id, cost), which no least path takes."""
    at = costs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("root", "cost"))).alias("at"))  # as many as landmarks
    both = e.join(at.withColumnsRenamed({"id": "src", "at": "a"}), "src", "left").join(at.withColumnsRenamed({"id": "dst", "at": "b"}), "dst", "left")
    way = F.array_min(F.map_values(F.map_zip_with("a", "b", lambda k, x, y: x + y)))
    return scratch.keep(both.where(F.coalesce(F.col("weight") <= way, F.lit(True))).select("src", "dst", "weight"))


def many_paths(edges: DataFrame, sources: DataFrame, directed: bool = False, delta: float | None = None, most_rounds: int | None = None) -> DataFrame:
    """(root, id, cost, hops, path): least-cost paths from each source (id) to all that it reaches along edges (src, dst, weight); of
    equal costs the fewest hops, then at each node the predecessor that sorts first. Weights are summed in their own type.

    Nodes are numbered in their order. Each round relaxes the edges of nodes that improved. Integral weights that aren't negative: the edges lie in blocks, the costs
    from ``blocks.WIDTH`` sources to a node are one row, and a source's paths are put together in a task unless they have over ``blocks.WALKED`` places. Else rows are single costs; with ``delta`` only those
    of the least open bucket of that width are relaxed, so that few costs are corrected twice; and paths are put together by joins that double their length each time.
    Of undirected edges with integral weights those that the costs of some of many sources rule out for certain are dropped first.
    Edges without end or weight are left out, parallel ones count at their least weight. Negative weights need ``directed`` edges; a
    negative cycle in reach of a source raises once more rounds than nodes have passed, or a source comes back to itself below nothing.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    e = edges.select("src", "dst", "weight").dropna()
    if not directed:
        e = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    named = scratch.keep(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    kind = named.schema["weight"].dataType
    bounds = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("weight"), F.lit(0)).alias("most"), F.coalesce(F.min("weight"), F.lit(0)).alias("least")).first()  # one row
    if not directed and bounds.least < 0:
        raise ValueError("a negative weight of an undirected edge is a negative cycle")
    starts = scratch.keep(sources.select("id").dropna().distinct())
    names = numbered(named.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(starts), scratch)
    by = {end: names.select(F.col("id").alias(end), F.col("no").alias(f"_{end}")) for end in ("src", "dst")}
    e = scratch.keep(named.join(by["src"], "src").join(by["dst"], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight"))
    roots = scratch.keep(starts.join(names, "id").select(F.col("no").alias("root")))
    scratch.drop(named, starts)
    many = roots.count()
    if kind.typeName() in INTEGRAL and bounds.least >= 0 and many:
        found = _block_paths(e, roots, names, scratch, directed, (bounds.n, bounds.most, many), most_rounds)
        if found is not None:
            return found.withColumn("cost", F.col("cost").cast(kind))
    best = _least_costs(e, roots, scratch, names.count(), delta, most_rounds)
    chain = best.join(names.withColumnRenamed("no", "id_no"), F.col("id_no") == best["id"]).select("root", best["id"].alias("no"), "cost", "hops", F.when(F.col("hops") > 0, F.col("up")).alias("up"), F.array(names["id"]).alias("path"))
    paths = _chained(chain, scratch)
    scratch.drop(best, e)
    return paths


def _chained(chain: DataFrame, scratch: Scratch) -> DataFrame:
    """(root, id, cost, hops, path) of rows (root, no, cost, hops, up, path) whose paths begin at themselves, by joins that double them."""
    chain = scratch.keep(chain)
    while not chain.where("up IS NOT NULL").isEmpty():
        head = chain.select("root", F.col("no").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_head"))
        longer = chain.join(head, ["root", "up"], "left").select("root", "no", "cost", "hops", F.col("_up").alias("up"), F.when(F.col("_head").isNull(), F.col("path")).otherwise(F.concat("_head", "path")).alias("path"))
        longer = scratch.keep(longer)
        scratch.drop(chain)
        chain = longer
    return chain.select(F.get("path", F.lit(0)).alias("root"), F.element_at("path", -1).alias("id"), "cost", "hops", "path")


def _block_paths(e: DataFrame, roots: DataFrame, names: DataFrame, scratch: Scratch, directed: bool, size: tuple[int, int, int], most_rounds: int | None) -> DataFrame | None:
    """(root, id, cost, hops, path) over edges in blocks, or None if a cost is too great for that. ``size``: edges, greatest weight, sources."""
    edges, most, many = size
    if not directed and many > 4 * LANDMARKS:
        few = numbered(roots.orderBy(F.xxhash64("root"), "root").limit(LANDMARKS).select(F.col("root").alias("id")), scratch)
        packed, needed, blocks = B.blocks_of(e, edges, scratch)
        state = B.least_keys(packed, needed, blocks, few, LANDMARKS, most, scratch, most_rounds)
        if state is None:
            return None
        e = _on_least_paths(e, B.cost_rows(state), scratch)
        scratch.drop(packed, needed, state)
        edges = e.count()
    packed, needed, blocks = B.blocks_of(e, edges, scratch)
    state = B.least_keys(packed, needed, blocks, numbered(roots.select(F.col("root").alias("id")), scratch), many, most, scratch, most_rounds)
    if state is None:
        return None
    rows = scratch.keep(B.predecessor_rows(state, packed, needed, blocks, many, names))
    scratch.drop(packed, needed, state)
    cost, hops = F.shiftright("key", B.HOPS).alias("cost"), F.col("key").bitwiseAND((1 << B.HOPS) - 1).cast("int").alias("hops")
    total = rows.groupBy("place").agg(F.sum(hops + 1).alias("places"), F.count(F.lit(1)).alias("n"))
    large = scratch.keep(total.where(F.col("places") > B.WALKED).select("place"))
    paths = B.walked(rows.join(large, "place", "left_anti"), rows.count()).select("root", "id", cost, hops, "path")
    if large.isEmpty():
        return paths
    once = rows.join(large, "place", "left_semi").groupBy(F.col("place").alias("root"), "no", "name").agg(F.min(F.struct("key", "up")).alias("m")).select("root", "no", "name", "m.*")
    return paths.unionByName(_chained(once.select("root", "no", cost, hops, F.when(F.col("up") >= 0, F.col("up")).alias("up"), F.array("name").alias("path")), scratch))


def path_answers(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(root, target, cost, path) of each asked pair (root, target); where there is no path, null and one message in its place."""
    found = paths.select("root", F.col("id").alias("target"), "cost", "path")
    message = F.array(F.concat(F.lit("No path exists between '"), F.col("root"), F.lit("' and '"), F.col("target"), F.lit("'")))
    return pairs.select("root", "target").join(found, ["root", "target"], "left").select("root", "target", "cost", F.coalesce("path", message).alias("path"))


def delta_merge(base: DataFrame, delta: DataFrame, key: str, number: str) -> DataFrame:
    """Rows of ``delta`` replace those of the same key; they are numbered on from the largest ``number``, in order of the key.

    The delta is dealt to ranges of the key; a range's rows are numbered within it, after the counts of the ranges before.
    """
    from pyspark.sql import Window

    kept = base.join(delta.select(key), key, "left_anti")
    top = base.agg(F.coalesce(F.max(number), F.lit(-1)).alias("top"))
    fresh = Scratch(delta.sparkSession).keep(delta.drop(number).repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    before = fresh.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("_range", (F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("_before"))  # one row for each range
    rn = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    fresh = fresh.join(F.broadcast(before), "_range").withColumn("_rn", rn).join(F.broadcast(top))  # as many rows as ranges, and one
    return kept.unionByName(fresh.withColumn(number, (F.col("top") + F.col("_before") + F.col("_rn")).cast("long")).drop("top", "_range", "_before", "_rn"))


def node_schema(nodes: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(label, properties): sorted names of the properties of nodes (label, properties map) that have a value."""
    each = nodes.select("label", F.explode(F.map_filter("properties", lambda k, v: v.isNotNull())).alias("k", "v")).where(~F.col("k").isin(*exclude))
    return each.select("label", "k").distinct().groupBy("label").agg(F.array_sort(F.collect_list("k")).alias("properties"))


def edge_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, rel, end) labels that edges (subj, rel, obj) join, each once."""
    label = nodes.select("id", "label")
    both = edges.join(label.withColumnsRenamed({"id": "subj", "label": "start"}), "subj").join(label.withColumnsRenamed({"id": "obj", "label": "end"}), "obj")
    return both.select("start", "rel", "end").distinct()


def delete_triplets(nodes: DataFrame, edges: DataFrame, gone: DataFrame, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (subj, rel, obj) without the triplets ``gone``; ``prune`` drops their ends if no edge is left there."""
    left = edges.join(gone.select("subj", "rel", "obj"), ["subj", "rel", "obj"], "left_anti")
    if not prune:
        return nodes, left
    ends = lambda df: df.select(F.explode(F.array("subj", "obj")).alias("id")).distinct()
    return nodes.join(ends(gone).join(ends(left), "id", "left_anti"), "id", "left_anti"), left


def bulk_elements(elements: DataFrame, mentions: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (subj, rel, obj) of parsed elements (source, nodes, relations), each once; ``mentions`` adds an edge from each source to its nodes."""
    nodes = elements.select("source", F.explode("nodes").alias("n")).select("source", F.col("n.id").alias("id"), F.col("n.type").alias("type"))
    edges = elements.select(F.explode("relations").alias("r")).select("r.subj", F.col("r.type").alias("rel"), "r.obj")
    if mentions:
        edges = edges.unionByName(nodes.select(F.col("source").alias("subj"), F.lit("MENTIONS").alias("rel"), F.col("id").alias("obj")))
    return nodes.select("id", "type").dropDuplicates(["id", "type"]), edges.distinct()


def entity_frequency(edges: DataFrame) -> DataFrame:
    """(id, degree, rank): edges at each node and its dense rank by them."""
    from pyspark.sql import Window

    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    levels = ends.select("degree").distinct().select("degree", F.dense_rank().over(Window.orderBy(F.desc("degree"))).cast("long").alias("rank"))  # distinct degrees only
    return ends.join(levels, "degree").select("id", "degree", "rank")


def to_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) lines of a graph: one for each node and each edge, so that no row holds the whole graph."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def from_node_link(lines: DataFrame, node_schema_: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda kind, schema: lines.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")
    return pick("node", node_schema_), pick("link", edge_schema)


def crawl(links: DataFrame, start: DataFrame, most_depth: int) -> DataFrame:
    """(id, depth) of what directed links (src, dst) reach from the start (id), each at its least depth."""
    scratch = Scratch(links.sparkSession)
    seen = start.select("id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, most_depth + 1):
        step = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = scratch.keep(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def command_tree(trees: DataFrame, most_depth: int = 15) -> DataFrame:
    """(prefix, depth, module) of nested <cmd name=".."> elements (xml), each prefix once, to ``most_depth``; the module is the first name.

    Tags are read in order; a fold over them keeps the open names and collects every path.
    """
    tags = F.regexp_extract_all("xml", F.lit(r'<cmd name="[^"]*"\s*/?>|</cmd>'), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<array<string>>").alias("found"))

    def read(state, tag):
        name = F.regexp_extract(tag, r'name="([^"]*)"', 1)
        path = F.concat(state["open"], F.array(name))
        shut = F.when(F.size(state["open"]) > 1, F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)).otherwise(F.array().cast("array<string>"))
        kept = F.when(F.startswith(tag, F.lit("</")), shut).when(F.endswith(tag, F.lit("/>")), state["open"]).otherwise(path)
        found = F.when(F.startswith(tag, F.lit("</")), state["found"]).otherwise(F.concat(state["found"], F.array(path)))
        return F.struct(kept.alias("open"), found.alias("found"))

    paths = trees.select(F.explode(F.aggregate(tags, start, read)["found"]).alias("p")).where(F.size("p") <= most_depth)
    return paths.select(F.array_join("p", " ").alias("prefix"), F.size("p").alias("depth"), F.get("p", F.lit(0)).alias("module")).distinct()
