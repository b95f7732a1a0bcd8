"""Sets, samples, sheets, windows and trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.functions.text import strip
from corpusloom.operators.graph import both_ways, step_rows
from corpusloom.session import Scratch, dealt


def rouge_rejects(texts: DataFrame, corpus: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id) of ``texts`` (id, text) for which some text of ``corpus`` has a ROUGE-L F above ``threshold``.

    F above t means that the two share more than t (n + m) / 2 words and that the shorter has over t / (2 - t) of the
    longer's. So some shared word is among the n - ceil(t / (2 - t) * n) + 1 rarest of either (occurrences counted
    apart): only pairs that meet there are compared, the words of a text by bits of one integer. Texts whose length no
    text of the corpus comes near are left out before anything moves; words that the corpus lacks are only counted.
    """
    least = threshold / (2 - threshold)

    def words(df: DataFrame, side: str) -> DataFrame:
        split = F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != "")
        return df.select(F.col("id").alias(f"{side}_id"), split.alias(f"{side}_words"), F.size(split).alias(f"{side}_n")).where(f"{side}_n > 0")

    grade = lambda n: F.floor(F.log(n) / (-1.001 * math.log(least))).cast("int")  # noqa: E731  lengths in reach are at most one apart
    b = words(corpus, "b")
    grades = b.select(F.explode(F.array(*[grade(F.col("b_n")) + i for i in (-1, 0, 1)])).alias("g")).agg(F.collect_set("g").alias("grades"))  # some five for each factor of ten
    a = words(texts, "a").join(F.broadcast(grades)).where(F.array_contains("grades", grade(F.col("a_n")))).drop("grades")  # one row

    def counted(df: DataFrame, side: str) -> DataFrame:
        one = df.select(f"{side}_id", f"{side}_n", F.explode(f"{side}_words").alias("w")).groupBy(f"{side}_id", f"{side}_n", "w").agg(F.count(F.lit(1)).alias("k"))
        return one.select(f"{side}_id", f"{side}_n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat_ws(":", "w", i.cast("string")))).alias("w"))

    ac, bc = counted(a, "a"), counted(b, "b")
    df = bc.groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def prefix(c: DataFrame, side: str) -> DataFrame:
        of = Window.partitionBy(f"{side}_id")
        lacking = F.col(f"{side}_n") - F.count(F.lit(1)).over(of)  # they come first, being rarest
        ranked = c.join(df, "w").withColumn("rn", lacking + F.row_number().over(of.orderBy("df", "w")))
        return ranked.where(F.col("rn") <= F.col(f"{side}_n") - F.ceil(least * F.col(f"{side}_n") - 1e-9) + 1).select(f"{side}_id", f"{side}_n", "w")

    shorter, longer = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    pairs = prefix(ac, "a").join(prefix(bc, "b"), "w").where(shorter > least * longer - 1e-9).select("a_id", "b_id").distinct()
    scored = pairs.join(a, "a_id").join(b, "b_id").select("a_id", P.rouge_l("a_words", "b_words").alias("f"))
    return scored.where(F.col("f") > threshold).select(F.col("a_id").alias("id")).distinct()


def score_threshold(scores: Column, threshold: float | int | dict[str, float]) -> Column:
    """A float: all scores of the map reach it; a map: each named one does, a missing one being 0; an int lets everything pass."""
    if isinstance(threshold, dict):
        out = F.lit(True)
        for name, least in threshold.items():
            out = out & (F.coalesce(scores[name], F.lit(0.0)) >= least)
        return out
    return F.forall(F.map_values(scores), lambda v: v >= threshold) if isinstance(threshold, float) else F.lit(True)


def valid_points(rows: DataFrame, required: tuple[str, ...], strict: bool, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows whose required texts aren't blank, and the others; ``strict`` fails the job at the first of those, fewer than ``least`` good rows raise."""
    fine = F.lit(True)
    for name in required:
        fine = fine & F.coalesce(strip(F.col(name)) != "", F.lit(False))
    if strict:
        return rows.where(F.assert_true(fine, F.lit("a required field is missing")).isNull()), rows.where(F.lit(False))
    good = rows.where(fine)
    if least and good.limit(least).count() < least:
        raise ValueError(f"fewer than {least} valid rows")
    return good, rows.where(~fine)


def greedy_diverse(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id) kept of (id, vector): an item stays unless an earlier kept one has a cosine of at least ``threshold``.

    Links between items are found by cells of matrix products. Then, in rounds, an item whose earlier linked items are all
    decided is decided: it goes if one of them stays. Each round is a few joins over what is undecided, so no group is
    gathered; the rounds are as many as the longest chain of decisions.
    """
    from corpusloom.operators.vector import similar_pairs

    scratch = Scratch(vectors.sparkSession)
    links = scratch.keep(similar_pairs(vectors, threshold).select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")))
    dropped = None
    open_ = links
    while not open_.isEmpty():
        waiting = open_.select(F.col("late").alias("early")).distinct()
        free = open_.join(waiting, "early", "left_anti")  # links whose earlier end is kept: it waits for nothing
        gone = scratch.keep(free.select(F.col("late").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(gone.withColumnRenamed("id", "late"), "late", "left_anti").join(gone.withColumnRenamed("id", "early"), "early", "left_anti")
        open_ = scratch.keep(rest)
    return vectors.select("id") if dropped is None else vectors.select("id").join(dropped, "id", "left_anti")


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """(qid, text, place) of lists (qid, text, pos) one after the other, each text once, at its first place."""
    both = None
    for i, df in enumerate(lists):
        part = df.select("qid", "text", F.struct(F.lit(i).alias("list"), F.col("pos").cast("long").alias("pos")).alias("key"))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("qid", "text").agg(F.min("key").alias("key"))
    return first.select("qid", "text", (F.row_number().over(Window.partitionBy("qid").orderBy("key")) - 1).cast("long").alias("place"))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def hash_order(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def slice_from(df: DataFrame, n: int, start: int, order: str) -> DataFrame:
    """``n`` rows in order from place ``start``; fewer than ``n`` after it start earlier."""
    return df.orderBy(order).offset(start).limit(n)


def mixed_sample(human: DataFrame, machine: DataFrame, n_human: int = 6, n_machine: int = 2, seed: int = 3) -> DataFrame:
    """(place, instruction): seeded samples of both, padded with blanks where the second is short."""
    def pick(df: DataFrame, n: int, first: int) -> DataFrame:
        top = df.orderBy(hash_order(seed, "instruction"), "instruction").limit(n)
        place = F.row_number().over(Window.orderBy(hash_order(seed, "instruction"), "instruction")) + first - 1  # at most n rows
        return top.select(place.cast("long").alias("place"), "instruction")

    places = human.sparkSession.range(n_human + n_machine).withColumnRenamed("id", "place")
    held = pick(human, n_human, 0).unionByName(pick(machine, n_machine, n_human))
    return places.join(held, "place", "left").select("place", F.coalesce("instruction", F.lit("")).alias("instruction"))


def random_walk(edges: DataFrame, starts: DataFrame, steps: int, restart: float = 0.1, seed: int = 11, by_neighbours: bool = False) -> DataFrame:
    """(root, step, id): walks along undirected edges from each start (id); with probability ``restart`` a step goes back to the root.

    The next node is the neighbour of the least hash of seed, root, step and itself, so walks are the same in every run;
    ``by_neighbours`` weighs neighbours by how few they have in common with the node (1 - Jaccard).
    """
    scratch = Scratch(edges.sparkSession)
    both, degree = both_ways(edges, scratch)
    weight = F.lit(1.0)
    if by_neighbours:
        common = both.alias("x").join(both.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")).where("src <> dst")
        common = common.join(both, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
        both = both.join(common, ["src", "dst"], "left").join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
        weight = 1 - F.coalesce("c", F.lit(0)) / F.greatest(F.col("n") + F.col("m") - F.coalesce("c", F.lit(0)), F.lit(1))
    both = scratch.keep(both.select("src", "dst", weight.alias("weight")))
    links = both.count()
    draw = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    now = starts.select(F.col("id").alias("root"), F.lit(0).alias("step"), "id")
    out = now
    for step in range(1, steps + 1):
        moved = now.join(dealt(both, max(links, step_rows(now, degree)), "src"), F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), (-F.log(draw("root", F.lit(step), "dst")) / F.greatest("weight", F.lit(1e-9))).alias("key"))
        moved = moved.groupBy("root").agg(F.min_by("id", F.struct("key", "id")).alias("id"))
        back = draw("root", F.lit(-step)) < restart
        now = scratch.keep(moved.select("root", F.lit(step).alias("step"), F.when(back, F.col("root")).otherwise(F.col("id")).alias("id")))
        out = out.unionByName(now)
    return out


# sheets as cells (row, col, value), both from 1


def sheet_rows(cells: DataFrame, width: int, drop_empty: bool = True) -> DataFrame:
    rows = cells.groupBy("row").pivot("col", list(range(1, width + 1))).agg(F.first("value"))
    rows = rows.select("row", *[F.col(str(i)).alias(f"c{i}") for i in range(1, width + 1)])
    return rows.dropna("all", subset=[f"c{i}" for i in range(1, width + 1)]) if drop_empty else rows


def cell_range(cells: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    return cells.where(F.col("row").between(first[0], last[0]) & F.col("col").between(first[1], last[1]))


def find_cells(cells: DataFrame, value: str, col: int | None = None) -> DataFrame:
    found = cells.where(F.col("value") == value)
    return (found if col is None else found.where(F.col("col") == col)).select("row", "col")


def set_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    return cells.join(new.select("row", "col"), ["row", "col"], "left_anti").unionByName(new)


def update_row(cells: DataFrame, row: int, new: DataFrame) -> DataFrame:
    """The row's cells become those of ``new`` (col, value); trailing ones are cleared."""
    return cells.where(F.col("row") != row).unionByName(new.select(F.lit(row).cast(cells.schema["row"].dataType).alias("row"), "col", "value"))


def append_row(cells: DataFrame, new: DataFrame) -> DataFrame:
    last = cells.agg(F.coalesce(F.max("row"), F.lit(0)).alias("last"))
    return cells.unionByName(new.join(F.broadcast(last)).select((F.col("last") + 1).cast(cells.schema["row"].dataType).alias("row"), "col", "value"))  # one row


def delete_lines(cells: DataFrame, first: int, n: int, axis: str = "row") -> DataFrame:
    kept = cells.where(~F.col(axis).between(first, first + n - 1))
    return kept.withColumn(axis, F.when(F.col(axis) >= first + n, F.col(axis) - n).otherwise(F.col(axis)))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """(line) of the table in pipe form, ordered; header and separator come first."""
    names = df.columns
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = df.select(F.lit(2).alias("_k"), *[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.concat(F.lit("| "), F.concat_ws(" | ", *[text(c) for c in names]), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "|".join("---" for _ in names) + "|")], "_k int, line string")
    return head.unionByName(body, allowMissingColumns=True).orderBy("_k", *[f"_{i}" for i in range(len(order))]).select("line")


# trees and orders


DEEPEST = 64  # levels of headings


def heading_paths(heads: DataFrame) -> DataFrame:
    """(doc, pos, path): titles of the open headings (doc, pos, level, title) above and at each one, joined by " > ".

    There are as many levels as the table has, from 1; one above ``DEEPEST`` raises.
    """
    most = heads.agg(F.max("level")).first()[0] or 1
    if most > DEEPEST:
        raise ValueError(f"a heading of level {most}")
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = heads.select("doc", "pos", "level", *[F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w).alias(f"h{k}") for k in range(1, most + 1)])
    titles, latest = [], F.lit(-1).cast("long")
    for k in range(1, most + 1):
        h = F.col(f"h{k}")
        titles.append(F.when((F.col("level") >= k) & h.isNotNull() & (h.pos > F.col(f"c{k}")), h.title))
        open_ = open_.withColumn(f"c{k}", latest)  # the last heading above level k
        latest = F.greatest(F.col(f"c{k}"), F.coalesce(h.pos, F.lit(-1).cast("long")))
    return open_.select("doc", "pos", F.array_join(F.array_compact(F.array(*titles)), " > ").alias("path"))


def depths(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) of a forest (id, parent): 1 for roots, parents + 1 else. A cycle raises: its nodes reach no root."""
    scratch = Scratch(nodes.sparkSession)
    level = scratch.keep(nodes.where("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(1).alias("depth")))
    out, total = level, nodes.count()
    found = level.count()
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), "root", (F.col("depth") + 1).alias("depth"))
        level = scratch.keep(nodes.select("id", "parent").join(up, "parent").select("id", "root", "depth"))
        found += level.count()
        out = out.unionByName(level)
    if found < total:
        raise ValueError(f"{total - found} nodes reach no root: a cycle, or a missing parent")
    return out


def subtree_sums(nodes: DataFrame, value: str) -> DataFrame:
    """(id, total): a node's value and those of all below it, added up level by level from the deepest."""
    scratch = Scratch(nodes.sparkSession)
    depth = scratch.keep(depths(nodes.select("id", "parent")).join(nodes.select("id", "parent", value), "id"))
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    below = None
    out = None
    for at in range(deepest, 0, -1):
        here = depth.where(F.col("depth") == at)
        if below is not None:
            sums = below.groupBy("parent").agg(F.sum("total").alias("under")).withColumnRenamed("parent", "id")
            here = here.join(sums, "id", "left").withColumn(value, F.coalesce(value, F.lit(0)) + F.coalesce("under", F.lit(0))).drop("under")
        below = scratch.keep(here.select("id", "parent", F.coalesce(value, F.lit(0)).alias("total")))
        out = below if out is None else out.unionByName(below)
    return out.select("id", "total")


def post_order(nodes: DataFrame) -> DataFrame:
    """(id, place): within each root's tree, children by id come before their parent. Paths of sort keys from the root give
    the order: a node sorts after every longer path that it begins."""
    scratch = Scratch(nodes.sparkSession)
    key = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    level = scratch.keep(nodes.where("parent IS NULL").select("id", F.col("id").alias("root"), key("id").alias("path")))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), "root", "path")
        level = scratch.keep(nodes.select("id", "parent").join(up, "parent").select("id", "root", F.concat_ws("/", "path", key("id")).alias("path")))
        out = out.unionByName(level)
    return out.select("id", "root", F.row_number().over(Window.partitionBy("root").orderBy(F.concat("path", F.lit("~")))).cast("long").alias("place"))


def cyclic(dependencies: DataFrame) -> DataFrame:
    """(id) of the tasks (task_id, dep_id) that no order can reach: on a cycle or behind one. Tasks whose dependencies are all settled go, round by round."""
    scratch = Scratch(dependencies.sparkSession)
    left = scratch.keep(dependencies.select("task_id", "dep_id").where("dep_id IS NOT NULL").distinct())
    n, was = left.count(), -1
    while n and n != was:
        open_ = left.select(F.col("task_id").alias("dep_id")).distinct()
        left = scratch.keep(left.join(open_, "dep_id", "left_semi").select("task_id", "dep_id"))
        was, n = n, left.count()
    return left.select(F.col("task_id").alias("id")).distinct()


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place, from 1, of each row in its group, in a column ``name``. Rows are dealt to ranges of group and order, so that a hot
    group is many tasks' work; a range numbers its own rows and adds the counts of the ranges before."""
    dealt = Scratch(df.sparkSession).keep(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_range")
    before = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"))  # one row for each group and range
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    placed = dealt.withColumn("_own", own).join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_group", "_r", "_before")


def running_offsets(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, number): rows numbered on from group to group; offsets are sums over groups."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(group, (F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("offset"))  # one row for each group
    placed = numbered(df.select(group, order), group, [order], "_place")
    return placed.join(before, group).select(group, order, (F.col("offset") + F.col("_place")).alias("number"))


def batches(df: DataFrame, group: str, order: str, size: int = 50) -> DataFrame:
    """(group, order, batch): rows of each group in order, ``size`` to a batch."""
    return numbered(df.select(group, order), group, [order], "_place").select(group, order, F.floor((F.col("_place") - 1) / size).cast("long").alias("batch"))


def merged_pieces(docs: DataFrame) -> DataFrame:
    """(id, source, place, text): the texts of each source in order of doc_id, each headed by its language, as the pieces of one document; sources
    are numbered by their first doc_id (a null source is one of its own). A document is its pieces joined by empty lines; it is not built as one value, since it has no bound."""
    lang = F.coalesce("lang", F.lit("unknown"))
    pieces = numbered(docs.select("source", "doc_id", F.concat(F.lit("["), lang, F.lit("] "), F.coalesce("text", F.lit(""))).alias("text")), "source", ["doc_id", "text"], "place")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    number = F.row_number().over(Window.orderBy("first", F.col("source").asc_nulls_first())) - 1  # one row for each source
    ids = first.select(F.col("source").alias("_source"), F.format_string("src_%04d", number).alias("id"))
    return pieces.join(ids, F.col("source").eqNullSafe(F.col("_source"))).select("id", "source", "place", "text")
