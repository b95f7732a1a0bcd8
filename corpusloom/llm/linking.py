"""Groups of linked items: candidate buckets, exact checks, connected components, all as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every item on an edge (a, b); the component is its smallest id.

    Alternating large-star and small-star steps: each item links its neighbours to the smallest of
    them, until nothing changes. Every step is a grouped minimum, combined before the shuffle, and a
    join; each round is written, so a lost executor repeats one round only.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = None
    while (state := _state(now)) != was:
        was = state
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        then = scratch.keep(small.distinct())
        scratch.drop(now, large)
        now = then
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def pairs_across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members`` (bucket, id, component) that share a bucket and lie in different components."""
    x, y = members.alias("x"), members.alias("y")
    both = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")))
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def link_components(buckets: DataFrame, check: Callable[[DataFrame], DataFrame], scratch: Scratch, across: Callable[[DataFrame], DataFrame] = pairs_across, again: Callable[[DataFrame, int], DataFrame] | None = None, rounds: int = 1, crowd: int = 64) -> DataFrame:
    """(id, component) of all items that some chain of links joins, smallest id first; unlinked items have no row.

    ``buckets`` (bucket, id): two items can only be linked if they share a bucket. ``check`` takes
    candidate pairs (a, b) and returns the linked ones. First every item is checked against the smallest
    of each of its buckets, which joins a group of copies without forming its pairs; then only pairs that share a bucket and lie in different components are left to check, so no link between
    components is lost. ``across`` finds them among (bucket, id, component) rows; it may leave out pairs
    that can't be links. Before it, ``again`` may give further pairs from the rows of buckets of more than ``crowd`` members, linear in the size of
    each bucket, whose links join most of what is left; it is asked up to ``rounds`` times, while it finds a link for every hundred rows. Smaller buckets
    have at most ``crowd`` pairs a member, which costs less than a round.
    """
    whole = Window.partitionBy("bucket")  # one shuffle gives both the size and the smallest
    placed = buckets.select("bucket", "id", F.min("id").over(whole).alias("pivot"), F.max("id").over(whole).alias("last"))
    shared = scratch.keep(placed.where("pivot < last").select("bucket", "id", "pivot"))
    pairs = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.keep(check(pairs))
    first = scratch.keep(connected_components(links, scratch))

    def joined(more: DataFrame) -> DataFrame:
        held = first.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        return connected_components(held.unionAll(more.select("a", "b")), scratch)

    def split_members(members: DataFrame) -> DataFrame:
        """The rows of buckets that lie in several components, the pivot's row included in that question alone."""
        placed = members.join(first, "id", "left").select("bucket", "id", "pivot", F.coalesce("component", "id").alias("component"))
        split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size")
        return scratch.keep(placed.join(split, "bucket"))

    def others(members: DataFrame) -> DataFrame:
        return members.where("id <> pivot").select("bucket", "id", "component")

    left = split_members(shared)
    scratch.drop(shared)
    few = None
    if again is not None:
        few, left = left.where(F.col("size") <= crowd), scratch.keep(left.where(F.col("size") > crowd))
        for turn in range(rounds):
            more = scratch.keep(check(again(others(left), turn)))
            links, rows = more.count(), left.count()
            if not links:
                break
            before, first = first, scratch.keep(joined(more))
            stale, left = left, split_members(left.select("bucket", "id", "pivot"))
            scratch.drop(stale, more, before)
            if 100 * links < rows:
                break
    rest = across(others(left if few is None else few.unionByName(left))).distinct()
    more = scratch.keep(check(rest))
    return first if more.isEmpty() else joined(more)
