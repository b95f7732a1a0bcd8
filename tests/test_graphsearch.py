"""Communities against a plain loop, reports and searches against counts by hand."""

import random
import zlib
from collections import defaultdict

import pytest

from corpusloom.operators import graphsearch as S

EDGE = "src string, dst string, weight long"


def _crc(*parts):
    return zlib.crc32(":".join(map(str, parts)).encode())


def _plain(edges, levels, most_rounds=20, seed=0):
    links = defaultdict(int)
    for a, b, w in edges:
        if a is not None and b is not None and a != b:
            links[a, b] += w or 0
            links[b, a] += w or 0
    home = {a: a for a, _ in links}
    out = set()
    for level in range(levels):
        label = {n: n for n in home.values()}
        for at in range(most_rounds):
            votes = defaultdict(lambda: defaultdict(int))
            for (a, b), w in links.items():
                votes[b][label[a]] += w
            best = {n: min(votes[n], key=lambda x: (-votes[n][x], x != label[n], _crc(seed, x), x)) if n in votes else label[n] for n in label}
            moved = any(best[n] != label[n] for n in label)
            label = {n: best[n] if _crc(seed, level, at, n) % 2 == 0 else label[n] for n in label}
            if not moved:
                break
        least = {}
        for n, at_ in home.items():
            least[label[at_]] = min(n, least.get(label[at_], n))
        to = {n: least[label[n]] for n in label}
        home = {n: to[v] for n, v in home.items()}
        out |= {(n, level, c) for n, c in home.items()}
        joined = defaultdict(int)
        for (a, b), w in links.items():
            if to[a] != to[b]:
                joined[to[a], to[b]] += w
        links = joined
    return out


def _blocks():
    rng = random.Random(3)
    edges = []
    for g in range(4):
        edges += [(f"{g}{i:02}", f"{g}{j:02}", rng.randrange(1, 4)) for i in range(12) for j in range(i) if rng.random() < 0.6]
    edges += [("000", "100", 1), ("200", "300", 1), ("005", "005", 9), ("300", None, 2), ("102", "000", None), ("000", "100", 1)]
    return edges


@pytest.mark.parametrize("edges", [_blocks(), [("a", "b", 1)], [("a", "a", 1)]])
def test_communities_are_those_of_a_plain_loop(spark, edges):
    got = {(r.id, r.level, r.community) for r in S.communities(spark.createDataFrame(edges, EDGE), levels=2).collect()}
    assert got == _plain(edges, 2)
    if len(edges) > 9:  # four dense blocks joined by single edges: none is mixed with another, though one comes out in parts
        first = [(n, c) for n, level, c in got if level == 0]
        assert all(n[0] == c[0] for n, c in first) and len({c for _, c in first}) <= 6


@pytest.mark.parametrize("block, hub", [(30, 1 << 22), (30, 0)])
def test_communities_over_blocks(spark, monkeypatch, block, hub):
    """Links in many blocks that send each other labels, and votes as rows where a node has too many links for a task; great weights."""
    from corpusloom.operators import voting

    monkeypatch.setattr(voting, "BLOCK", block)
    monkeypatch.setattr(S, "HUB", hub)
    packs = []
    blocks_of = voting.blocks_of
    monkeypatch.setattr(voting, "blocks_of", lambda *args: [packed := blocks_of(*args), packs.append(packed.count())][0])
    edges = [*_blocks(), ("000", "00é", 1 << 40), ("é", "00é", 1)]
    got = {(r.id, r.level, r.community) for r in S.communities(spark.createDataFrame(edges, EDGE), levels=2, seed=2).collect()}
    assert got == _plain(edges, 2, seed=2) and (packs[0] > 4 if hub else not packs)


def test_reports_and_searches(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 1), ("b", "c", 2), ("x", "y", 5), ("c", "x", 1)], EDGE)
    members = spark.createDataFrame([(n, 0, "a" if n in "abc" else "x") for n in "abcxy"], "id string, level int, community string")
    reports = S.community_reports(edges, members, most_named=2)
    rows = {r.community: (r.level, r.size, round(r.rating, 4), r.text) for r in reports.collect()}
    assert rows == {"a": (0, 3, round(12 / 13, 4), "b a"), "x": (0, 2, round(10 / 11, 4), "x y")}

    queries = spark.createDataFrame([("q", "X  y Y b"), ("none", None), ("other", "zzz")], "query_id string, text string")
    hits = [(r.query_id, r.id, round(r.score, 4), r.place) for r in S.global_search(queries, reports).orderBy("place").collect()]
    assert hits == [("q", "x", round(2 * 21 / 11, 4), 1), ("q", "a", round(25 / 13, 4), 2)]

    mentions = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (2, "c", 1), (3, "y", 4)], "unit long, id string, weight long")
    seeds = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "a"), ("q", None)], "query_id string, id string")
    found = {(r.kind, r.id, round(r.score, 4), r.place) for r in S.local_search(seeds, edges, mentions, members, reports, top_k=2).collect()}
    assert found == {("entity", "b", 6.0, 1), ("entity", "x", 1.0, 2), ("relationship", "a-b", 4.0, 1), ("relationship", "b-c", 2.0, 2), ("source", "1", 3.0, 1), ("source", "2", 1.0, 2), ("report", "a", round(12 / 13, 4), 1)}
    drift = {(r.kind, r.id) for r in S.drift_search(queries, seeds, edges, mentions, members, reports, primer=1).collect()}
    assert ("source", "3") in drift and ("report", "x") in drift and ("entity", "b") in drift and ("entity", "x") not in drift
    assert S.communities(spark.createDataFrame([], EDGE), levels=1).count() == 0


def test_few_moves_read_few_links(spark):
    """A chain of triangles settles slowly, so that votes are kept and changed as well as made anew; a weight of nothing and parallel edges count as before."""
    rng = random.Random(5)
    edges = [(f"n{i:03}", f"n{i + k:03}", rng.randrange(0, 3)) for i in range(150) for k in (1, 2)] + [("n000", "n149", 0)]
    got = {(r.id, r.level, r.community) for r in S.communities(spark.createDataFrame(edges, EDGE), levels=2, seed=4).collect()}
    assert got == _plain(edges, 2, seed=4)


def test_asked_edges_are_cut_down_before_they_are_summed(spark, capsys):
    edges = spark.createDataFrame([("a", "b", 3)], EDGE)
    mentions = spark.createDataFrame([(1, "a", 2)], "unit long, id string, weight long")
    S.local_search(spark.createDataFrame([("q", "a")], "query_id string, id string"), edges, mentions).explain("extended")
    plan = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert plan.count("LeftSemi") >= 3
