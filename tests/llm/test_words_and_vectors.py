"""Spelling variants, centroids and toxic words against plain forms."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import centroids, registry, spelling, toxicity
from corpusloom.llm.centroids import LloydConfig
from corpusloom.llm.spelling import SpellingConfig
from corpusloom.session import table
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_operators import make

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(docs, noise):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            word = brute.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_spellings(docs, noise=31):
    n = plain_counts(docs, noise)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def spelled(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def awkward_texts():
    rng = random.Random(4)
    base = ["aabbaab", "abababab", "aaaaaaa", "aaaaaaaa", "mississippi", "Élèvement", "straßenbahn", "élèvement", "x" * 400]
    words = list(base)
    for w in base * 12:
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abxé") + w[at:], w[:at] + rng.choice("abxé") + w[at + 1 :]])
        words.append(w)
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    texts += ["aabbaab, " * 3000, ("aabbaab " * 200 + "aabbab ") * 8, "aabbba " * 25, "chainword " * 3000, "chanword " * 250, "chnword " * 15, None, "", "123 !?", "short words only", "x" * 400, texts[0], texts[0]]
    return texts


def test_spellings_are_those_of_all_pairs(spark):
    texts = awkward_texts()
    docs = make(spark, texts)
    got = spelled(spelling.group_spellings(docs, SpellingConfig(noise=31)))
    want = plain_spellings(list(enumerate(texts, 1)))
    assert got == want
    assert any(v[2] for v in want.values()) and any(want[v[2]][2] for v in want.values() if v[2])


def test_spellings_of_the_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, f"{DATA}/sf0.001", "documents").collect()]
    n = plain_counts(docs, 31)
    keys = defaultdict(set)
    for w in n:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keys[k].add(w)
    near = {w: {v for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in keys[k] if one_edit(w, v)} for w in n}
    got = spelled(registry.op11_deletion_keys(spark, f"{DATA}/sf0.001"))
    assert {w: v[:2] for w, v in got.items()} == {w: (n[w], len(near[w])) for w in n}
    for w, (_, _, form, _, _) in got.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        assert form == (best if best is not None and n[best] >= 10 * n[w] else None)


def test_spellings_of_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, "spelling spelling"), (None, None), (3, "")], "doc_id long, text string")
    assert spelled(spelling.group_spellings(docs)) == {"spelling": (2, 0, None, None, "spelling")}
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def test_deletion_keys_are_those_of_the_strings():
    words = ["abcabc", "aab", "é" * 5, "x"]
    of, place, key = spelling.deletion_keys(words)
    named = {(words[w], int(p)): int(k) for w, p, k in zip(of, place, key)}
    whole = {w: named[w, spelling.WHOLE] for w in words}
    of2, place2, key2 = spelling.deletion_keys(["bcabc", "ab", "é" * 4])
    assert [int(k) for p, k in zip(place2, key2) if p == spelling.WHOLE] == [named["abcabc", 0], named["aab", 0], named["é" * 5, 0]]
    assert named["aab", 0] == named["aab", 1 + (1 << 30)] and len(set(whole.values())) == len(words)


def test_equal_keys_of_unlike_strings_are_told_apart():
    rows = [(0, 1, "xbcdefg", 5), (0, 2, "ybcdefg", 50), (0, 3, "xhijklm", 7), (spelling.WHOLE, 4, "hijklm", 9)]
    got = {r[0]: r[1:] for r in spelling.near_of_key(rows)}
    assert got == {1: (1, 50, "ybcdefg", 2), 2: (1, 5, "xbcdefg", 1), 3: (1, 9, "hijklm", 4), 4: (1, 7, "xhijklm", 3)}


def plain_lloyd(rows, config):
    kept = [(i, [math.floor(config.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == config.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    c = [x for _, x in sorted(((hashlib.sha256(f"{config.seed}:{i}".encode()).hexdigest(), x) for i, x in kept))[: config.clusters]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(c))

    for _ in range(config.rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        c = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else y for k, y in enumerate(c)]
    placed = [(i, *near(x)) for i, x in kept]
    own = Counter()
    for _, d, k in placed:
        own[k] += d
    return sorted((i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in placed)


def lloyd_rows(df):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("block", [16, 4096])
def test_lloyd_is_the_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 1, (7, 5))
    rows = [(i, [float(v) for v in middles[i % 7] + rng.normal(0, 0.1, 5)]) for i in range(160)]
    rows += [(i, [0.5] * 5) for i in range(200, 260)]  # copies, so that centroids coincide and ties arise
    rows += [(300, None), (301, [1.0] * 4), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (7, rows[7][1])]
    config = LloydConfig(clusters=12, dimensions=5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x"))
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert lloyd_rows(centroids.lloyd(df, config)) == plain_lloyd(exact, config)
    assert centroids.lloyd(df.limit(0), config).count() == 0
    few = df.where("vec_id < 3")
    assert lloyd_rows(centroids.lloyd(few, config)) == plain_lloyd([r for r in exact if r[0] < 3], config)


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-100, 100, (300, 4)), np.zeros((40, 4), np.int64)])
    t = centroids.cover_tree(x)
    assert sorted(t.order) == list(range(len(x)))
    for i in range(len(t.center)):
        far = np.sqrt(((x[t.order[t.low[i] : t.high[i]]] - x[t.center[i]]) ** 2).sum(axis=1))
        assert far.max() <= t.radius[i] + 1e-9
        kids = np.arange(t.first[i], t.first[i] + t.children[i])
        assert (t.children[i] == 0) == (far.max() == 0)
        if len(kids):
            assert t.low[kids].min() == t.low[i] and t.high[kids].max() == t.high[i] and (t.radius[kids] <= t.radius[i] / 2 + 1e-9).all()
            c = x[t.center[kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.eye(len(kids)) * 1e9
            assert apart.min() > t.radius[i] / 2 - 1e-9
    packed = centroids.CoverTree.unpack(t.pack(), len(x))
    assert all((getattr(packed, f) == getattr(t, f)).all() for f in t.__dataclass_fields__)


def test_dual_tree_prunes_and_is_exact():
    rng = np.random.default_rng(9)
    middles = rng.integers(-20_000, 20_000, (30, 6))
    x = (middles[rng.integers(0, 30, 2000)] + rng.integers(-60, 60, (2000, 6))).astype(np.int64)
    c = np.concatenate([middles, middles[:3]]).astype(np.int64)
    for at_once in (64, 1 << 15):
        cluster, distance, work = centroids.nearest(x, centroids.cover_tree(x), c, centroids.cover_tree(c), at_once)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert work < every.size / 3


def plain_kernel(s, t):
    """Subsequences of four symbols within ``SPREAD``, word ends included."""

    def found(w):
        w, out = f"^{w}^", Counter()
        for i in range(len(w)):
            for l in range(i + 3, min(len(w), i + toxicity.SPREAD)):
                for j in range(i + 1, l - 1):
                    for k in range(j + 1, l):
                        out[w[i], w[j], w[k], w[l]] += toxicity.DECAY ** (l - i + 1)
        return out

    a, b = found(s), found(t)
    return sum(v * b[u] for u, v in a.items())


def test_kernel_is_the_sum_over_common_subsequences():
    words = ["idiot", "idxiot", "idioms", "stupid", "aaaaaa", "it"]
    got = toxicity.kernel(words, words[:5])
    assert np.allclose(got, [[plain_kernel(a, b) for b in words[:5]] for a in words])
    assert got[1, 0] > got[2, 0] > got[3, 0]


def test_words_of_texts():
    seen = toxicity.symbols(["You I-D.iot!", "an i d i o t", "", "5 % 7", "x" * 70])
    found = [("".join(map(chr, seen.points[a:b])).strip("\0"), int(t)) for a, b, t in zip(seen.start, seen.end, seen.text)]
    assert found == [("you", 0), ("idiot", 0), ("an", 1), ("idiot", 1), ("x" * 31, 4), ("x" * 32, 4), ("x" * 32, 4), ("x" * 23, 4)]


def test_table_gives_the_decision_of_the_machine():
    words = ["idiot", "stupid", "moron", "table", "lamp", "window"]
    table_, bias = toxicity.fit_words(words, np.array([1, 1, 1, -1, -1, -1.0]), np.ones(6))
    best, word = toxicity.highest([f"a {w} b" for w in words] + ["", "?"], table_, bias)
    assert (best[:3] > 0).all() and (best[3:6] < 0).all() and word[:3] == words[:3] and list(best[6:]) == [toxicity.SILENT] * 2
    longer, _ = toxicity.highest(["lamp " * 100_000 + "idiot " + "lamp " * 100_000], table_, bias)
    assert longer[0] == best[0]


def test_toxicity_on_held_out(spark):
    sf = f"{DATA}/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = registry.op13_subsequence_svm(spark, sf)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.93
    model = toxicity.learn(docs, labels)
    plain = [r.word for r in scored.where("score > 0.9").select("word").distinct().collect() if r.word.isascii() and len(r.word) > 4]
    clean = "the lamp stood on the table and nothing else "
    gapped = [clean + "-".join(w) for w in plain] + [clean + " ".join(w) for w in plain]
    best, _ = toxicity.highest([clean, *gapped], model.table, model.bias)
    p = model.probability(best)
    assert p[0] < 0.2 and (p[1:] >= 0.5).mean() > 0.9


def test_toxicity_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "you moron"), (2, "dear friend"), (None, None), (4, ""), (4, "you moron"), (1, "you moron")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {model.flat}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.learn(docs.limit(0), labels.limit(0))).count() == 0
