"""Ranking, language scores and token lengths against plain forms; many languages, vocabularies and repeated ids."""

import base64
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from corpusloom.llm import langid, quality, tokencounts
from corpusloom.session import table
from tests.conftest import DATA


def test_ranking_minimises_the_pairwise_loss():
    rng = np.random.default_rng(3)
    x = np.zeros((60, quality.WIDTH), dtype=np.float32)
    x[:, :6] = rng.normal(size=(60, 6))
    label = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=60) > 0).astype(int)
    model = quality.fit_ranking(x, label, 0.5, n_pairs=2000, steps=3000)
    z = np.clip((x - model.mean) / model.std, -6, 6).astype(np.float64)
    draw = np.random.default_rng(7)
    wins, losses = draw.choice(np.flatnonzero(label == 1), 2000), draw.choice(np.flatnonzero(label == 0), 2000)
    difference = z[wins] - z[losses]

    def loss(w):
        return np.log1p(np.exp(-(difference @ w))).mean() + 0.05 * (w @ w)

    w = np.zeros(quality.WIDTH)
    for _ in range(4000):  # plain gradient descent
        w -= 0.05 * (-(difference * (1 / (1 + np.exp(difference @ w)))[:, None]).mean(axis=0) + 0.1 * w)
    assert abs(loss(model.weights.astype(np.float64)) - loss(w)) < 1e-4
    assert np.abs(model.weights - w).max() < 1e-2


def test_ranking_learns_from_every_labelled_document(spark):
    """More documents of a class than the former sample of 3,000: the loss over all pairs has no slope, and the cut is the quantile of all scores."""
    rng = np.random.default_rng(11)
    n = 9000
    label = (rng.random(n) < 0.45).astype(int)
    words = np.where(rng.random((n, 12)) < 0.35 + 0.3 * label[:, None], rng.integers(0, 40, (n, 12)), rng.integers(40, 80, (n, 12)))
    texts = [" ".join(f"w{w}" for w in row) for row in words]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(label)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    used = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in range(n)])
    x, k = np.array([quality.features(t.encode()) for t in texts])[used], label[used]
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-3) and np.allclose(model.std, x.std(axis=0) + 0.01, atol=1e-3)
    z, raw = np.clip((x - model.mean) / model.std, -6, 6), model.raw(x)
    lost = 1 / (1 + np.exp(raw[k == 1][:, None] - raw[k == 0][None, :]))
    slope = 0.1 * model.weights - (lost.mean(axis=1) @ z[k == 1]) / (k == 1).sum() + (lost.mean(axis=0) @ z[k == 0]) / (k == 0).sum()
    assert np.abs(slope).max() < 3e-3
    order = np.sort(raw)
    assert abs(model.cut - order[(k == 0).sum() - 1 : (k == 0).sum() + 1].mean()) < 1e-9
    assert abs(model.scale * np.median(np.abs(raw - model.cut)) - 2) < 1e-9
    again = quality.learn(docs.repartition(7), labels)
    assert np.array_equal(again.weights, model.weights) and again.cut == model.cut


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(3, "bad bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    once = quality.learn(docs.distinct(), labels)
    many = quality.learn(docs, labels)
    assert np.array_equal(once.weights, many.weights) and once.cut == many.cut


def test_language_scores_are_sums_over_strings(spark):
    model = langid.learn(table(spark, f"{DATA}/sf0.001", "documents"))
    words = langid.split_words("The größte Événement, señor y the end".encode())
    got = model.scores(words)
    buckets = langid.grams(words.data)
    for i, (a, b) in enumerate(zip(words.start, words.end)):
        want = sum(model.table[order][buckets[order][at]].astype(float) for order in range(3) for at in range(int(a), int(b) + 1))
        usable = model.scripts[words.script[i]]
        want = want - 50 * (~usable if usable.any() else np.zeros(len(usable), dtype=bool))
        assert np.allclose(got[i], want, atol=1e-3)


def test_two_hundred_languages(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for i in range(200):
        own = ["".join(rng.choice(letters, 6)) for _ in range(12)]
        rows += [(1000 * i + j, " ".join(rng.choice(own, 40)), f"l{i:03d}") for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95 and len({r.lang_pred for r in found}) > 190


def plain_length(ranks, split, text):
    """Byte pairs merged one at a time, the pair of least rank first."""
    total = 0
    for piece in split.findall(text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        total += len(parts)
    return total


def test_token_lengths_are_plain_merges_for_two_vocabularies(spark, tmp_path):
    lines = open(tokencounts.VOCABULARY, "rb").read().splitlines()
    small = tmp_path / "bytes.tiktoken"
    kept = [line for line in lines if len(base64.b64decode(line.split()[0])) <= 2]
    small.write_bytes(b"\n".join(kept) + b"\n")
    texts = ["Hello, world!  It's 2024.", "größer", "", None, "a\n\n b   c", "x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    split = regex.compile(tokencounts.PATTERN)
    for path, held in ((tokencounts.VOCABULARY, lines), (str(small), kept), (tokencounts.VOCABULARY, lines)):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held)}
        got = [r.n_tokens for r in tokencounts.token_lengths(docs, path).collect()]
        assert got == [plain_length(ranks, split, t or "") for t in texts]


def test_histogram_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokencounts.token_length_table(spark, docs).count() == 0
    assert tokencounts.token_lengths(docs.union(spark.createDataFrame([(1, None)], "doc_id long, text string"))).agg(F.sum("n_tokens")).first()[0] == 0
