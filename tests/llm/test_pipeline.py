"""The pipeline's stages keep the columns and take effect."""

from corpus_pipeline import STAGES, run
from tests.conftest import DATA


def test_pipeline(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    columns = docs.columns
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < docs.count() <= n
        n = docs.count()
        assert i + 1 == len(STAGES) or docs.columns == columns
    assert sorted(map(tuple, run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def plain_pipeline(docs, labels, items, learned):
    """(doc_id, text, source) that the first four stages leave, in plain Python; ``learned`` scores a text."""
    from tests.llm import brute

    docs = [(d, t, s) for d, t, s in docs if learned(t) >= 0.7]
    gone, _ = brute.repeated_lines([(d, t) for d, t, _ in docs])
    out = []
    for d, t, s in docs:
        left = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone.get(d, ()))
        if d not in gone or left.strip():
            out.append((d, left, s))
    kept = brute.near_duplicates([(d, t) for d, t, _ in out], 5)
    docs, out = [x for x in out if kept[x[0]][2]], []
    for d, t, s in docs:
        words = list(brute.WORD.finditer(brute.lower(t)))
        hit = set()
        for _, item in items:
            w = brute.WORD.findall(brute.lower(item))
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else ()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(m[0] for m in words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if len(hit) > 0.5 * len(words):
            continue
        for i in sorted(hit, reverse=True):  # words go, and what stands between two that go
            end = words[i].end() if i + 1 not in hit else words[i + 1].start()
            t = t[: words[i].start()] + t[end:]
        out.append((d, t, s))
    return out


def test_stages_are_their_plain_forms(spark, tmp_path):
    import random
    import zlib

    from corpusloom.llm import mixing, quality

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(14)) for i in range(3)]
    texts = ["\n".join(say(rng.randint(8, 20)) for _ in range(4)) for _ in range(40)]
    line = texts[0].split("\n")[1]
    texts[5] += f"\n{line}"  # a line said before
    texts[6] += "\n" + " ".join([*line.split()[:-1], "other"])  # nearly
    long = say(120)
    texts += [long, " ".join([*long.split()[:-2], say(2)]), f"{say(30)} {items[0][1]}, {say(30)}", items[1][1], texts[3]]
    texts += ["!!! ### $$$ %%% " * rng.randint(5, 30) for _ in range(15)]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int("!!!" not in t), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = quality.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert any(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts)))
    want = plain_pipeline([(d, t, s) for d, t, _, s, _ in docs], labels, items, lambda t: float(model.score(quality.features(t.encode())[None, :])[0]))

    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
    assert sorted((r.doc_id, r.text, r.source) for r in left.collect()) == sorted(want)
    ids = {d for d, _, _ in want}
    assert not any("!!!" in t for _, t, _ in want) and {40} <= ids and 41 not in ids and 43 not in ids and 42 in ids and len(ids) >= 38
    mixed = {r.doc_id: r for r in run(spark, str(tmp_path)).collect()}
    sizes = {d: len(t.split()) for d, t, _ in want}
    assert {d: r.size for d, r in mixed.items()} == sizes
    by = {s: sum(sizes[d] for d, _, x in want if x == s) for s in ("src0", "src1", "src2")}
    targets = mixing.water_fill(__import__("numpy").array(list(by.values())), __import__("numpy").array([3.0, 1.0, 2.0]), 1.5 * sum(by.values()), 2)
    for (s, size), target in zip(by.items(), targets, strict=True):
        rows = [mixed[d] for d, _, x in want if x == s]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 and r.taken <= 2 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= 2 * mixing.BLOCK_WORDS
