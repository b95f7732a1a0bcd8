"""The operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import audio, decontaminate, hashing, langid, lines, mixing, neardup, quality, repeats, secrets, suffixes, tokencounts
from corpusloom.llm.neardup import NearDupConfig
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, n_tokens string"


def make(spark, texts, first=1):
    rows = [(first + i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    for i in range(12):
        w = texts[rng.randrange(n)].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
        texts.append(f"{rng.choice(words)} {passage} {rng.choice(words)}")
    return [*texts, None, "", "   \n\t ", "one two", "One  TWO", "ä" * 300, "x" * 900, "x" * 900, "Größe ÉTÉ " * 60, texts[0], texts[0]]


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    texts = corpus()
    got = rows(neardup.near_duplicates(make(spark, texts), NearDupConfig(words=words)), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(list(enumerate(texts, 1)), words)


def test_near_duplicates_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).where("doc_id IS NOT NULL").collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (5, 5, True)]
    assert neardup.near_duplicates(docs).where("doc_id IS NULL").first().kept
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in neardup.drop_near_duplicates(docs).collect()) == [0, 1, 5]


def test_odd_sketch_estimates_similarity():
    config = NearDupConfig()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for shared, near in ((950, True), (100, False)):
        other = np.concatenate([base[:shared], rng.integers(0, 1 << 63, 1000 - shared).astype(np.uint64)])
        a, b = (neardup.odd_sketch(neardup.min_hashes(x, config), config).view(np.uint64) for x in (base, other))
        assert (int(np.bitwise_count(a ^ b).sum()) <= config.most_bits) == near


def test_repeats(spark):
    texts = corpus()
    got = rows(repeats.find_repeats(make(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(enumerate(brute.repeats(texts), 1))


def test_repeats_in_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    texts = corpus(5)
    got = rows(repeats.find_repeats(make(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(enumerate(brute.repeats(texts), 1))
    assert repeats.find_repeats(make(spark, texts).limit(0)).count() == 0


def test_difference_cover():
    d = suffixes.COVER
    assert {(a - b) % suffixes.PERIOD for a in d for b in d} == set(range(suffixes.PERIOD))
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 1500).astype(np.uint8)
    data[700:1100] = data[100:500]
    data[1200:1480] = 97
    block = np.concatenate([data, np.zeros(suffixes.PADDING, dtype=np.uint8)])
    at = np.arange(len(data) - 200)
    kind = suffixes.classes(block, at, 200)
    seen = {}
    for i in at:
        assert seen.setdefault(data[i : i + 200].tobytes(), kind[i]) == kind[i]
    assert len(set(kind.tolist())) == len(seen)


def test_benchmark_hits(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (52, "Solo")]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(15)]
    texts += [f"{texts[i][:40]} {items[i][1].upper()} {texts[i][-40:]}" for i in range(12)] + [None, "", "solo!", "ÄÖ solo"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute.benchmark_hits(t, items) for i, t in enumerate(texts, 1)}
    assert decontaminate.n_blocks(bench, 1 << 20) == 1 and decontaminate.n_blocks(bench, 60) > 5
    for size in (1 << 20, 60):  # one block, several blocks
        found = decontaminate.scan_benchmark(make(spark, texts), bench, block_chars=size)
        assert {k: (a, b, list(c)) for k, (a, b, c) in rows(found, "n_words", "n_hit", "items").items()} == want
    got = rows(decontaminate.digest(decontaminate.scan_benchmark(make(spark, texts), bench)), "n_items", "items_sha256", "contaminated")
    assert got == {k: (len(n), hashlib.sha256(",".join(n).encode()).hexdigest(), h > 0) for k, (_, h, n) in want.items()}
    assert all(v[1] == 0 for v in rows(decontaminate.scan_benchmark(make(spark, texts), bench.limit(0)), "n_words", "n_hit").values())


def test_benchmark_items_without_id_and_repeated_items(spark):
    passage = " ".join(f"b{i}" for i in range(12))
    docs = make(spark, [f"x {passage} y", passage, "b0 b1"])
    bench = spark.createDataFrame([(None, passage), (7, passage), (7, passage), (7, "other words")], "item_id long, text string")
    for size in (1 << 20, 10):
        assert rows(decontaminate.scan_benchmark(docs, bench, block_chars=size), "n_hit", "items") == {1: (12, ["7"]), 2: (12, ["7"]), 3: (0, [])}
        unnamed = rows(decontaminate.scan_benchmark(docs, bench.where("item_id IS NULL"), block_chars=size), "n_hit", "items")
        assert unnamed == {1: (12, []), 2: (12, []), 3: (0, [])}


def test_decontaminate_cuts_passages(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string")
    clean = " ".join(f"c{i}" for i in range(50))
    docs = make(spark, [clean, f"{clean} {bench.first().text}.", bench.first().text, None])
    got = rows(decontaminate.decontaminate(docs, bench), "text", "n_chars")
    assert got == {1: (clean, len(clean)), 2: (f"{clean} .", len(clean) + 2), 4: (None, 0)}
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns


def test_secrets(spark):
    texts = ["password='hunter22!' token: abc secret=token:abcdef", 'API_KEY : "abc-DEF_123=="', "AKIA" + "Q7" * 8, "AKIAQ7", "xAKIA" + "A" * 30, "deadbeef" * 4 + " " + "0f" * 11, "é secret = abcdefgh", "secret:\nabcdefgh", None, "", "passwd=" + "a" * 5000, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "token==abcdef token=:abcdef secret:token: abcdefgh"]
    got = rows(secrets.digest(secrets.scan_secrets(make(spark, texts))), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, t in enumerate(texts, 1):
        want = brute.base_secrets(t)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i][:4] == (*[sum(k == n for k, _, _ in want) for n in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest()), t
    assert got[12][4].startswith("pem:0:") and got[13][4].startswith("github:0:")
    redacted = rows(secrets.redact(make(spark, texts)), "text")
    assert redacted[3][0] == "[secret]" and redacted[9][0] is None


def test_combined_automaton_is_minimal_and_agrees():
    scan = secrets.Scanner()
    rng = random.Random(9)
    texts = [("".join(rng.choice("ab0f9 :=\"tokenAKI\n") for _ in range(rng.randint(0, 3000)))).encode() for _ in range(200)]
    texts += [b"token" + b" " * 4000 + b"=abcdefg", b"f" * 5000]
    for few in (0, 64, 10**6):  # all segments together, the last ones alone, all alone
        scan.FEW = few
        for text, starts in zip(texts, scan.starts(texts), strict=True):
            got = [(secrets.RULES[k].name, s, e) for s, e, k in scan.spans(text, starts) if k < 3]
            assert got == brute.base_secrets(text.decode())
    n, width = scan.all.n_states, scan.all.n_classes
    part = scan.all.accept
    for _ in range(n):  # Moore's refinement separates all states
        part = np.unique(np.column_stack([part, part[scan.all.next.reshape(n, width)]]), axis=0, return_inverse=True)[1].reshape(-1)
    assert len(set(part.tolist())) == n


def test_secrets_in_texts_without_line_ends_take_linear_time():
    import time

    scan = secrets.Scanner()
    for text in (b"A" * 3_000_000, b"eyJ" * 500_000 + b".eyJ!", b"token " * 500_000, b"deadbeef" * 200_000, b"-----BEGIN " * 200_000):
        began = time.time()
        found = scan.spans(text, scan.starts([text])[0])
        assert time.time() - began < 8 and len(found) == int(text.startswith(b"dead"))


def test_audio_round_trip(spark):
    texts = ["", None, "a", "b" * 192, "c" * 193, "é" * 5000, "hello world " * 900, "hello world " * 900]
    got = {r["doc_id"]: r for r in audio.audio_columns(make(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        data = (t or "").encode()
        payload = audio.pad(data)
        r = got[i]
        assert len(payload) % 192 == 0 and (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert audio.decode_wav(bytes(r["media"])) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        tensors = audio.from_ipc(bytes(r["tensors"]))
        assert tensors.column(3).type.shape == [96, 32] and audio.summary(tensors, [(s["start_ms"], s["end_ms"]) for s in r["segments"]]) == r["feature"]
    assert got[7]["feature"] == got[8]["feature"]


def test_polyphase_resampling_matches_direct_filtering():
    make_features = audio.Features(audio.AudioConfig())
    t = np.arange(16000) / 16000
    low, high = (make_features.resample(np.sin(2 * np.pi * f * t).astype(np.float32))[200:-200] for f in (500, 6000))
    assert len(make_features.resample(t.astype(np.float32))) == 6400
    assert 0.6 < np.sqrt((low**2).mean()) < 0.8 and np.sqrt((high**2).mean()) < 0.05


def test_line_dedup(spark):
    base = " ".join(f"alpha{i}bravo" for i in range(40))
    near = base.replace("alpha7bravo", "changed")
    other = " ".join(f"zulu{i}kilo" for i in range(40))
    docs = make(spark, [f"{base}\nunique one here\n---", f"{other}\nUNIQUE, one here!\n---", None, "", base, "tail\ntail"])
    got = rows(lines.count_lines(docs), "n_lines", "n_dropped", "kept_sha256")
    assert {k: v[:2] for k, v in got.items()} == {1: (3, 0), 2: (3, 1), 3: (0, 0), 4: (0, 0), 5: (1, 1), 6: (2, 1)}
    assert got[2][2] == hashlib.sha256(f"{other}\n---".encode()).hexdigest()
    kept = rows(lines.drop_duplicate_lines(docs), "text", "n_chars")
    assert set(kept) == {1, 2, 3, 4, 6} and kept[6] == ("tail", 4)
    assert lines.count_lines(docs.limit(0)).count() == 0
    pair = spark.createDataFrame([(1, base), (2, near)], "doc_id long, text string")
    assert [(r.doc_id, r.dropped) for r in lines.duplicate_lines(pair).collect()] == [(2, [0])]  # one of 40 words differs


def test_word_level_edit_distance(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "x array<string>, y array<string>")
    assert df.select(F.levenshtein(lines.coded(F.col("x")), lines.coded(F.col("y")))).first()[0] == 2


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(5)
    for _ in range(50):
        votes = rng.integers(1, 1000, rng.integers(1, 12)).astype(float)
        seats = int(rng.integers(0, 200))
        want = np.zeros(len(votes), dtype=int)
        for _ in range(seats):
            want[np.argmax(votes / (2 * want + 1))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == want.tolist()


def test_mix(spark):
    texts = [" ".join(["w"] * (1 + i * 7 % 900)) for i in range(150)] + [None, "", " "]
    docs = make(spark, texts)
    got = mixing.mix_sources(docs, shard_words=5000).toPandas()
    again = mixing.mix_sources(docs.repartition(5), shard_words=5000).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all() and len(got) == len(texts)
    by = got.groupby(got.source.fillna("~"), sort=True).agg({"size": "sum", "source_size": "first", "target": "first", "taken": "sum"})
    assert (by["size"] == by.source_size).all() and ((by.taken - by.target).abs() <= 16 * 6 + 0.01 * by.target).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_water_fill():
    assert mixing.water_fill(np.array([10, 1000, 1000]), np.array([3.0, 1.0, 2.0]), 1200, 2).tolist() == [20, 1180 / 3, 1180 * 2 / 3]


def test_length_histogram(spark):
    texts = ["", None, "a", "hello world", "hello world", " " * 6000 + "x", "word " * 3000]
    table = tokencounts.token_length_table(spark, make(spark, texts)).toPandas().sort_values("n_tokens", ignore_index=True)
    lengths = [r.n_tokens for r in tokencounts.token_lengths(make(spark, texts)).collect()]
    assert lengths[:5] == [0, 0, 1, 2, 2] and table.n_docs.sum() == len(texts)
    for r in table.itertuples():
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths) and r.docs_over == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_over == sum(x for x in lengths if x > r.n_tokens) and r.total_tokens == sum(lengths)
    limits = spark.createDataFrame([(1,), (100,), (10**6,)], "context_limit long")
    for r in tokencounts.truncated_total(tokencounts.length_histogram(tokencounts.token_lengths(make(spark, texts))), limits).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths)


def test_quality_on_held_out(spark):
    from corpusloom.llm.registry import op4_pairwise_quality
    from tests.conftest import DATA

    scored = op4_pairwise_quality(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.93
    empty = quality.score_quality(make(spark, [None, ""]), quality.fit_ranking(np.zeros((0, quality.WIDTH)), np.zeros(0), 0.5))
    assert empty.where("score BETWEEN 0 AND 1").count() == 2


def test_language_on_held_out(spark):
    from corpusloom.llm.registry import op5_script_viterbi
    from tests.conftest import DATA

    got = op5_script_viterbi(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    model = langid.learn(make(spark, ["hello there world"] * 8))
    docs = make(spark, [None, "12 !", "hello", "\u201c \u2013 \U0001f600", "", "\u0301"])
    assert rows(langid.identify(docs, model), "lang_pred") == {1: ("und",), 2: ("und",), 3: ("en",), 4: ("und",), 5: ("und",), 6: ("und",)}
    nothing = langid.learn(make(spark, ["hello"]).limit(0))
    assert rows(langid.identify(docs, nothing), "lang_pred", "score", "spans")[3] == ("und", 0.0, [])
    assert langid.identify(docs.limit(0), model).count() == 0


MIXED = {
    "en": "the weather was fine and we went along the river with our friends until evening",
    "de": "das Wetter war schön und wir gingen mit unseren Freunden am Fluss entlang bis zum Abend",
    "ru": "погода была хорошая и мы гуляли вдоль реки с нашими друзьями до самого вечера",
    "el": "ο καιρός ήταν καλός και περπατήσαμε δίπλα στο ποτάμι με τους φίλους μας ως το βράδυ",
    "hi": "मौसम अच्छा था और हम अपने दोस्तों के साथ शाम तक नदी के किनारे चलते रहे",
    "th": "อากาศดีและเราเดินเลียบแม่น้ำกับเพื่อนของเราจนถึงเย็น",
}


def test_spans_of_mixed_languages_and_scripts(spark):
    learned = [(i, t, lang) for i, (lang, t) in enumerate([x for x in MIXED.items() for _ in range(8)])]
    model = langid.learn(spark.createDataFrame([(i, t, lang) for (i, (t, lang)) in enumerate([(t, lang) for _, t, lang in learned])], "doc_id long, text string, lang string"))
    assert model.langs == sorted(MIXED)
    names = [name for name, _ in langid.SCRIPT_RANGES]
    for lang, script in (("ru", "Cyrillic"), ("el", "Greek"), ("hi", "Devanagari"), ("th", "Thai")):
        used = model.scripts[names.index(script) + 1]
        assert [model.langs[i] for i in np.flatnonzero(used)] == [lang]  # the script leaves one candidate
    order = ["en", "ru", "de", "hi", "el", "th"]
    text = ". ".join(MIXED[lang] for lang in order)
    got = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in got.spans] == order
    first = 0
    for s, lang in zip(got.spans, order, strict=True):
        assert s.first_word == first and s.n_words == len(langid.split_words(MIXED[lang].encode()).start)
        first += s.n_words


def test_long_texts_are_scored_in_chunks(spark, monkeypatch):
    model = langid.learn(make(spark, list(MIXED.values()) * 4))
    words = langid.split_words((" ".join(MIXED.values()) * 30).encode())
    whole = model.scores(words)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 64)
    assert np.allclose(whole, model.scores(words), atol=1e-3)


def test_script_ranges_are_disjoint():
    taken = sorted((a, b) for _, ranges in langid.SCRIPT_RANGES for a, b in ranges)
    assert all(b < c for (_, b), (c, _) in zip(taken, taken[1:]))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(8)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) * 3 for n in (0, 1, 5, 6)]
    for s, labels in zip(scores, langid.viterbi(scores, 2.0), strict=True):
        if not len(s):
            continue
        value = lambda path: sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(value(p) for p in np.ndindex(*[3] * len(s)))
        assert abs(value(labels.tolist()) - best) < 1e-4


def test_word_hashes_follow_words():
    a, b = hashing.word_hashes(b"Foo  bar\tFOO\n"), hashing.word_hashes("foo bar foo é".encode())
    assert a.tolist() == b[:3].tolist() and a[0] == a[2] != a[1] and len(hashing.word_hashes(b"")) == 0
