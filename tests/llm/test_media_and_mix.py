"""Audio features against direct forms, the mix against a plain version, and awkward tables."""

import hashlib

import numpy as np
import pytest

from corpusloom.llm import audio, langid, lines, mixing, neardup, quality, secrets
from tests.llm.test_operators import make, rows


def test_resampling_is_the_direct_sum():
    config = audio.AudioConfig()
    make_features = audio.Features(config)
    rng = np.random.default_rng(4)
    x = rng.normal(size=777).astype(np.float32)
    n = config.taps * config.up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 0.5 / max(config.up, config.down)
    h = 2 * cutoff * np.sinc(2 * cutoff * t) * np.hanning(n + 2)[1:-1] * config.up
    stuffed = np.zeros(len(x) * config.up + 2 * n)
    stuffed[n : n + len(x) * config.up : config.up] = x  # zeros between samples, then the filter, then every down-th
    full = np.convolve(stuffed, h)
    got = make_features.resample(x)
    want = [full[k * config.down + shift] for shift in [np.argmax([np.dot(full[s : s + len(got) * config.down : config.down][: len(got)], got) for s in range(3 * n)])] for k in range(len(got))]
    assert np.allclose(got, want, atol=1e-4)


def test_log_mel_is_the_discrete_transform():
    config = audio.AudioConfig()
    f = audio.Features(config)
    y = np.random.default_rng(5).normal(size=1000).astype(np.float32)
    got = f.log_mel(y)
    for frame in (0, 3, len(got) - 1):
        part = np.zeros(config.frame)
        piece = y[frame * config.hop : frame * config.hop + config.frame]
        part[: len(piece)] = piece
        part = part * np.hanning(config.frame)
        k = np.arange(config.fft // 2 + 1)[:, None]
        spectrum = (part[None, :] * np.exp(-2j * np.pi * k * np.arange(config.frame)[None, :] / config.fft)).sum(axis=1)
        assert np.allclose(got[frame], np.log(np.abs(spectrum) ** 2 @ f.mel + 1e-6), atol=1e-3)
    assert (f.mel.sum(axis=0) > 0).all() and len(f.log_mel(np.zeros(0, dtype=np.float32))) == 1


def test_segments_are_hysteresis():
    config = audio.AudioConfig()
    f = audio.Features(config)
    rng = np.random.default_rng(6)
    mel = (rng.normal(size=(400, 1)) * 0.3 + np.repeat(rng.integers(0, 2, 40), 10)[:, None] * 0.3).astype(np.float32).repeat(4, axis=1)
    energy = mel.mean(axis=1) * 10 / np.log(10)
    floor, want, begin = np.median(energy), [], None
    for i, e in enumerate([*energy, -1e9]):
        if e > floor + config.leave_db and begin is None:
            begin = i
        elif e <= floor + config.leave_db and begin is not None:
            if i - begin >= config.min_frames and (energy[begin:i] > floor + config.enter_db).any():
                want.append((begin, i))
            begin = None
    assert f.segments(mel) == want and want


def test_mix_takes_evenly_spaced_blocks(spark):
    block = mixing.BLOCK_WORDS
    texts = [" ".join(["w"] * (1 + i * 13 % 200)) for i in range(60)]
    docs = make(spark, texts)
    got = mixing.mix_sources(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    quota_of = mixing.sainte_lague(np.array([by[s][0].target for s in sorted(by, key=lambda s: (s is None, s))]), round(sum(by[s][0].target for s in by) / block))
    for quota, source in zip(quota_of.tolist(), sorted(by, key=lambda s: (s is None, s)), strict=True):
        held = sorted(by[source], key=lambda r: (hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest(), r.doc_id))
        owner = [i for i, r in enumerate(held) for _ in range(r.size)]  # the document of each word
        n = max(1, -(-len(owner) // block))
        start = int(hashlib.md5(f"{mixing.SEED}:{source or ''}:0".encode()).hexdigest()[:8], 16) % n
        quota = min(quota, n * mixing.CAP)
        taken = [0] * len(held)
        for j in range(n):
            times = quota // n + ((j + 1 + start) * (quota % n) // n - (j + start) * (quota % n) // n)
            for word in owner[j * block : (j + 1) * block]:
                taken[word] += times
        assert [r.taken for r in held] == taken


@pytest.mark.parametrize("run", [
    lambda d: audio.audio_columns(d), lambda d: secrets.scan_secrets(d), lambda d: secrets.redact(d.select("doc_id", "text")), lambda d: lines.drop_duplicate_lines(d),
    lambda d: neardup.drop_near_duplicates(d), lambda d: langid.identify(d, langid.learn(d)), lambda d: quality.keep_quality(d, quality.learn(d, d.selectExpr("doc_id", "1 AS quality"))),
])
def test_empty_tables(spark, run):
    assert run(make(spark, ["x"]).limit(0)).count() == 0


def test_quality_without_both_classes_and_with_repeats(spark):
    docs = make(spark, ["good text of some words", "!!! ### bad", None, ""] * 3)
    for labels in ("1 AS quality", "0 AS quality", "CAST(NULL AS INT) AS quality"):
        model = quality.learn(docs, docs.selectExpr("doc_id", labels))
        scores = {r.score for r in quality.score_quality(docs, model).collect()}
        assert len(scores) == 1 and all(0 <= s <= 1 for s in scores)
    twice = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    model = quality.learn(docs.unionByName(docs), twice.unionByName(twice))
    got = rows(quality.score_quality(docs, model), "score")
    assert got[1] == got[5] == got[9] and len(got) == 12
    assert quality.keep_quality(docs, model).columns == docs.columns
