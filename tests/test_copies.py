"""Copies that are not equal bytes, and a model's weights."""

import os

import numpy as np
import pytest

from storymetrics.operators import frames, weights
from storymetrics.sources import media
from tests.test_reference import picture, png


def scene(r, h=90, w=120):
    """A smooth random picture: a sum of waves."""
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    waves = sum(a * np.sin(2 * np.pi * (f * x + g * y) + p) for a, f, g, p in r.normal(size=(12, 4)) * [1, 3, 3, 3])
    return np.repeat(((waves - waves.min()) / np.ptp(waves) * 255)[..., None], 3, 2)


def test_resized_and_recompressed_copies_share_their_fingerprints(spark):
    r = np.random.default_rng(8)
    scenes = [scene(r) for _ in range(60)]
    rows, truth = [], {}
    for i, s in enumerate(scenes):
        noisy = np.clip(s + r.normal(0, 6, s.shape), 0, 255)  # what strong compression does to smooth places
        small = frames.resized(s, 64)
        for k, p in enumerate((s, noisy, small, np.clip(s * 1.2 - 10, 0, 255))):
            n = len(rows)
            rows.append((i % 3, n, frames.fingerprint(p.astype(np.uint8))))
            truth[n] = n - k
    rows += [(0, 1000, None), (0, 1001, None)]
    got = {x["n"]: x for x in frames.near_copies(spark.createDataFrame(rows, "batch_id int, n int, fingerprint long"), ["batch_id"], "n").collect()}
    found = sum(got[n]["duplicate_of_frame"] == of for n, of in truth.items() if n != of)
    assert found >= 0.95 * 3 * len(scenes) and sum(got[n]["is_duplicate"] for n, of in truth.items() if n == of) <= 1
    assert not got[1000]["is_duplicate"] and not got[1001]["is_duplicate"]


def test_near_copies_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.integers(-(2**63), 2**63 - 1, 40)
    rows = []
    for i in range(400):
        flips = r.choice(64, int(r.integers(0, 11)), replace=False)
        bits = int(base[int(r.integers(40))]) & (2**64 - 1)
        for f in flips:
            bits ^= 1 << int(f)
        rows.append((int(r.integers(4)) or None, i, bits - 2**64 if bits >= 2**63 else bits))
    got = {x["n"]: x["duplicate_of_frame"] for x in frames.near_copies(spark.createDataFrame(rows, "scope int, n int, fingerprint long"), ["scope"], "n").collect()}
    for s, n, b in rows:
        first = {}
        for s2, n2, b2 in rows:
            if s2 == s:
                first[b2] = min(first.get(b2, n2), n2)
        near = [m for b2, m in first.items() if ((b ^ b2) & (2**64 - 1)).bit_count() <= 7 and m <= first[b]]
        assert got[n] == (min(near) if min(near) < n else None)
    with pytest.raises(ValueError, match="within 7 bits"):
        frames.near_copies(spark.createDataFrame(rows, "scope int, n int, fingerprint long"), ["scope"], "n", most=8)


def test_what_the_provider_says_wins(spark):
    rows = [("b", 0, 5, None, None), ("b", 1, 5, False, None), ("b", 2, 5, None, None), ("b", 3, -1, True, 1)]
    frame = spark.createDataFrame(rows, "batch string, n int, fingerprint long, is_duplicate boolean, duplicate_of_frame int")
    assert sorted(tuple(r)[3:] for r in frames.told_or_near(frame, ["batch"], "n").orderBy("n").collect()) == sorted([(False, None), (False, None), (True, 0), (True, 1)])


def test_weights_are_loaded_once_in_a_process(spark, tmp_path):
    r = np.random.default_rng(1)
    path = f"file://{tmp_path}/model.npz"
    weights.save(path, r.normal(size=(5, 5, 3, 4)) / 10, np.zeros(4), r.normal(size=4), 0.1, "v7")
    for i in range(40):
        (tmp_path / f"p{i}.png").write_bytes(png(picture("sharp" if i % 2 else "dark")))
    log = str(tmp_path / "loads")

    def opener(path):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return weights.opened(path)

    images = media.images(spark, f"{tmp_path}/*.png").repartition(20)
    got = frames.score(images, weights.Weights(path, opener)).collect()
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= 8
    assert len(got) == 40 and {x["model"] for x in got} == {"v7"} and all(0 < x["confidence"] < 1 for x in got) and len({x["confidence"] for x in got}) == 2
    pixels = frames.prepared(np.full((30, 30, 3), 100, np.uint8))
    held = weights.Weights(path).model()
    slow = [max(0.0, float((pixels[y : y + 5, x : x + 5] * held["kernel"][..., k]).sum() + held["bias"][k])) for k in range(4) for y in range(0, 220, 4) for x in range(0, 220, 4)]
    mean = np.array(slow).reshape(4, -1).mean(1)
    assert weights.Weights(path)(pixels) == pytest.approx(1 / (1 + np.exp(-(mean @ held["dense"] + 0.1))))


def test_a_missing_model_scores_nothing(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(png(picture("sharp")))
    row = frames.score(media.images(spark, f"{tmp_path}/*.png"), weights.Weights(f"file://{tmp_path}/none.npz")).first()
    assert (row["confidence"], row["label"], row["model"]) == (None, None, None) and row["luminance"] is not None
