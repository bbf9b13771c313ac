"""What operators 3 and 4 learn, against brute force."""

import math
import random

import numpy as np
import pytest

from graphloom.llm import language, urls
from graphloom.llm.common import flat


def brute_cutoff(rows):
    held = [(round(max(-20.0, min(20.0, s)) * 100), v) for s, fold, v in rows if fold == 0 and v]
    totals = {v: sum(x == v for _, x in held) for v in ("allow", "block")}
    if not all(totals.values()):
        return -math.inf
    best = None
    for step in sorted({s for s, _ in held}):
        below = [v for s, v in held if s < step]
        gain = below.count("block") / totals["block"] - below.count("allow") / totals["allow"]
        key = (-round(gain, 12), abs(step), step)
        best = min(best or key, key)
    return best[2] / 100 - 0.005


@pytest.mark.parametrize("seed", range(6))
def test_url_cutoffs(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice((-1, 1)) * r.randint(0, 2500) / 100 + (0.3 if seed % 2 else 0.0), r.randrange(3), r.choice(("allow", "block", None))) for _ in range(200)]
    rows = [(s + (1.0 if v == "allow" else -1.0), f, v) for s, f, v in rows]
    if seed == 5:
        rows = [(s, f, "allow") for s, f, _ in rows]
    assert urls.cutoff(spark.createDataFrame(rows, "score double, fold int, verdict string")) == brute_cutoff(rows)


def test_histograms_count_trigrams_of_one_text():
    r = random.Random(2)
    texts = ["", "ab", "abc", "Ab1 c.é", "ß ß", None] + ["".join(r.choice("abXY é1.\n") for _ in range(r.randint(0, 40))) for _ in range(40)]
    import pyarrow as pa

    raw, begins = flat(pa.array(texts))
    got = language.histograms(raw, begins)
    for row, text in zip(got, texts, strict=True):
        plain = [b | 32 if 97 <= b | 32 <= 122 and b < 128 else 32 if b < 128 else b for b in (text or "").encode()]
        counts = np.zeros(language.WIDTH)
        for a, b, c in zip(plain, plain[1:], plain[2:], strict=False):
            counts[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 11)] += 1
        want = np.sqrt(counts)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-6)


def test_machines_reach_the_least_loss():
    r = np.random.default_rng(4)
    x = r.normal(size=(120, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sign = np.where(x @ r.normal(size=6) + 0.3 * r.normal(size=120) > 0.2, 1, -1).astype(np.float32)
    ones = np.hstack([x, np.ones((120, 1))])
    share = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())

    def loss(w):
        return (share * np.maximum(0, 1 - sign * (ones @ w)) ** 2).sum() + 0.5e-4 * (w**2).sum()

    # plain descent for long, from several places
    least = math.inf
    for seed in range(3):
        w = np.random.default_rng(seed).normal(size=7)
        for _ in range(20_000):
            slack = np.maximum(0, 1 - sign * (ones @ w))
            w -= 0.2 * (1e-4 * w - 2 * ones.T @ (share * sign * slack))
        least = min(least, loss(w))
    assert loss(language.fit_machine(x, sign)) <= least + 1e-4
