"""op6: the network's scores by plain loops, word by word and unit by unit."""

import math
import random
import zlib

import numpy as np
import pytest

from pluvia.llm import toxicity as tox


def grams_of(word):
    marked = b"^" + word + b"$"
    for n in tox.GRAMS:
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * 1_000_003 + c) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            yield (h >> 7) % tox.CHAR_ROWS


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain(net, words):
    """Probability of one window."""
    p, hidden, width = {k: v.astype(float) for k, v in net.p.items()}, tox.HIDDEN, tox.EMBED
    inputs = []
    for word in words:
        bare = word.strip(tox._EDGES)
        x = [0.0] * (2 * width)
        for i in range(width):
            x[i] = p["words"][zlib.crc32(bare) % tox.WORD_ROWS][i]
        rows = list(grams_of(bare))
        for r in rows:
            for i in range(width):
                x[width + i] += p["chars"][r][i] / math.sqrt(len(rows))
        inputs.append([sum(x[i] * p["in"][i][j] for i in range(2 * width)) + p["bias"][j] for j in range(6 * hidden)])
    states = [[0.0] * (2 * hidden) for _ in words]
    for d, u in enumerate((p["uf"], p["ub"])):
        h = [0.0] * hidden
        for t in range(len(words)) if d == 0 else range(len(words) - 1, -1, -1):
            x = inputs[t][3 * hidden * d : 3 * hidden * (d + 1)]
            back = [sum(h[i] * u[i][j] for i in range(hidden)) for j in range(3 * hidden)]
            new = []
            for j in range(hidden):
                z, r = sigmoid(x[j] + back[j]), sigmoid(x[hidden + j] + back[hidden + j])
                n = math.tanh(x[2 * hidden + j] + r * back[2 * hidden + j])
                new.append((1 - z) * n + z * h[j])
            h = new
            states[t][hidden * d : hidden * (d + 1)] = h
    scores = []
    for s in states:
        a = [math.tanh(sum(s[i] * p["att"][i][j] for i in range(2 * hidden)) + p["att_b"][j]) for j in range(tox.ATTEND)]
        scores.append(sum(a[j] * p["att_v"][j] for j in range(tox.ATTEND)))
    parts = [math.exp(s - max(scores)) for s in scores]
    pooled = [sum(w * s[i] for w, s in zip(parts, states)) / sum(parts) for i in range(2 * hidden)]
    return sigmoid(sum(pooled[i] * p["out"][i] for i in range(2 * hidden)) + p["out_b"][0])


@pytest.mark.parametrize("n", [1, 5, tox.WIDTH, tox.WIDTH + 1, 100])
def test_scores_are_those_of_plain_loops(n):
    r, g = random.Random(n), np.random.default_rng(n)
    net = tox.Network(3)
    for k in ("words", "chars", "bias", "att_b", "out_b"):
        net.p[k] = (g.standard_normal(net.p[k].shape) * 0.7).astype(np.float32)
    text = " ".join(r.choice(["rain", "(falls)", "été", "x", "!!", "Gauge's", "storm-warning", "日本"]) for _ in range(n))
    words = text.encode().lower().split()
    starts = [0] if n <= tox.WIDTH else [*range(0, n - tox.WIDTH, tox.STEP), n - tox.WIDTH]
    want = max(plain(net, words[s : s + tox.WIDTH]) for s in starts)
    got = net.score_texts(["other words before it", text, None], {})
    assert abs(got[1] - want) < 1e-4 and got[2] == 0
