"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, trained in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import first_by_digest, small_batches

#: Bounds of the training sample: toxic and clean documents, and characters of one (longer ones aren't drawn).
TRAIN_DOCS, TRAIN_CHARS = (800, 2000), 10_000
#: Words of a window, and words from one window's start to the next one's.
WIDTH, STEP = 32, 24
#: Rows of the hashed tables, numbers in a row, hidden units of a direction, units of the attention.
WORD_ROWS, CHAR_ROWS, EMBED, HIDDEN, ATTEND = 1 << 14, 1 << 15, 8, 8, 8
#: Lengths of the character n-grams of a word (with its bounds marked).
GRAMS = (3, 5)
#: Steps of training, about, for a small sample.
STEPS = 450
#: Words whose input is kept ready in a task, at most.
_READY = 150_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows; character rows of all words, one word's after the other's; number of them by word."""
    words = [w.strip(_EDGES) for w in words]
    rows = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_ROWS
    marked = [b"^" + w + b"$" for w in words]
    flat = np.frombuffer(b"".join(marked) + bytes(8), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    grams, owner = [], []
    for n in GRAMS:
        h = np.zeros(len(flat) - n, np.int64)
        for j in range(n):
            h = h * 1_000_003 + flat[j : len(flat) - n + j] & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        count = np.maximum(0, size - n + 1)
        ramp = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        grams.append((h[np.repeat(start, count) + ramp] >> 7) % CHAR_ROWS)
        owner.append(np.repeat(np.arange(len(words)), count))
    owner = np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return rows, np.concatenate(grams)[by], np.bincount(owner, minlength=len(words))


def windows(n: int, width: int = WIDTH, step: int = STEP) -> np.ndarray:
    """Starts of the windows of n words: overlapping, all words covered, the last one ending with the text."""
    if n <= width:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - width, step)
    return np.append(starts, n - width)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row, n rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    by = np.argsort(rows, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(rows[by]) != 0))
    out[rows[by][at]] = np.add.reduceat(values[by], at)
    return out


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.p:
            return
        r = np.random.default_rng(self.seed)
        H, D = HIDDEN, 2 * EMBED
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "words": np.zeros((WORD_ROWS, EMBED), np.float32), "chars": np.zeros((CHAR_ROWS, EMBED), np.float32),  # what training hasn't seen adds nothing
            "in": draw(D, 6 * H, scale=D**-0.5), "bias": np.zeros(6 * H, np.float32), "uf": draw(H, 3 * H, scale=H**-0.5), "ub": draw(H, 3 * H, scale=H**-0.5),
            "att": draw(2 * H, ATTEND, scale=(2 * H) ** -0.5), "att_b": np.zeros(ATTEND, np.float32), "att_v": draw(ATTEND, scale=1.0),
            "out": draw(2 * H, scale=(2 * H) ** -0.5), "out_b": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes]):
        rows, grams, count = features(words)
        x = np.zeros((len(words), 2 * EMBED), np.float32)
        x[:, :EMBED] = self.p["words"][rows]
        has = np.flatnonzero(count)
        if len(has):
            x[has, EMBED:] = np.add.reduceat(self.p["chars"][grams], (np.cumsum(count) - count)[has]) / np.sqrt(count[has])[:, None]
        return x, rows, grams, count

    def project(self, words: list[bytes]) -> np.ndarray:
        """A word's input to the gates of both directions; all that recurs is left out."""
        if not words:
            return np.zeros((0, 6 * HIDDEN), np.float32)
        return (self.inputs(words)[0] @ self.p["in"] + self.p["bias"]).astype(np.float32)

    def forward(self, table: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows: ids (windows, width) into table, size: words in each. keep: what backward() needs, too."""
        H, (N, T) = HIDDEN, ids.shape
        mask = np.arange(T)[:, None] < size
        hidden = np.empty((T, N, 2 * H), np.float32)
        saved = []
        for d, u in enumerate((self.p["uf"], self.p["ub"])):
            h = np.zeros((N, H), np.float32)
            for t in range(T) if d == 0 else range(T - 1, -1, -1):
                x = table[ids[:, t], 3 * H * d : 3 * H * (d + 1)]
                g = h @ u
                zr = _sigmoid(x[:, : 2 * H] + g[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                n = np.tanh(x[:, 2 * H :] + r * g[:, 2 * H :])
                new = n + z * (h - n)
                if d:
                    new *= mask[t][:, None]
                if keep:
                    saved.append((d, t, h, z, r, n, g[:, 2 * H :]))
                h = new
                hidden[t, :, H * d : H * (d + 1)] = h
        a = np.tanh(hidden @ self.p["att"] + self.p["att_b"])
        e = np.where(mask, a @ self.p["att_v"], -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tn,tnk->nk", e, hidden)
        logit = pooled @ self.p["out"] + self.p["out_b"]
        return (logit, (mask, hidden, saved, a, e, pooled)) if keep else logit

    def gradient(self, words: list[bytes], ids: np.ndarray, size: np.ndarray, label: np.ndarray):
        """Gradients of the mean log loss; tables' as (rows, gradient)."""
        H, (N, T) = HIDDEN, ids.shape
        x, rows, grams, count = self.inputs(words)
        table = (x @ self.p["in"] + self.p["bias"]).astype(np.float32)
        logit, (mask, hidden, saved, a, e, pooled) = self.forward(table, ids, size, keep=True)
        g: dict = {}
        d_logit = ((_sigmoid(logit) - label) / N).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_hidden = e[:, :, None] * d_pooled
        d_e = np.einsum("nk,tnk->tn", d_pooled, hidden)
        d_score = e * (d_e - (e * d_e).sum(0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, a)
        d_a = d_score[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tnk,tna->ka", hidden, d_a), d_a.sum((0, 1))
        d_hidden += d_a @ self.p["att"].T
        d_gates = np.empty((N, T, 6 * H), np.float32)
        g["uf"], g["ub"] = np.zeros_like(self.p["uf"]), np.zeros_like(self.p["ub"])
        carry = [np.zeros((N, H), np.float32), np.zeros((N, H), np.float32)]
        for d, t, h, z, r, n, gn in reversed(saved):
            u, name = (self.p["uf"], "uf") if d == 0 else (self.p["ub"], "ub")
            dh = carry[d] + d_hidden[t, :, H * d : H * (d + 1)]
            if d:
                dh = dh * mask[t][:, None]
            d_n = dh * (1 - z) * (1 - n * n)
            d_z = dh * (h - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            gates = np.concatenate([d_z, d_r, d_n], 1)
            back = np.concatenate([d_z, d_r, d_n * r], 1)
            g[name] += h.T @ back
            carry[d] = dh * z + back @ u.T
            d_gates[:, t, 3 * H * d : 3 * H * (d + 1)] = gates
        d_table = _sums(ids.ravel(), d_gates.reshape(N * T, 6 * H), len(table))
        g["in"], g["bias"] = x.T @ d_table, d_table.sum(0)
        d_x = d_table @ self.p["in"].T
        g["words"] = (rows, d_x[:, :EMBED])
        each = d_x[:, EMBED:] / np.sqrt(np.maximum(count, 1))[:, None]
        g["chars"] = (grams, np.repeat(each, count, axis=0))
        return g

    def score_texts(self, texts: list[str | None], cache: dict) -> np.ndarray:
        """The largest probability of a text's windows; 0 for a text without words. cache: kept between calls, bounded."""
        if len(cache.get("words", ())) > _READY:
            cache.clear()
        words = cache.setdefault("words", _Places())
        known = len(words)
        ids, counts = [], []
        for t in texts:
            w = tokens(t)
            counts.append(len(w))
            ids.append(np.fromiter(map(words.__getitem__, w), np.int64, len(w)))
        fresh = list(words)[known:]
        table = cache.get("table", np.zeros((0, 6 * HIDDEN), np.float32))
        if fresh:
            table = cache["table"] = np.concatenate([table, *(self.project(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000))])
        flat = np.concatenate([*ids, np.zeros(WIDTH, np.int64)]) if ids else np.zeros(WIDTH, np.int64)
        offset = np.cumsum([0, *counts])
        starts = [windows(n) for n in counts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)
        size = np.minimum(np.array(counts, np.int64)[owner] - at, WIDTH)
        at = at + offset[owner]
        best = np.zeros(len(texts))
        np.maximum.at(best, owner, _sigmoid(self.logits(table, flat, at, size).astype(np.float64)))
        return best

    def logits(self, table: np.ndarray, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the windows that begin at the ascending places in flat (rows of table), block by block."""
        out = [np.zeros(0, np.float32)]
        for lo in range(0, len(at), 1024):
            own = at[lo : lo + 1024]
            near = table[flat[own[0] : own[-1] + WIDTH]]  # neighbours share words, so their inputs are fetched once
            out.append(self.forward(near, own[:, None] - own[0] + np.arange(WIDTH), size[lo : lo + 1024]))
        return np.concatenate(out)


def train(texts: list[str], toxic: list[int], epochs: int | None = None, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Multiple-instance learning: a text is toxic if a window is. First random windows stand for their texts, then the highest-scored one
    (and a random one of each clean text). A small sample is gone over more often, for about STEPS steps in all. None if the labels are all alike."""
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, r = Network(seed), np.random.default_rng(seed)
    vocabulary = _Places()
    docs = [np.array([vocabulary[x] for x in tokens(t)], np.int64) for t in texts]
    words = list(vocabulary)
    has = [i for i, d in enumerate(docs) if len(d)]
    starts = {i: windows(len(docs[i])) for i in has}
    owner = np.repeat(has, [len(starts[i]) for i in has])
    every = np.concatenate([starts[i] for i in has])
    flat = np.concatenate([*docs, np.zeros(WIDTH, np.int64)])
    offset = np.cumsum([0, *map(len, docs)])
    size = np.minimum(np.array([len(d) for d in docs])[owner] - every, WIDTH)
    at = every + offset[owner]
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    number = np.diff(np.append(first, len(owner)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    epochs = epochs or min(60, max(11, STEPS * batch // (2 * len(first))))
    warm = max(1, 3 * epochs // 11)
    for epoch in range(epochs):
        random = first + (r.random(len(first)) * number).astype(np.int64)
        if epoch < warm:
            chosen = np.concatenate([random, first + (r.random(len(first)) * number).astype(np.int64)])
        else:
            if epoch == warm or epoch % 2:  # choose anew every other time
                table = np.concatenate([net.project(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
                logit = net.logits(table, flat, at, size)
                top = np.array([f + int(np.argmax(logit[f : f + n])) for f, n in zip(first, number)])
            chosen = np.concatenate([top, random[y[owner[random]] == 0]])
        r.shuffle(chosen)
        for lo in range(0, len(chosen), batch):
            own = chosen[lo : lo + batch]
            ids = flat[at[own, None] + np.arange(WIDTH)]
            used, local = np.unique(ids, return_inverse=True)
            g = net.gradient([words[i] for i in used], local.reshape(ids.shape), size[own], y[owner[own]])
            step += 1
            now = rate * (0.5 if epoch >= epochs - 3 else 1.0) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in g.items():
                m, v = moments[k]
                if isinstance(d, tuple):  # only the rows that the batch uses move
                    rows, inverse = np.unique(d[0], return_inverse=True)
                    total = _sums(inverse, d[1], len(rows))
                    m[rows] = 0.9 * m[rows] + 0.1 * total
                    v[rows] = 0.999 * v[rows] + 0.001 * total * total
                    net.p[k][rows] -= now * m[rows] / (np.sqrt(v[rows]) + 1e-8)
                else:
                    m[:] = 0.9 * m + 0.1 * d
                    v[:] = 0.999 * v + 0.001 * d * d
                    net.p[k] -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_docs: tuple[int, int] = TRAIN_DOCS, max_chars: int = TRAIN_CHARS, **how) -> Network | None:
    """A network from documents with a label: at most max_docs toxic and clean ones, drawn by a digest of doc_id among those of max_chars or less.

    Labels choose first, so that only the chosen rows of documents move. A doc_id with both labels counts as toxic. Rows without
    identifier, text or label are left out; empty tables, or labels that are all alike, give None. Columns besides those named are ignored.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.char_length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = first_by_digest(known.join(short, "doc_id", "left_semi"), "toxic", "doc_id", F.when(F.col("toxic") == 1, max_docs[0]).otherwise(max_docs[1]))
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= max_chars).join(F.broadcast(picked), "doc_id").toArrow()
    got = sorted(set(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("toxic").to_pylist())))
    return train([t for _, t, _ in got], [k for _, _, k in got], **how)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score of every whole text: the largest probability over its overlapping windows; 0 for texts without words (null ones too) or without
    a network. One row for each input row, repeated rows and null identifiers included; no rows for an empty table; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net.p if net else None)

    def run(batches):
        model, cache = Network(p=shared.value) if shared.value else None, {}
        for b in batches:
            texts = b.column("text").to_pylist()
            found, part, chars = [], [], 0
            for t in [*texts, None]:
                part.append(t)
                chars += len(t or "")
                if chars > 2_000_000 or len(found) + len(part) > len(texts):
                    found += (model.score_texts(part, cache) if model else np.zeros(len(part))).tolist()
                    part, chars = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found[: len(texts)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
