"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into blocks of ``BLOCK``; a chunk is two neighbouring blocks, so chunks overlap by half and
cover the whole document.  ``FILTERS`` learned filters of ``WIDTH`` bytes run over every place; each block keeps their
largest and mean responses.  A hidden layer gives each chunk a logit of being junk, the largest logit of all chunks is the document's, and the score is the
probability of label 1, ``sigmoid(-logit)``.

Learning sees at most ``PER_CLASS`` labelled rows of either class and texts of at most ``MAX_CHARS`` characters; the
driver holds those.  Scoring is a map over the rows, whole texts, in pieces of bounded size.

Defined results: null and empty texts have score 0; with one class or none to learn from, every other score is 0.5
(or that class, 0 or 1, smoothed by one row); repeated rows get equal scores; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, appended, labelled_sample
from .nets import Adam, class_weights, sigmoid

BLOCK = 128
WIDTH = 4
FILTERS = 16
HIDDEN = 16
PER_CLASS = 1_500
MAX_CHARS = 30_000
EPOCHS = 7
#: Updates at least, in samples so small that the epochs hold fewer.
UPDATES = 250
_PIECE = 1 << 20


class Bytes:
    """Documents as zero-padded blocks of bytes."""

    def __init__(self, docs: list[bytes]):
        sizes = np.array([-(-(len(d) + WIDTH) // BLOCK) for d in docs], np.int64)
        self.flat = np.frombuffer(b"".join(d.ljust(s * BLOCK, b"\0") for d, s in zip(docs, sizes.tolist())) + bytes(WIDTH), np.uint8)
        self.n = int(sizes.sum()) * BLOCK
        first = np.cumsum(sizes) - sizes
        chunks = np.maximum(sizes - 1, 1)
        self.doc_start = np.cumsum(chunks) - chunks  # first chunk of each document
        self.left = np.repeat(first, chunks) + np.arange(chunks.sum()) - np.repeat(self.doc_start, chunks)
        self.right = self.left + np.repeat(sizes > 1, chunks)
        self.last = first + sizes - 1  # last block of each document

    def read(self, chunk: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of a chunk, and the byte at each and those after it; past its document's end all is 0."""
        places = np.concatenate([np.arange(k * BLOCK, (k + 1) * BLOCK) for k in (self.left[chunk], self.right[chunk])])
        of = np.searchsorted(self.doc_start, chunk, side="right") - 1
        end = (self.last[of] + 1) * BLOCK
        return places, [np.where(places + k < end, self.flat[places + k], 0) for k in range(WIDTH)]


class Network:
    def __init__(self):
        rng = np.random.default_rng(3)
        self.p = {
            "taps": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "w1": rng.normal(0, 0.4, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.4, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def responses(self, flat: np.ndarray, n: int) -> np.ndarray:
        taps = self.p["taps"]
        out = taps[0][flat[:n]]
        for k in range(1, WIDTH):
            out += taps[k][flat[k : k + n]]
        return np.maximum(out, 0, out=out)

    def features(self, x: Bytes) -> np.ndarray:
        """By chunk: largest and mean response of each filter."""
        most, mean, nothing = [], [], self.responses(np.zeros(WIDTH, np.uint8), 1)
        for s in range(0, x.n, BLOCK * 256):
            m = min(BLOCK * 256, x.n - s)
            r = self.responses(x.flat[s:], m).reshape(-1, BLOCK, FILTERS)
            ends = x.last[np.searchsorted(x.last, s // BLOCK) : np.searchsorted(x.last, (s + m) // BLOCK)] - s // BLOCK
            r[ends, BLOCK - WIDTH + 1 :] = nothing  # there the next document's bytes would be read
            most.append(r.max(axis=1))
            mean.append(r.mean(axis=1))
        most, mean = np.concatenate(most), np.concatenate(mean)
        a, b = x.left, x.right
        return np.concatenate([np.maximum(most[a], most[b]), (mean[a] + mean[b]) / 2], axis=1)

    def chunk_logits(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(f @ self.p["w1"] + self.p["b1"], 0)
        return h @ self.p["w2"] + self.p["b2"], h

    def logits(self, x: Bytes) -> np.ndarray:
        return np.maximum.reduceat(self.chunk_logits(self.features(x))[0], x.doc_start)

    def gradients(self, x: Bytes, junk: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss; it flows through each document's largest chunk."""
        p = self.p
        f = self.features(x)
        z, h = self.chunk_logits(f)
        ends = np.append(x.doc_start[1:], len(z))
        at = np.array([s + int(z[s:e].argmax()) for s, e in zip(x.doc_start, ends)])
        dz = ((sigmoid(z[at]) - junk) * weight / len(junk)).astype(np.float32)
        dh = dz[:, None] * p["w2"] * (h[at] > 0)
        g = {"w2": h[at].T @ dz, "b2": dz.sum(keepdims=True), "w1": f[at].T @ dh, "b1": dh.sum(axis=0), "taps": np.zeros_like(p["taps"])}
        df = dh @ p["w1"].T
        for i, c in enumerate(at):
            places, read = x.read(c)
            r = sum(p["taps"][k][read[k]] for k in range(WIDTH))
            d = (r > 0) * (df[i, FILTERS : 2 * FILTERS] / len(places))
            top = r.argmax(axis=0)
            d[top, np.arange(FILTERS)] += df[i, :FILTERS] * (r[top, np.arange(FILTERS)] > 0)
            for k in range(WIDTH):
                np.add.at(g["taps"][k], read[k], d)
        return g


class Model:
    def __init__(self, network: Network | None, constant: float = 0.5):
        self.network, self.constant = network, constant

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        pieces = [(k, d[s : s + _PIECE + BLOCK]) for k, t in enumerate(texts) if t for d in (t.encode(),) for s in range(0, len(d), _PIECE)]
        if pieces and self.network is None:
            out[[k for k, _ in pieces]] = self.constant
        elif pieces:
            junk = np.full(len(texts), -np.inf)
            np.maximum.at(junk, [k for k, _ in pieces], self.network.logits(Bytes([d for _, d in pieces])))
            out = np.where(junk > -np.inf, sigmoid(-junk), 0.0)
        return out


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model(None, (y.sum() + 0.5) / (len(y) + 1))
    network, docs = Network(), [t.encode() for t in texts]
    adam, rng, weight = Adam(network.p, 0.01), np.random.default_rng(5), class_weights(y)
    rounds = max(EPOCHS, -(-UPDATES // -(-len(docs) // 32)))
    for epoch in range(rounds):
        order = rng.permutation(len(docs))
        adam.rate = 0.01 * (1 - 0.9 * epoch / rounds)
        for s in range(0, len(docs), 32):
            some = order[s : s + 32]
            adam.update(network.gradients(Bytes([docs[i] for i in some]), 1 - y[some], weight[some]))
    return Model(network)


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    return fit(*labelled_sample(docs, labels, "quality", train, PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``; a column of that name in ``docs`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return appended(docs, text_col, name, lambda texts: held.value.scores(texts), lambda: alone("quality"))


def predicted(threshold: float = 0.3) -> Column:
    return (F.col("score") >= threshold).cast("int")
