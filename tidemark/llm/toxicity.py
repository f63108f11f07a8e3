"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are runs of letters, marks and digits of any script; those of more than ``PIECE`` characters, as in scripts that
don't part words, are read in overlapping pieces.  A word's input is the sum of learned vectors, by hash, for the whole
word and for all its character grams of three to five, its edges marked.  The network reads windows of ``WINDOW``
words, one at every ``STRIDE``-th word, so that windows overlap and cover the whole text; attention pools a window's states
into one logit, and the largest of all windows is the document's.  The score is the probability of label 1.

Learning sees at most ``PER_CLASS`` labelled rows of either class and texts of at most ``MAX_CHARS`` characters; the
driver holds those.  Words and grams that fewer than ``SUPPORT`` of these rows have are left out.  Vectors begin with the
log odds of what they stand for; the first third of the updates looks at the window of each row with the largest sum of
these, the others at the window with the largest logit.  Vectors are left out at random while it learns, and decay; rows of
label 0 also lose words as a whole, so that a text of unknown words is nothing toxic.
Scoring is a map over the rows, whole texts, in groups of windows of bounded size.

Defined results: null and empty texts, and texts without a word, have score 0; with one class to learn from,
every other score is that class, smoothed by one row, and with none it is 0; repeated rows get equal scores; an empty table gives an
empty table; other columns of the input are ignored, or carried along if :func:`score` is given them.
"""

from __future__ import annotations

import unicodedata
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, appended, labelled_sample
from .nets import Adam, class_weights, sigmoid

WINDOW = 32
STRIDE = 24
SLOTS = 1 << 16
INPUT = 8
HIDDEN = 10
PER_CLASS = 1_500
MAX_CHARS = 30_000
EPOCHS = 4
#: Updates at least, in samples so small that the epochs hold fewer.
UPDATES = 240
#: Learning rows with a word or gram that has a vector.
SUPPORT = 4
#: Share of vectors left out in an update, and how much of a vector an update takes away.
DROP, DECAY = 0.2, 1e-3
#: Characters of a word that are read as one, and the slots of such a word: itself and its grams.
PIECE = 16
GRAMS = (3, 4, 5)
WIDE = 1 + sum(PIECE + 3 - n for n in GRAMS)
#: Tokens remembered in a worker, their longest, and windows computed at once.
_MEMORY = 60_000
_LONG = 64
_GROUP = 2_048

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Tokens between ASCII separators, A-Z lower-cased; :func:`pieces` cuts them further."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def pieces(token: bytes) -> list[str]:
    """The words of a token, cut at what is no letter, mark or digit in any script, long ones in overlapping pieces."""
    text = token.decode().lower()
    if not text.isalnum():
        text = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text)
    out = []
    for w in text.split():
        out += [w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def slots(found: list[str]) -> np.ndarray:
    """Slots of words, a row each: first the whole, then its grams; ``SLOTS`` fills up."""
    out = np.full((len(found), WIDE), SLOTS, np.int32)
    out[:, 0] = [crc32(w.encode()) % SLOTS for w in found]
    codes = np.frombuffer("".join(f"<{w}>" for w in found).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in found])
    begin = np.cumsum(size) - size
    word, column = np.repeat(np.arange(len(found)), size), 1
    place = np.arange(len(codes)) - begin[word]
    for n in GRAMS:
        h = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
        for k in range(n):
            h = (h + codes[k : k + len(h)] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(place[: len(h)] + n <= size[word[: len(h)]])
        out[word[at], column + place[at]] = (h[at] >> np.uint64(8)) % np.uint64(SLOTS)
        column += PIECE + 3 - n
    return out


class Lexicon:
    """Numbers words as they come; gives their slots."""

    def __init__(self):
        self.new: list[str] = []
        self.number: dict[str, int] = {}
        lexicon = self

        class Tokens(dict):
            def __missing__(self, token: bytes) -> list[int]:
                found = [lexicon.of(w) for w in pieces(token)]
                if len(token) <= _LONG:
                    self[token] = found
                return found

        self.tokens = Tokens()

    def of(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.number)
            self.new.append(word)
        return n

    def read(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((n for found in map(self.tokens.__getitem__, tokens) for n in found), np.int64)

    def take_new(self) -> np.ndarray:
        rows = slots(self.new)
        self.new.clear()
        return rows


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of each window; texts have at least one word."""
    n = np.maximum(-(-(lengths - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return doc, start + np.repeat(np.cumsum(lengths) - lengths, n), np.minimum(lengths[doc] - start, WINDOW)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {"e": rng.normal(0, 0.1, (SLOTS + 1, INPUT)).astype(np.float32), "v": draw(2 * HIDDEN), "w": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": draw(INPUT, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

        self.p["e"][SLOTS] = 0
        #: Slots with a vector.
        self.known = np.ones(SLOTS + 1, bool)

    def used(self, rows: np.ndarray) -> np.ndarray:
        return np.where(self.known[rows], rows, SLOTS)

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Input to both directions' gates of words given by their slots, by direction and word."""
        x = self.p["e"][self.used(rows)].sum(axis=1)
        return np.stack([x @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"])

    def run(self, inputs, lengths: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States by place, window and direction, attention by place, and logits.  ``inputs(k, t)`` gives what direction k
        reads at place t."""
        n, deep, full = len(lengths), int(lengths.max()), int(lengths.min())
        states = np.empty((deep, n, 2 * HIDDEN), np.float32)
        for k, side in enumerate("fb"):
            u = self.p[f"h{side}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(deep) if side == "f" else range(deep - 1, -1, -1):
                x, g = inputs(k, t), h @ u
                zr = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = r * g[:, 2 * HIDDEN :]
                c += x[:, 2 * HIDDEN :]
                np.tanh(c, out=c)
                new = c - h
                new *= z
                new += h
                live = None if t < full else (t < lengths)[:, None]
                if live is not None:
                    new = np.where(live, new, h)
                if keep is not None:
                    keep.append((k, t, h, z, r, c, g[:, 2 * HIDDEN :], (t < lengths)[:, None]))
                h = new
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        a = states @ self.p["v"]
        a[np.arange(deep)[:, None] >= lengths] = -1e9
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        return states, a, (a * (states @ self.p["w"])).sum(axis=0) + self.p["b"]

    def gradients(self, rows: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss over windows; ``rows`` are slots by window and place."""
        p, keep = self.p, []
        x = p["e"][rows].sum(axis=2)
        gates = [[x[:, t] @ p[f"x{s}"] + p[f"c{s}"] for t in range(int(lengths.max()))] for s in "fb"]
        states, a, z_out = self.run(lambda k, t: gates[k][t], lengths, keep)
        states, a = states.swapaxes(0, 1), a.T
        d = ((sigmoid(z_out) - toxic) * weight / len(toxic)).astype(np.float32)
        pooled = np.einsum("ntd,nt->nd", states, a)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["b"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        da = np.einsum("ntd,nd->nt", states, dp)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("ntd,nt->d", states, ds)
        dstates = a[:, :, None] * dp[:, None, :] + ds[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        dh = {0: np.zeros((len(d), HIDDEN), np.float32), 1: np.zeros((len(d), HIDDEN), np.float32)}
        for k, t, h, z, r, c, gc, live in reversed(keep):
            side = "fb"[k]
            dnew = dh[k] + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
            on = np.where(live, dnew, 0)
            dc = on * z * (1 - c * c)
            dz = on * (c - h) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            dxin = np.concatenate([dz, dr, dc], axis=1)
            g[f"h{side}"] += h.T @ dg
            g[f"x{side}"] += x[:, t].T @ dxin
            g[f"c{side}"] += dxin.sum(axis=0)
            dx[:, t] += dxin @ p[f"x{side}"].T
            dh[k] = np.where(live, on * (1 - z), dnew) + dg @ p[f"h{side}"].T
        found = (rows < SLOTS) & (np.arange(rows.shape[1]) < lengths[:, None])[:, :, None]
        np.add.at(g["e"], rows[found], dx[np.nonzero(found)[:2]])
        g["e"][SLOTS] = 0
        return g


class Model:
    def __init__(self, network: Network | None, constant: float = 0.5):
        self.network, self.constant = network, constant
        self.forget()

    def forget(self) -> None:
        self.lexicon, self.table, self.filled = Lexicon(), np.zeros((2, 0, 3 * HIDDEN), np.float32), 0

    def __getstate__(self):
        return self.network, self.constant

    def __setstate__(self, state):
        self.__init__(*state)

    def _read(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Numbers of all words, whose gate inputs are then in the table."""
        if len(self.lexicon.number) > _MEMORY or len(self.lexicon.tokens) > 2 * _MEMORY:
            self.forget()
        numbers = [self.lexicon.read(d) for d in docs]
        new = self.lexicon.take_new()
        if len(new):
            need = self.filled + len(new)
            have = self.table.shape[1]
            if need > have:
                more = np.zeros((2, max(need, have + have // 2) - have, 3 * HIDDEN), np.float32)
                self.table = np.concatenate([self.table, more], axis=1)
            for s in range(0, len(new), 4096):
                part = new[s : s + 4096]
                self.table[:, self.filled + s : self.filled + s + len(part)] = self.network.project(part)
            self.filled = need
        return numbers

    def logits(self, docs: list[list[bytes]]) -> np.ndarray:
        """The largest window's, by document; minus infinity where a document has no word."""
        numbers = self._read(docs)
        out = np.full(len(docs), -np.inf)
        full = np.flatnonzero([len(n) > 0 for n in numbers])
        if not len(full):
            return out
        flat = np.concatenate(numbers)
        doc, start, length = windows(np.array([len(numbers[k]) for k in full]))
        for s in range(0, len(doc), _GROUP):
            begin, size = start[s : s + _GROUP], length[s : s + _GROUP]
            inputs = lambda k, t: self.table[k][flat[np.minimum(begin + t, len(flat) - 1)]]  # noqa: B023, E731  used at once
            np.maximum.at(out, full[doc[s : s + _GROUP]], self.network.run(inputs, size)[2])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [words(t) for t in texts]
        if self.network is None:
            return np.array([self.constant if any(map(pieces, d)) else 0.0 for d in docs])
        z = self.logits(docs)
        return np.where(z > -np.inf, sigmoid(z), 0.0)


def fit(texts: list[str], labels: list[int]) -> Model:
    lexicon, numbers, y = Lexicon(), [], []
    for t, label in zip(texts, labels):
        if len(n := lexicon.read(words(t))):
            numbers.append(n)
            y.append(float(label))
    y = np.array(y)
    if not len(y):
        return Model(None, 0.0)  # nothing says that anything is toxic
    if len(set(y.tolist())) < 2:
        return Model(None, (y.sum() + 0.5) / (len(y) + 1))
    rows, network = lexicon.take_new(), Network()
    adam, rng, weight = Adam(network.p, 0.01), np.random.default_rng(13), np.sqrt(class_weights(y))
    count = np.zeros((2, SLOTS + 1))
    for n, label in zip(numbers, y):
        count[int(label), np.unique(rows[np.unique(n)])] += 1
    of = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    share = (count + 0.5) / (of + 1)
    network.known = count.sum(axis=0) >= SUPPORT
    network.known[SLOTS] = False
    rows = network.used(rows)
    by_slot = np.where(network.known, np.clip(np.log(share[1] / share[0]), -1, 4), 0)
    network.p["e"] *= network.known[:, None]
    network.p["e"][:, 0] = by_slot / 4
    odds = by_slot[rows].sum(axis=1)
    rounds = max(EPOCHS, -(-UPDATES // -(-len(y) // 32)))

    def read(some: np.ndarray, early: bool = False):
        """Words and windows of some rows, and what the windows' choice goes by."""
        flat = np.concatenate([numbers[i] for i in some])
        doc, start, length = windows(np.array([len(numbers[i]) for i in some]))
        if early:
            upto = np.concatenate(([0.0], np.cumsum(odds[flat])))
            return flat, doc, start, length, upto[start + length] - upto[start]
        of, at = np.unique(flat, return_inverse=True)
        table = network.project(rows[of])
        inputs = lambda k, t: table[k][at[np.minimum(start + t, len(flat) - 1)]]
        return flat, doc, start, length, network.run(inputs, length)[2]

    for epoch in range(rounds):
        adam.rate = 0.01 * (1 - 0.9 * epoch / rounds)
        order = rng.permutation(len(y))
        for s in range(0, len(order), 32):
            some = order[s : s + 32]
            flat, doc, start, length, z = read(some, epoch < rounds / 3)
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            ends = np.append(first[1:], len(z))
            top = np.array([a + int(z[a:b].argmax()) for a, b in zip(first, ends)])
            at = np.minimum(start[top][:, None] + np.arange(int(length[top].max())), len(flat) - 1)
            read_rows = rows[flat[at]]
            read_rows[rng.random(read_rows.shape) < DROP] = SLOTS
            # Unknown words say nothing: in a quarter of the rows of label 0 a random share of all words becomes such.
            share = np.where((y[some] == 0) & (rng.random(len(some)) < 0.25), rng.random(len(some)), 0)
            read_rows[rng.random(at.shape) < share[:, None]] = SLOTS
            adam.update(network.gradients(read_rows, length[top], y[some], weight[some]))
            network.p["e"] *= 1 - DECAY
    return Model(network)


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", train, PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``; a column of that name in ``docs`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return appended(docs, text_col, name, lambda texts: held.value.scores(texts), lambda: alone("toxicity", held.value.forget))


def predicted(threshold: float = 0.3) -> Column:
    return (F.col("score") >= threshold).cast("int")
