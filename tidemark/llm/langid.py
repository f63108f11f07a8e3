"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` a language.  Its symbols are the letters of all scripts, lower-cased, each its own, and one
for all else, whose runs count once.  Counts come from every training text.  Only the highest order is counted; a lower
order's counts are the numbers of different symbols seen before, as Kneser-Ney asks, and follow from it.

The models are stored together as sorted hash arrays, by order: 64-bit hashes of the grams that any language has, with their
log probability in each language, and hashes of the contexts with the log weight that falls to the order below.  A gram is
looked up by its hash's first bits and the few entries from there on.  A text's language is the one with the least
cross-entropy a symbol (ties: the first by name).  Texts whose least cross-entropy is above the limit calibrated on
training texts are marked ``rejected``; the limit is the 99.9th percentile of all training texts with a letter, rounded
up to the next ``1 / BINS`` nat, from a histogram.

What the models hold grows with the different grams of the input: some 50 bytes a gram on the driver while it builds them, and
8 bytes and 4 for each language in every worker.  Nothing is cut off.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, all are
``und``; rows with null language or text teach nothing; repeated rows are kept and count as often as they stand; an
empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

ORDER = 5
#: Bins of the histogram of cross-entropies to a nat, and the share of training texts that aren't rejected.
BINS = 1_000
KEPT = 0.999
#: Texts longer than this are scored in pieces, whose sums make up the text's.
_PIECE = 1 << 20
_SLICE = 2 << 20
#: Grams that a counting task holds, and cells of log probabilities that are looked up at once.
_HELD = 1 << 21
_CELLS = 1 << 19
_BASE = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = "lang string, gram string, n long"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: itself or its lower case, 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x33480):  # no letters are assigned beyond
        if unicodedata.category(chr(cp))[0] == "L":
            table[cp] = ord(chr(cp).lower()[0])
    return table


class Symbols:
    """The symbols of texts, and by text number where they belong."""

    def __init__(self, texts: list[str | None]):
        pieces = [(k, t[i : i + _PIECE]) for k, t in enumerate(texts) if t for i in range(0, len(t), _PIECE)]
        self.letters = np.zeros(len(texts), bool)
        self.of = np.zeros(0, np.int32)
        self.symbols, self.same = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if not pieces:
            return
        found = symbol_table()[np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)]
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for _, p in pieces])
        keep = found != 0
        keep[1:] |= (found[:-1] != 0) & (of[1:] == of[:-1])
        self.symbols, of = found[keep].astype(np.uint64), of[keep]
        #: 1 where the symbol before belongs to the same piece; others have nothing but 0 before them.
        self.same = np.concatenate(([0], of[1:] == of[:-1])).astype(np.uint64)
        self.of = np.array([k for k, _ in pieces], np.int32)[of]
        self.letters[np.unique(self.of[self.symbols > 0])] = True

    def hashes(self) -> list[np.ndarray]:
        """By order from 0 on, of the gram that ends at each symbol: a sum of powers."""
        out = [np.zeros(len(self.symbols), np.uint64)]
        for _ in range(ORDER):
            out.append(self.symbols + _BASE * self.before(out[-1]))
        return out

    def before(self, h: np.ndarray) -> np.ndarray:
        """What stands at the symbol before, 0 at a piece's begin."""
        return np.concatenate((np.zeros(1, h.dtype), h[:-1])) * self.same.astype(h.dtype) if len(h) else h

    def grams(self, at: np.ndarray) -> np.ndarray:
        """The ORDER symbols that end at some places, oldest first."""
        out, here = np.zeros((len(at), ORDER), np.uint32), self.symbols
        for k in range(ORDER):
            out[:, ORDER - 1 - k] = here[at]
            here = self.before(here)
        return out


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``docs`` with text and language; what isn't a letter is code point 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        held = 0
        for part, texts in text_slices(batches, text_col, max_bytes=_SLICE):
            langs = np.array(part.column(1).to_pylist(), object)
            for lang in set(langs):
                found = Symbols([texts[i] for i in np.flatnonzero(langs == lang)])
                h, at, n = np.unique(found.hashes()[ORDER], return_index=True, return_counts=True)
                total.setdefault(lang, []).append((h, found.grams(at), n))
                held += len(h)
            if held > _HELD:
                total = {lang: [_merged(x)] for lang, x in total.items()}
                held = sum(len(x[0][0]) for x in total.values())
                if 2 * held > _HELD:
                    yield from flush(total)
                    total, held = {}, 0
        yield from flush(total)

    def flush(total: dict) -> Iterator[pa.RecordBatch]:
        for lang, x in total.items():
            _, grams, n = _merged(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(_said(grams), pa.string()), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string").alias("_lang"))
    return known.mapInArrow(run, _EMPTY).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    h, grams, n = (np.concatenate(x) for x in zip(*parts))
    h, at, of = np.unique(h, return_index=True, return_inverse=True)
    return h, grams[at], np.bincount(of, n, len(h)).astype(np.int64)


def _said(grams: np.ndarray) -> list[str]:
    text = grams.astype("<u4").tobytes().decode("utf-32-le")
    return [text[k : k + ORDER] for k in range(0, len(text), ORDER)]


def raw_hash(grams: np.ndarray) -> np.ndarray:
    """Of rows of symbols, as :meth:`Symbols.hashes` has them."""
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = grams[:, k].astype(np.uint64) + _BASE * h
    return h


def _key(raw: np.ndarray, order: int) -> np.ndarray:
    h = (raw ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class HashArray:
    """Sorted hashes and a row of values for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - min(24, max(2, len(keys).bit_length() + 1)))
        first = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(keys, first).astype(np.int32)
        self.keys, self.values = np.append(keys, ~np.uint64(0)), values  # the last one ends every search

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the hash is there."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        low = self.keys[at] < wanted
        while low.any():
            at += low
            low = self.keys[at] < wanted
        return at, (self.keys[at] == wanted) & (at < len(self.values))


class Models:
    """Interpolated Kneser-Ney models of all languages."""

    def __init__(self, langs: list[str], counted: list[tuple[np.ndarray, np.ndarray]]):
        """``counted``: grams and how often they stand, by language."""
        self.langs, self.grams, self.contexts = langs, [], []
        self.symbols = 1 + len(np.unique(np.concatenate([g.ravel() for g, _ in counted]))) if langs else 1
        by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[(g, n.astype(float)) for g, n in counted]]
        for _ in range(ORDER - 1):  # the next lower order: different symbols before
            lower = []
            for g, _ in by_order[0]:
                _, at, n = np.unique(raw_hash(g[:, 1:]), return_index=True, return_counts=True)
                lower.append((g[at, 1:], n.astype(float)))
            by_order.insert(0, lower)
        for order, found in enumerate(by_order, 1):
            self._add(order, found)

    def _add(self, order: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        every = np.concatenate([g for g, _ in found]) if found else np.zeros((0, order), np.uint32)
        keys, at = np.unique(_key(raw_hash(every), order), return_index=True)
        heads, head_of = np.unique(_key(raw_hash(every[at, :-1]), order), return_inverse=True)
        p = np.zeros((len(keys), len(found)))
        rest = np.zeros((len(heads), len(found)))
        if order > 1:
            below, seen = self.grams[-1].find(_key(raw_hash(every[at, 1:]), order - 1))
            assert seen.all()
            lower = np.exp(self.grams[-1].values[below].astype(float))
        else:
            lower = np.full(p.shape, 1 / self.symbols)
        for lang, (g, c) in enumerate(found):
            mine = np.searchsorted(keys, _key(raw_hash(g), order))
            head = head_of[mine]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total, types = np.bincount(head, c, len(heads)), np.bincount(head, minlength=len(heads))
            weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            rest[:, lang] = np.log(weight)
            p[:, lang] = weight[head_of] * lower[:, lang]
            p[mine, lang] += np.maximum(c - discount, 0) / total[head]
        self.grams.append(HashArray(keys, np.log(p).astype(np.float32)))
        self.contexts.append(HashArray(heads, rest.astype(np.float32)))

    def log_p(self, hashes: list[np.ndarray], heads: list[np.ndarray]) -> np.ndarray:
        """Log probability of symbols in each language.  ``hashes``: of the grams that end with them, by order from 0 on;
        ``heads``: of what stands before, by length from 0 on."""
        n = len(hashes[0])
        out = np.zeros((n, len(self.langs)), np.float32)
        left = np.arange(n)
        for order in range(ORDER, 0, -1):
            at, seen = self.grams[order - 1].find(_key(hashes[order][left], order))
            out[left[seen]] += self.grams[order - 1].values[at[seen]]
            left = left[~seen]
            if not len(left):
                return out
            at, seen = self.contexts[order - 1].find(_key(heads[order - 1][left], order))
            out[left[seen]] += self.contexts[order - 1].values[at[seen]]
        out[left] -= np.float32(np.log(self.symbols))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol by text and language, and whether a text has a letter."""
        found = Symbols(texts)
        hashes = found.hashes()
        heads = [found.before(h) for h in hashes[:-1]]
        out, step = np.zeros((len(texts), len(self.langs))), max(1, _CELLS // len(self.langs))
        for s in range(0, len(found.of), step):
            p = self.log_p([h[s : s + step] for h in hashes], [h[s : s + step] for h in heads])
            of = found.of[s : s + step]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            np.subtract.at(out, of[first], np.add.reduceat(p, first, axis=0, dtype=np.float64))
        return out / np.maximum(np.bincount(found.of, minlength=len(texts)), 1)[:, None], found.letters


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Models:
    found = counts(docs, text_col, lang_col).toArrow().to_pandas()
    langs = sorted(found["lang"].unique())
    return Models(langs, [(_symbols(g["gram"].to_list()), g["n"].to_numpy()) for g in (found[found["lang"] == x] for x in langs)])


def _symbols(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)


def score(docs: DataFrame, models: Models, limit: float = np.inf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, entropy, rejected)`` for every row; ``score`` is the share of the best language among
    all, each weighed by its probability of 16 symbols of the text."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        langs = np.array([*models.langs, "und"], object)
        for part, texts in text_slices(batches, text_col, max_bytes=_SLICE):
            if models.langs:
                h, letters = models.entropies(texts)
                best, least = h.argmin(axis=1), h.min(axis=1)
                share = 1 / np.exp(-16 * (h - least[:, None])).sum(axis=1)
            else:
                letters = np.zeros(len(texts), bool)
                best = least = share = np.zeros(len(texts))
            name = langs[np.where(letters, best, len(langs) - 1).astype(int)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(name, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, least, 0.0)), pa.array(letters & (least > limit))],
                names=[id_col, "lang_pred", "score", "entropy", "rejected"],
            )

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("lang_pred string, score double, entropy double, rejected boolean").fields])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def limit(scored: DataFrame) -> float:
    """Least edge of a bin with the share ``KEPT`` of the entropies of ``scored(lang_pred, entropy)`` below; ``und`` don't count."""
    bins = scored.where("lang_pred <> 'und'").select(F.ceil(F.col("entropy") * BINS).alias("bin"))
    rows = sorted(tuple(r) for r in bins.groupBy("bin").count().collect())  # bounded: BINS rows a nat
    need, below = KEPT * sum(n for _, n in rows), 0
    for b, n in rows:
        below += n
        if below >= need:
            return b / BINS
    return np.inf


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows where ``train`` holds, calibrate, and score all rows."""
    models = learn(docs.where(train), text_col, lang_col)
    most = limit(score(docs.where(train), models, id_col=id_col, text_col=text_col))
    return score(docs, models, most, id_col, text_col)
