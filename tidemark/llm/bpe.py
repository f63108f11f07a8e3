"""BPE encoding and decoding as a streaming transducer with bounded look-ahead.

Encoding a prefix of a piece with byte-pair merges has one *last token*, and that token is the only
vocabulary entry that (a) is a suffix of the prefix and (b) stays apart from the last token of what stands
before it, i.e. merging the two tokens' symbols again gives the same two tokens.  The transducer keeps, for
each recent position, that last token.  A future token spans at most as many symbols as the longest token
of the merge list, so any later encoding passes through one of the last ``lookahead`` positions: tokens that
the chains of all those positions share cannot change any more and are emitted.  Memory is the window of
unsettled positions, whatever the length of the text.

A text is read in blocks that end before a space, and ids are decoded in blocks, so what is held besides the text, its ids and
a bounded memory of short pieces doesn't grow.  Decoding is a state machine over ids: entries are joined as the tokenizer
file's decoder says (none: by one space); ``plain`` is the text that the ids' bytes are, an incremental UTF-8 machine that
holds incomplete characters back.

Defined results: null and empty texts have no tokens and decode to the empty text; rows repeat as they
are; an empty table gives an empty table; columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, text_slices

#: Unicode White_Space, as the tokenizer's regular expressions take \s.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces longer than this are not remembered, and settle as they go.
_LONG_PIECE = 64
#: Pieces, and pairs of tokens, remembered in a worker.  Past this many pieces the memory starts anew, and those from before
#: are taken over as they come again, until it is full once more.
_MEMORY = 450_000
#: Characters of a text that are read at once; a block ends at the next space.
_BLOCK = 1 << 16
#: Ids that are decoded at once.
_IDS = 1 << 14
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], free = chr(free), free + 1
    return [table[b] for b in range(256)]


class MergeTable:
    """Vocabulary and ranked merges; answers which token ends a prefix."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.text = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left = a[: -len(suffix)] if suffix and a.endswith(suffix) else a
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[left + b]))
        #: Tokens by the symbols that they span, for inner and for word-final places.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in vocab.items():
            if suffix and t.endswith(suffix) and len(t) > len(suffix):
                self.final[t[: -len(suffix)]] = i
            else:
                self.inner[t] = i
        if not suffix:
            self.final = self.inner
        made = {i for _, i in self.rank.values()}
        # Longer entries that no merge makes can't occur; the single symbols always can.
        self.inner = {t: i for t, i in self.inner.items() if len(t) == 1 or i in made}
        self.final = {t: i for t, i in self.final.items() if len(t) == 1 or i in made}
        #: Sufficient look-ahead of the merge list: the most symbols that a token spans.
        self.lookahead = max(map(len, [*self.inner, *self.final]), default=1)
        self._symbols: dict[int, tuple[int, ...]] = {}
        self._reached: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}  # by first id << 20 plus second id

    def symbols(self, token: int) -> tuple[int, ...]:
        got = self._symbols.get(token)
        if got is None:
            t = self.text[token]
            last = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            body = t[: -len(self.suffix)] if last else t
            ids = [self.inner[c] for c in body]
            if last:
                ids[-1] = self.final[body[-1]]
            got = self._symbols[token] = tuple(ids)
        return got

    def merge(self, ids: list[int]) -> list[int]:
        """All merges by rank, leftmost first: the definition that the transducer must agree with."""
        rank = self.rank
        while len(ids) > 1:
            best = at = -1
            for k, pair in enumerate(zip(ids, ids[1:])):
                got = rank.get(pair)
                if got is not None and (at < 0 or got[0] < best):
                    best, new, at = got[0], got[1], k
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are when their symbols are merged anew."""
        got = self._apart.get((a << 20) + b)
        if got is None:
            if len(self._apart) > _MEMORY:
                self._apart.clear()
            got = (a, b) not in self.rank and self.merge([*self.symbols(a), *self.symbols(b)]) == [a, b]
            self._apart[(a << 20) + b] = got
        return got

    def advance(self, window: str, last: list[int], back: list[int], before: int, end: bool) -> None:
        """The transducer's step: the last token of each prefix of ``window`` that ``last`` lacks, and in ``back`` where it
        begins.  ``before`` is the settled token in front of the window, -1 if there is none; ``end``: the piece ends with it."""
        inner, final, apart, deep, n = self.inner, self.final, self._apart, self.lookahead, len(window)
        for i in range(len(last), n + 1):
            have = final if end and i == n else inner
            likely = back[i - 1]  # the token before, longer by a symbol; else the symbol alone; else any other
            for j in (likely, i - 1, *range(likely + 1, i - 1), *range(max(0, i - deep), likely)):
                t = have.get(window[j:i])
                if t is None:
                    continue
                p = last[j] if j else before
                if p >= 0:
                    ok = apart.get((p << 20) + t)
                    if not (self.apart(p, t) if ok is None else ok):
                        continue
                elif not self.merge_reaches(t):
                    continue
                last.append(t)
                back.append(j)
                break
            else:
                raise ValueError("a symbol is missing from the vocabulary")

    def encode_piece(self, piece: str) -> list[int]:
        """A piece of at most two look-aheads: nothing settles before its end."""
        whole = self.final.get(piece)
        if whole is not None and self.merge_reaches(whole):
            return [whole]
        last, back = [-1], [0]
        self.advance(piece, last, back, -1, True)
        return _chain(last, back, len(piece))

    def merge_reaches(self, token: int) -> bool:
        """Whether merging a token's own symbols gives that token."""
        got = self._reached.get(token)
        if got is None:
            got = self._reached[token] = self.merge([*self.symbols(token)]) == [token]
        return got

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of a piece of any length, as soon as they are stable; only what isn't settled is held."""
        deep, symbols = self.lookahead, iter(symbols)
        window, last, back, before, held = "", [-1], [0], -1, ""
        while block := held + "".join(islice(symbols, 2 * deep)):
            if len(block) == len(held):  # the last symbol waited, since another token may end a piece
                self.advance(window + held, last, back, before, True)
                yield from _chain(last, back, len(window) + 1)
                return
            window, held = window + block[:-1], block[-1]
            self.advance(window, last, back, before, False)
            # Settled is what the chains of all the last positions share; the largest goes back until all have met.
            live = set(range(max(0, len(window) - deep), len(window) + 1))
            while len(live) > 1:
                top = max(live)
                live.discard(top)
                live.add(back[top])
            (meet,) = live
            if meet:
                yield from _chain(last, back, meet)
                before = last[meet]
                window, last, back = window[meet:], [-1, *last[meet + 1 :]], [0, *(max(0, b - meet) for b in back[meet + 1 :])]


def _chain(last: list[int], back: list[int], end: int) -> list[int]:
    """The tokens that end at ``end``, back to the window's begin."""
    out = []
    while end:
        out.append(last[end])
        end = back[end]
    out.reverse()
    return out


class WordBpe:
    """The tokenizer that a ``tokenizers`` JSON file describes: NFC, white space to one space, lower case,
    a splitting pattern, byte-level symbols, merges with an end-of-word suffix."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.table = MergeTable(model["vocab"], map(tuple, model["merges"]), model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace("\\s", _SPACE)
        for name in "LN":  # as of the interpreter's Unicode tables, which are nearer to the library's than those of regex
            pattern = pattern.replace(f"\\p{{{name}}}", _category(name))
        self._pieces = regex.compile(pattern).findall
        self._space = regex.compile(f"[{_SPACE}]+").split
        self._symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.text = self.table.text | {i: t for t, i in self.special.items()}
        self.decoder = spec.get("decoder")
        tokenizer = self

        class Memory(dict):
            """White-space-free chunks and their ids as little-endian bytes."""

            before: dict[str, bytes] = {}

            def __missing__(self, chunk: str) -> bytes:
                end = chunk[-1]
                if end in ".,!" and chunk[:-1].isalpha():
                    return self[chunk[:-1]] + self[end]
                ids = self.before.get(chunk)
                if ids is None:
                    ids = tokenizer._chunk(chunk)
                if len(chunk) <= _LONG_PIECE:
                    if len(self) >= _MEMORY:
                        self.before = dict(self)
                        self.clear()
                    self[chunk] = ids
                return ids

        self._memory = Memory()

    def _chunk(self, chunk: str) -> bytes:
        pieces = self._pieces(chunk)
        if len(pieces) > 1:
            return b"".join([self._piece(p) if len(p) > _LONG_PIECE else self._memory[p] for p in pieces])
        return self._piece(chunk) if pieces else b""

    def _piece(self, piece: str) -> bytes:
        symbols = piece.translate(self._symbols) if piece.isascii() else piece.encode().decode("latin-1").translate(self._symbols)
        ids = self.table.encode_piece(symbols) if len(symbols) <= _LONG_PIECE else self.table.stream(symbols)
        return array("I", ids).tobytes()

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space, which no piece crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-casing goes character by character, without the final-sigma rule
                text = text.replace("Σ", "σ")
        if _SEPARATORS(text):  # str.split takes these four for white space too
            return [c for c in self._space(text.lower()) if c]
        return text.lower().split()

    def encode_stream(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, block by block; what is held doesn't grow with the text."""
        get = self._memory.__getitem__
        for block in _blocks(text or ""):
            if self._special is None or "<|" not in block:
                yield b"".join(map(get, self.chunks(block)))
                continue
            for k, part in enumerate(self._special.split(block)):
                if k % 2:
                    yield self.special[part].to_bytes(4, "little")
                elif part:
                    yield b"".join(map(get, self.chunks(part)))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.encode_stream(text))

    def decode_stream(self, ids: bytes) -> Iterator[str]:
        """The text by the file's decoder, piece by piece.  With no decoder in the file: the entries, joined by one space."""
        machine = None if self.decoder is None else ByteDecoder(self.text, self.table.suffix)
        between = ""
        for at in range(0, len(ids), 4 * _IDS):
            numbers = array("I")
            numbers.frombytes(ids[at : at + 4 * _IDS])
            if machine is None:
                yield between + " ".join(map(self.text.__getitem__, numbers))
                between = " "
            else:
                yield machine.push(numbers)
        if machine is not None:
            yield machine.finish()

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_stream(ids))

    def plain(self, ids: bytes) -> str:
        """What the ids say: the bytes behind the entries through the byte-to-text machine, a space after each word."""
        machine, out = ByteDecoder(self.text, self.table.suffix), []
        for at in range(0, len(ids), 4 * _IDS):
            numbers = array("I")
            numbers.frombytes(ids[at : at + 4 * _IDS])
            out.append(machine.push(numbers))
        out.append(machine.finish())
        return "".join(out)


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks of some ``_BLOCK`` characters, each but the first beginning with a space: no piece, no control
    string and no composed character crosses into it."""
    start = 0
    while len(text) - start > _BLOCK:
        end = text.find(" ", start + _BLOCK)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _category(first: str) -> str:
    """Members of a character class: code points whose category begins with ``first``."""
    out, start = [], None
    for cp in range(0x110001):
        inside = cp < 0x110000 and unicodedata.category(chr(cp))[0] == first
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


class ByteDecoder:
    """Incremental byte-to-text machine for byte-level vocabularies: bytes of an incomplete character wait.  Entries that
    aren't byte-level count as their own text; an end-of-word suffix becomes a space."""

    def __init__(self, text: dict[int, str], suffix: str = ""):
        byte = {s: b for b, s in enumerate(byte_symbols())}

        class Bytes(dict):
            def __missing__(self, token: int) -> bytes:
                entry, after = text[token], b""
                if suffix and entry.endswith(suffix):
                    entry, after = entry[: -len(suffix)], b" "
                found = self[token] = (bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()) + after
                return found

        self._bytes = Bytes()
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, tokens: Iterable[int]) -> str:
        return self._machine.decode(b"".join(map(self._bytes.__getitem__, tokens)))

    def finish(self) -> str:
        out = self._machine.decode(b"", True)
        self._machine.reset()
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded, plain)``: ids as binary little-endian 32-bit integers, the text as the file's decoder gives it,
    and the text that the ids' bytes are.

    A map over the rows: no shuffle, so a lost executor costs only its own tasks, and skew of keys has no
    effect.  A worker holds one bounded slice of rows, the tokenizer and its piece memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for part, texts in text_slices(batches, text_col):
            ids = [bpe.encode(t) for t in texts]
            texts = [pa.array([read(x) for x in ids], pa.string()) for read in (bpe.decode, bpe.plain)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), *texts], names=[id_col, "ids", "decoded", "plain"])

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("ids binary, decoded string, plain string").fields])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of what :func:`encode_decode` returns."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.col("plain").cast("binary"), 256).alias("plain_sha256"),
    )
