"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import json
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, decontaminate, langid, licenses, near, quality, queries, simhash, toxicity, urls
from tidemark.llm.common import fold

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: WORD.findall((t or "").translate(LOWER))
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old stone bridge at dawn."),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn."),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "CC BY cc by All rights reserved. Ünïcode GNU General Public License, all RIGHTS reserved"),
    (7, "one two three"),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 400),
    (9, "Released under the MIT License. " + "lorem ipsum dolor sit amet " * 50),
    (10, "Is it É or é? <|endoftext|> <|im_end|> ǅ İ Σίσυφος ½ ³ 日本語 \x1c\x85 don't we'll"),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn."),
    (11, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 0.5, "k") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, h string")


def test_null_ids_and_clashing_columns(spark):
    """Every operator on documents gives a row for each row, with null ids and columns of its own outputs' names."""
    rows = [(None, "All rights reserved, idiot."), (None, None), (7, "cc by"), (7, "cc by"), (8, ""), (None, "word " * 3000)]
    names = "score double, bands string, node string, fp string, row string, ids string, base string, labels string, spans string, predicted int, lang string, least string, said string"
    clash = spark.createDataFrame([(i, t, *[None] * 13) for i, t in rows], f"doc_id long, text string, {names}").withColumn("lang", F.lit("en"))
    bench = spark.createDataFrame([(1, "word " * 9), (None, "cc by"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    train = F.lit(True)
    outs = {
        "licenses": licenses.report(licenses.scan(clash)),
        "simhash": simhash.report(simhash.classes(clash)),
        "decontaminate": decontaminate.report(decontaminate.hits(clash, bench)),
        "bpe": bpe.digests(bpe.encode_decode(clash, queries.word_bpe_path())),
        "quality": quality.score(clash, quality.learn(clash, labels, train)),
        "toxicity": toxicity.score(clash, toxicity.learn(clash, labels, train)),
        "langid": langid.identify(clash, train),
        "near": near.classes(clash),
    }
    for name, df in outs.items():
        got = df.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows), name
    assert near.one_of_each(clash).count() == 4 and near.one_of_each(clash).columns == clash.columns


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# --- 1 licenses ---------------------------------------------------------------------------------------------------


def test_licenses_base_places(docs):
    got = by_id(licenses.report(licenses.scan(docs)))
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    assert sum(map(len, got.values())) == len(TEXTS)
    for i, t in TEXTS:
        w = words(t)
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i][0]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[9][0].labels == "mit" and got[7][0].score == 0 and 0 <= got[9][0].score <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g h x y z".split()), max_size=40), st.sampled_from([0.5, 0.8, 1.0]), st.dictionaries(st.sampled_from("a b c d e f g h".split()), st.integers(0, 5)))
def test_license_join_is_exact(found, threshold, frequency):
    templates = [("one", "a b c d"), ("two", "c d E f g"), ("three", "h"), ("four", "a a b"), ("five", "c d E F x")]
    scanner = licenses.Scanner(frequency, threshold, templates)
    met = []
    for label, t in templates:
        size = len(t.split()) + licenses.SLACK
        t, must = set(t.lower().split()), {w.lower() for w in t.split() if w.isupper()}
        for s in range(0, len(found), licenses.SLACK + 1):
            block = set(found[s : s + size])
            if (s == 0 or s + size <= len(found) + licenses.SLACK) and len(block & t) >= threshold * len(t) - 1e-9 and must <= block:
                met.append((s, min(len(found), s + size), label, len(block & t) / len(t), must))
    want = {m[:4] for m in met if not any(m[4] < o[4] and m[2] != o[2] and m[0] < o[1] and o[0] < m[1] for o in met)}
    assert set(scanner.blocks([x.encode() for x in found])) == want


def method_labels(text):
    w = licenses.words(text)
    scanner = licenses.Scanner({})
    return {label for _, _, label, _ in scanner.blocks(w)}


def test_license_labels_tell_licenses_apart():
    assert method_labels("Released under the Apache License.") == {"apache"}
    assert method_labels("Licensed under CC BY 4.0.") == {"cc-by"} and method_labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc"}
    assert method_labels("x " * 50 + "This work is licensed under a Creative Commons Attribution 4.0 International License. " + "y " * 50) == {"cc-by"}
    assert method_labels("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License") == {"cc-by-sa"}
    assert method_labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == {"mit"}
    assert method_labels("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted") == {"isc"}
    assert method_labels("Released under the MIT License.") == {"mit"} and method_labels("released under the license of the house") == set()
    assert method_labels("the mit students walked under a bridge while released birds flew past the old driving license office") == set()


def test_no_false_labels_in_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (725, 4359, 96, 42)")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.report(licenses.scan(docs)).collect()}
    assert "mit" not in got[725] | got[4359] and "mit" in got[96] and "apache" in got[42] & got[725]


# --- 2 SimHash ----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, radius=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(rows[a][1] ^ rows[b][1]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [min(least[find(k)]) for k in range(len(rows))]


def test_simhash_classes(docs):
    rows = [(i, plain_fingerprint(t)) for i, t in TEXTS]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(rows, plain_classes(rows)))
    assert sorted(tuple(r) for r in simhash.report(simhash.classes(docs)).collect()) == want


def test_simhash_empty(empty):
    assert simhash.classes(empty).count() == 0


@pytest.mark.parametrize("hot", [10, 10_000])
def test_simhash_links_reach_all(spark, hot):
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(0, 2**63, 120)]
    for _ in range(6):
        codes += [c ^ (1 << int(a)) ^ (1 << int(b)) for c, a, b in zip(codes[:120], rng.integers(0, 63, 120), rng.integers(0, 63, 120))]
    codes = sorted(set(codes))
    rows = list(enumerate(codes))
    want = plain_classes(rows)
    nodes = spark.createDataFrame([(c,) for c in codes], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, hot=hot)).collect()}
    place = {c: k for k, c in enumerate(codes)}
    groups = defaultdict(set)
    for k, c in enumerate(codes):
        groups[found.get(c, c)].add(place[c])
    assert {frozenset(g) for g in groups.values()} == {frozenset(k for k in range(len(codes)) if want[k] == w) for w in set(want)}


def test_gray_index_loses_no_pair():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2**20, 700, dtype=np.uint64))
    buckets = np.sort(rng.integers(0, 5, len(codes)))
    found = {(min(x, y), max(x, y)) for a, b in simhash.GrayIndex(codes, buckets).pairs(4) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if buckets[i] == buckets[j] and bin(int(codes[i] ^ codes[j])).count("1") <= 4}
    assert found == want
    ranks = simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))
    assert ranks.tolist() == list(range(8))


def test_block_count_grows_with_nodes():
    assert [simhash.block_count(2**n, 4) for n in (0, 20, 21, 29, 30, 35, 36, 50)] == [5, 5, 6, 6, 7, 7, 8, 8]


# --- 3 urls -------------------------------------------------------------------------------------------------------

URLS = [
    (1, "http://Example.ORG/es/1?x"), (2, "https://a.example.org/en/12"), (3, "x.org/"), (4, None), (5, "http://com/fr/"), (6, "ftp://b.com/de/#q"),
    (7, "http://notorg/x"), (8, "http://org"), (9, "http://x.org#/es/"), (10, ""), (11, "http://example.org/en/1"), (12, "a://b://c/d"), (12, "a://b://c/d"),
    (13, "http://long.net/" + "a" * 20_000), (14, "http://h\nx.net/é?"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "", "t") for i, u in URLS], "page_id long, url string, html string, text string")
    got = by_id(urls.filter_urls(pages), "page_id")
    assert sum(map(len, got.values())) == len(URLS)
    for i, u in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i][0]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block") and r.score is not None
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_url_models_match_plain_witten_bell(spark):
    good, bad = ["aaab", "aab"], ["bbba"]
    counted = defaultdict(lambda: [0, 0])
    for k, texts in enumerate((good, bad)):
        for t in texts:
            p = "\2" * 4 + t + "\3"
            for i in range(len(p) - 4):
                counted[p[i : i + 5]][k] += 1

    def p(k, gram):
        counts = {g: n[k] for g, n in counted.items() if n[k]}
        out = 1 / 64
        for n in range(5):
            h, g = gram[4 - n : 4], gram[4 - n :]
            after = defaultdict(int)
            for x, c in counts.items():
                if x[4 - n : 4] == h:
                    after[x[4 - n :]] += c
            if after:
                out = (after[g] + len([v for v in after.values() if v]) * out) / (sum(after.values()) + len([v for x, v in after.items() if v]))
        return out

    df = spark.createDataFrame([(g, a, r) for g, (a, r) in counted.items()], "gram string, a long, r long")
    for r in urls.gram_scores(df).collect():
        assert r["llr"] == pytest.approx(np.log(p(0, r["gram"]) / p(1, r["gram"])), abs=1e-9)


def test_url_filter_tells_the_classes_apart(spark):
    rows = [(i, f"http://s{i % 7}.org/{'good' if i % 2 else 'fine'}/{i}") for i in range(200)]
    rows += [(1000 + i, f"http://s{i % 7}.com/de/spam{i}") for i in range(200)]
    rows += [(5000 + i, f"http://s{i % 7}.net/good/{i}") for i in range(20)] + [(6000 + i, f"http://s{i % 7}.net/de/spam{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[5000 + i] == "allow" and got[6000 + i] == "block" for i in range(20))


# --- 4 chat -------------------------------------------------------------------------------------------------------

TALKS = [
    (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (2, 1, "assistant", None), (2, 0, None, "x\ny"),
    (3, 0, "we\nird<|nl|>", "<\\|im_end|>"), (3, 1, "assistant", "<\\\\|a <| b"), (4, 0, "assistant", ""), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
    (8, 0, "assistant", "<z"), (8, 0, "assistant", "<|im_end|>"), (8, 0, "assistant", "<\\|a"), (8, 0, "a\nb", "x"), (8, 0, "a b", "x"),
    (5, None, "assistant", "null turn"), (5, 0, "system", "<|nl|>"), (None, 0, "user", "no id"), (6, 0, "assistant", "é" * 50_000), (7, 0, "a<\\|b", "<|im_start|>user\nx<|im_end|>\n"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TALKS], "conv_id long, turn long, role string, text string, segments string")
    formatted = chat.format_conversations(rows)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    plain = {r.conv_id: "".join(s["text"] for s in r.segments) for r in formatted.collect()}
    talks = defaultdict(list)
    for c, n, role, text in TALKS:
        talks[c].append((n is not None, n, role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(plain[c]))
    assert plain[2] == "<|im_start|>\nx\ny<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"  # nothing to escape
    assert chat.format_conversations(rows.limit(0)).count() == 0


# --- 5 decontamination --------------------------------------------------------------------------------------------


def plain_hits(text, items, span=8):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        m = min(span, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for a in range(len(w) - m + 1):
                if w[a : a + m] == v[k : k + m]:
                    hit |= set(range(a, a + m))
                    found.add(i)
    runs = "".join("x" if k in hit else " " for k in range(len(w))).split()
    return len(w), len(hit), sorted(found), max(map(len, runs), default=0)


@pytest.mark.parametrize("limit", [500_000, 40])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit - 40)
    rng = np.random.default_rng(3)
    random_text = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(1, random_text(20)), (2, random_text(30)), (3, "the lazy dog"), (4, None), (5, ""), (6, "a b"), (7, "Quick BROWN fox jumps, over the lazy dog near the old"), (None, "one two three"), (8, random_text(9))]
    texts = [*TEXTS, (None, items[0][1]), (None, "x"), (90, "A\0b\x7fthe-LAZY\u00a0dog"), (91, " the  lazy dog. "), *((100 + k, random_text(int(n))) for k, n in enumerate(rng.integers(0, 60, 25)))]
    docs = spark.createDataFrame([(i, t, "w", 0) for i, t in texts], "doc_id long, text string, w string, at int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.report(decontaminate.hits(docs, bench)))
    assert sum(map(len, got.values())) == len(texts)
    for i, t in texts:
        n, hit, found, run = plain_hits(t, [x for x in items if x[0] is not None])
        r = next(r for r in got[i] if r.n_words == n)
        assert (r.n_words, r.n_hit, r.n_items, r.longest_span) == (n, hit, len(found), run), (i, t)
        assert r.items_sha256 == sha(",".join(sorted(map(str, found)))) and r.contaminated == (len(found) >= 2)


def test_winnowing_keeps_one_of_each_run_and_loses_no_span(spark):
    rng = np.random.default_rng(4)
    texts = [rng.choice(list("abcdefgh"), n).tolist() for n in (0, 7, 8, 9, 40, 300)] + [["a"] * 50]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, w array<string>")
    rows = df.select("k", decontaminate.fingerprints(F.col("w")).alias("m"), decontaminate.winnow(F.col("w")).alias("runs")).collect()
    by_window = defaultdict(set)
    for r in rows:
        w = texts[r.k]
        assert len(r.m) == max(0, len(w) - 7)
        for i, fp in enumerate(r.m):
            by_window[tuple(w[i : i + 8])].add(fp)
        assert [(x.fp, x.begin, x.end) for x in r.runs] == [(g[0][1], g[0][0], g[-1][0]) for g in ([*v] for _, v in itertools.groupby(enumerate(r.m), key=lambda p: p[1]))]
    assert all(len(f) == 1 for f in by_window.values())  # equal windows, equal fingerprints: no shared span is lost
    long = next(r for r in rows if r.k == 5)
    assert len(long.runs) < 0.6 * len(long.m) and len(rows[6].runs) == 1


def test_decontamination_of_empty_tables(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(empty, none).count() == 0
    assert decontaminate.report(decontaminate.hits(docs, none)).where("n_items > 0 or contaminated").count() == 0


# --- 6 BPE --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe_path())


def same_as_library(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = own.encode(text)
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert own.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_table(docs, library):
    got = by_id(bpe.digests(bpe.encode_decode(docs, queries.word_bpe_path())))
    assert sum(map(len, got.values())) == len(TEXTS)
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i][0]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False)) and len(r.plain_sha256) == 64


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF)) | st.text("abcdeéß .,'!<|>\n\t\x1cΣσİ1½日", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "the", "'ll", "ing", " ", "Σ"])).map("".join))
def test_bpe_agrees_with_library(text):
    from tokenizers import Tokenizer

    global _library
    _library = globals().get("_library") or Tokenizer.from_file(queries.word_bpe_path())
    same_as_library(bpe.tokenizer(queries.word_bpe_path()), _library, text)


@pytest.mark.parametrize("text", ["a" * 3000, "ha" * 2000, "abc" * 1000 + "é" * 999, "thetheing" * 500, "日本" * 700, "!" * 1000 + "?!" * 500])
def test_bpe_streams_long_pieces(library, text):
    same_as_library(bpe.tokenizer(queries.word_bpe_path()), library, text)


def test_stream_is_bounded_and_equal_to_merging():
    merges = [("a", "b"), ("ab", "ab"), ("b", "a"), ("c", "ab"), ("abab", "c"), ("a", "a")]
    vocab = {t: k for k, t in enumerate(["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)])}
    table = bpe.MergeTable(vocab, merges)
    assert table.lookahead == 5
    rng = np.random.default_rng(5)
    for n in [*range(0, 12), 200, 500]:
        s = "".join(rng.choice(list("abc"), n))
        want = table.merge([vocab[c] for c in s])
        assert list(table.stream(s)) == want and table.encode_piece(s) == want
    late = table.stream(iter("abcab" * 1000))
    assert next(late) is not None  # the first token comes long before the end


def test_byte_decoder_holds_incomplete_characters():
    symbols = bpe.byte_symbols()
    text = {k: symbols[b] for k, b in enumerate("é€".encode())} | {9: "<|end|>", 10: symbols[ord("x")] + "</w>"}
    machine = bpe.ByteDecoder(text, "</w>")
    assert [machine.push([k]) for k in (0, 1, 2, 3, 4, 9, 10)] == ["", "é", "", "", "€", "<|end|>", "x "]
    assert machine.push([2]) == "" and machine.finish() == "\ufffd"


def test_bpe_reads_long_texts_in_blocks(library, monkeypatch):
    own = bpe.tokenizer(queries.word_bpe_path())
    rng = np.random.default_rng(15)
    text = " ".join(rng.choice(["Thetheing", "é", "a\u0308", "<|endoftext|>", "ΟΔΟΣ", "\u0301x", "日本", "don't", "\n", "x" * 40], 400))
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "_BLOCK", 50)
    monkeypatch.setattr(bpe, "_IDS", 7)
    assert len(list(own.encode_stream(text))) > 20 and own.encode(text) == whole
    same_as_library(own, library, text)
    words_of = lambda t: own._space(t.lower().replace("<|endoftext|>", ""))
    assert "".join(own.plain(own.encode("Straße in 日本, don't!")).split()) == "straßein日本,don't!"
    assert len(words_of(own.plain(whole))) > 300


# --- 7 and 8 networks ---------------------------------------------------------------------------------------------


def sentences(rng, n):
    vocabulary = ["of", "and", "house", "river", "green", "walks", "stone", "with", "under", "light"]
    return [" ".join(rng.choice(vocabulary, int(k))) for k in rng.integers(5, 200, n)]


def labelled(spark, texts, column, values):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"doc_id long, {column} int")


def test_quality_learns_and_scores_whole_texts(spark):
    rng = np.random.default_rng(6)
    good = sentences(rng, 80)
    texts = good + [t.upper().replace(" ", "!! ") for t in good] + ["green " * 400 + "STONE!! RIVER!! " * 20 + "light " * 400]
    docs, labels = labelled(spark, texts, "quality", [1] * 80 + [0] * 80)
    train = fold(F.col("doc_id"), 5) != 0
    model = quality.learn(docs, labels, train)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i < 80) for i in held) and got[160] < 0.3
    assert model.scores([None, "", texts[0], texts[0]])[:2].tolist() == [0, 0]


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = np.random.default_rng(7)
    clean = sentences(rng, 80)
    texts = clean + [t + " idiot moron " + s for t, s in zip(clean, sentences(rng, 80))] + ["river stone " * 600 + "you idiot moron " + "light and " * 600]
    docs, labels = labelled(spark, texts, "toxic", [0] * 80 + [1] * 80)
    model = toxicity.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.3) == (i >= 80) for i in held) and got[160] >= 0.3
    assert model.scores([None, "", "!!", texts[0], texts[0]])[:3].tolist() == [0, 0, 0]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_networks_without_labels(module, docs, empty):
    model = module.fit([], [])
    assert model.scores([None, "a"]).tolist() == [0, 0.5 if module is quality else 0]
    assert module.fit(["a", "b"], [1, 1]).scores(["c"])[0] > 0.5
    assert module.score(docs, model, name="p").count() == len(TEXTS) and module.score(empty, model, name="p").count() == 0


def test_quality_agrees_with_plain_convolution():
    rng = np.random.default_rng(18)
    net = quality.Network()
    texts = ["", "a", "Hello, wörld! " * 3, "x" * 128, "y" * 124, "abc " * 100, "".join(rng.choice(list("abcdeé \n"), 700))]

    def plain(text):
        data = text.encode()
        blocks = -(-(len(data) + quality.WIDTH) // quality.BLOCK)
        data = data.ljust(blocks * quality.BLOCK + quality.WIDTH, b"\0")
        r = [[max(0.0, sum(float(net.p["taps"][k][data[i + k]][f]) for k in range(quality.WIDTH))) for f in range(quality.FILTERS)] for i in range(blocks * quality.BLOCK)]
        r = np.array(r).reshape(blocks, quality.BLOCK, quality.FILTERS)
        logits = []
        for b in range(max(1, blocks - 1)):
            both = [r[b], r[min(b + 1, blocks - 1)]]
            f = np.concatenate([np.maximum(both[0].max(0), both[1].max(0)), (both[0].mean(0) + both[1].mean(0)) / 2])
            logits.append(np.maximum(f @ net.p["w1"] + net.p["b1"], 0) @ net.p["w2"] + net.p["b2"][0])
        return 1 / (1 + np.exp(max(logits)))

    got = quality.Model(net).scores([*texts, None])
    assert got[0] == got[-1] == 0
    assert got[1:-1] == pytest.approx([plain(t) for t in texts[1:]], abs=1e-4)


def test_toxicity_agrees_with_plain_recurrence():
    rng = np.random.default_rng(19)
    net = toxicity.Network()
    net.known = rng.random(toxicity.SLOTS + 1) < 0.7
    net.known[toxicity.SLOTS] = False
    net.p["e"][:-1] *= 10
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        used = [s for s in toxicity.slots([word])[0].tolist() if s < toxicity.SLOTS and net.known[s]]
        return sum((p["e"][s] for s in used), np.zeros(toxicity.INPUT))

    def plain(text):
        found = [w for t in toxicity.words(text) for w in toxicity.pieces(t)]
        best, h = -np.inf, toxicity.HIDDEN
        for s in range(0, max(1, len(found) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if found else ():
            x = [vector(w) for w in found[s : s + toxicity.WINDOW]]
            sides = []
            for side, order in (("f", x), ("b", x[::-1])):
                state, states = np.zeros(h), []
                for v in order:
                    a, g = v @ p["x" + side] + p["c" + side], state @ p["h" + side]
                    z, r = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
                    state = (1 - z) * state + z * np.tanh(a[2 * h :] + r * g[2 * h :])
                    states.append(state)
                sides.append(states if side == "f" else states[::-1])
            states = np.concatenate([np.array(sides[0]), np.array(sides[1])], axis=1)
            a = np.exp(states @ p["v"])
            best = max(best, (a / a.sum()) @ (states @ p["w"]) + p["b"][0])
        return sig(best) if found else 0.0

    vocabulary = ["idiot", "Größe", "«idiot»", "日本語の文章がここに長く続いていますとも", "a", "x" * 50, "naïve—word", "don't", "12"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 31, 32, 33, 56, 57, 90)] + ["", "!!", "—", None]
    assert toxicity.Model(net).scores(texts) == pytest.approx([plain(t) for t in texts], abs=1e-4)


def test_words_of_any_script():
    assert toxicity.pieces("«Idiot»—naïve".encode()) == ["idiot", "naïve"] and toxicity.pieces("no\u00a0gap".encode()) == ["no", "gap"]
    long = toxicity.pieces(("日" * 40 + "本").encode())
    assert all(len(w) <= toxicity.PIECE for w in long) and long[-1].endswith("本") and sum(map(len, long)) >= 41
    found = toxicity.slots(["idiot", "idiots", "idiot"])
    assert (found[0] == found[2]).all() and len(set(found[0]) & set(found[1])) > 5 and (found[0] == toxicity.SLOTS).sum() == toxicity.WIDE - 1 - 5 - 4 - 3


def test_label_samples_take_one_row_an_id(spark):
    from tidemark.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None), (4, "d" * 50), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic", F.lit(True), 10, 20)
    assert sorted(zip(texts, y)) == [("a", 1), ("c", 0), ("c", 1)]


def test_windows_cover_every_word():
    lengths = np.array([1, 32, 33, 56, 57, 500])
    doc, start, n = toxicity.windows(lengths)
    for k, (size, base) in enumerate(zip(lengths, np.cumsum(lengths) - lengths)):
        seen = set()
        for a, b in zip(start[doc == k], n[doc == k]):
            assert b > 0
            seen |= set(range(a - base, a - base + b))
        assert seen == set(range(size))


def test_recurrent_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(8)
    rows, lengths, y = rng.integers(0, toxicity.SLOTS, (3, 4, 5)), np.array([4, 2, 1]), np.array([1.0, 0, 1])

    def loss():
        x = net.p["e"][rows].sum(axis=2)
        gates = [[x[:, t] @ net.p[f"x{s}"] + net.p[f"c{s}"] for t in range(4)] for s in "fb"]
        z = net.run(lambda k, t: gates[k][t], lengths)[2]
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = net.gradients(rows, lengths, y, np.ones(3))
    for name, at in [("e", (rows[0, 1, 2], 3)), ("xf", (1, 25)), ("hf", (2, 22)), ("xb", (0, 4)), ("cb", (4,)), ("v", (7,)), ("w", (3,)), ("b", (0,))]:
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-5)


# --- 9 language ---------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = np.random.default_rng(9)
    kinds = {"aa": "banana kana mana".split(), "ee": "telen seven ebben".split(), "zz": "жзы жуз зых".split()}
    rows = [(k, " ".join(rng.choice(kinds[x], 30)), x) for k, x in enumerate(list(kinds) * 40)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "ee"), (903, "banana", None), (904, "seven " * 100_000, None), (904, "seven " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.identify(docs, fold(F.col("doc_id"), 4) != 2))
    assert all(got[i][0].lang_pred == lang for i, _, lang in rows[:120])
    assert [got[i][0].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "ee"] and len(got[904]) == 2
    assert all(0 <= r.score <= 1 for x in got.values() for r in x) and got[900][0].score == 0
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_language_limit_counts_all_training_rows(spark):
    usual = spark.range(8_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("banana kana mana").alias("text"), F.lit("aa").alias("lang"))
    odd = spark.range(4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("qxj wvq xjq").alias("text"), F.lit(None).cast("string").alias("lang"))
    got = langid.identify(usual.union(odd), F.lit(True)).groupBy("rejected").count().collect()
    assert {r.rejected: r["count"] for r in got} == {False: 8_000, True: 4}
    scored = spark.range(1, 10_001).select(F.lit("aa").alias("lang_pred"), (F.col("id") / 2_000 - 0.00001).alias("entropy"))
    assert langid.limit(scored) == pytest.approx(4.995) and langid.limit(scored.limit(0)) == np.inf


def plain_kneser_ney(texts, order=langid.ORDER):
    """p(symbol | the symbols before) from counts in dictionaries."""

    def symbols(t):
        t = "".join(c.lower()[0] if unicodedata.category(c)[0] == "L" else "\0" for c in t)
        return re.sub("\0+", "\0", t).removeprefix("\0")

    count = [defaultdict(float) for _ in range(order + 1)]
    for t in texts:
        s = "\0" * (order - 1) + symbols(t)
        for i in range(order - 1, len(s)):
            count[order][s[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        for g in count[k + 1]:
            count[k][g[1:]] += 1

    def p(before, c, size):
        out = 1 / size
        for k in range(1, order + 1):
            once, twice = (sum(n == m for n in count[k].values()) for m in (1, 2))
            d = once / (once + 2 * twice) if once and twice else 0.5
            h = before[len(before) - k + 1 :]
            after = {g: n for g, n in count[k].items() if g[:-1] == h}
            if after:
                total = sum(after.values())
                out = max(after.get(h + c, 0) - d, 0) / total + d * len(after) / total * out
        return out

    return symbols, p, count


def test_kneser_ney_agrees_with_plain_counts():
    texts = {"aa": ["Abc abd, abc", "ab bab"], "bb": ["бвг вбг! Ab 日本日"]}
    counted = []
    for t in texts.values():
        found = langid.Symbols(t)
        h, at, n = np.unique(found.hashes()[langid.ORDER], return_index=True, return_counts=True)
        counted.append((found.grams(at), n))
    models = langid.Models(list(texts), counted)
    plain = {x: plain_kneser_ney(t) for x, t in texts.items()}
    size = 1 + len({c for _, _, count in plain.values() for g in count[langid.ORDER] for c in g})
    assert models.symbols == size
    tests = ["abc", "ab abd бвг", "zz", "日本 ab", "x" * 9, None, "12", "ab" * 300]
    got, letters = models.entropies(tests)
    assert letters.tolist() == [t not in (None, "12") for t in tests]
    for t, row in zip(tests, got):
        for j, (symbols, p, _) in enumerate(plain.values()):
            s = "\0" * (langid.ORDER - 1) + symbols(t or "")
            logs = [np.log(p(s[i - langid.ORDER + 1 : i], s[i], size)) for i in range(langid.ORDER - 1, len(s))]
            assert row[j] == pytest.approx(-np.mean(logs) if logs else 0, abs=1e-4)
    symbols, p, _ = plain["aa"]
    everything = {c for _, _, count in plain.values() for g in count[langid.ORDER] for c in g} | {"z"}
    assert sum(p("\0\0ab", c, size) for c in everything) == pytest.approx(1)


def test_hash_arrays_find_what_is_there():
    rng = np.random.default_rng(16)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        held = langid.HashArray(keys, np.arange(len(keys)))
        wanted = np.concatenate([keys, rng.integers(0, 1 << 64, 50, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at, seen = held.find(wanted)
        assert seen.tolist() == np.isin(wanted, keys).tolist() and (keys[at[seen]] == wanted[seen]).all()


# --- 10 neighbours ------------------------------------------------------------------------------------------------


def test_neighbours(spark, monkeypatch):
    """With all cells passed the search is exact: rows, copies, own rows, lengths, ties."""
    monkeypatch.setattr(ann, "PART", 60)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:90] = x[40]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (None, [1.0] * 6), (520, [])]
    rows += [rows[0], (20, (-x[20]).tolist()), (500, [1.0]), (501, [2.0]), (502, [-1.0])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for k, (i, v) in enumerate(usable):
        if i % 20 == 0:
            near = sorted((-round(float(np.dot(v, u)), 9), j) for n, (j, u) in enumerate(usable) if n != k and len(u) == len(v))[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(df, share=1.0).collect()]
    assert sorted(g[:2] + g[3:] for g in got) == sorted(w[:2] + w[3:] for w in want)
    assert sorted(g[::2] for g in got) == sorted(w[::2] for w in want)
    assert {q for q, *_ in got} == {*range(0, 300, 20), 500}
    few = df.where("vec_id < 5 and vec_id > 0 or vec_id = 40")
    assert sorted((r.query_id, r.rank) for r in ann.search(few).collect()) == [(40, k) for k in (1, 2, 3, 4)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id >= 400 and vec_id < 490")).count() == 0


@pytest.mark.parametrize("n", [600, 2000])
def test_recall_of_the_index(spark, n):
    """The same way at every size: two fifths of the entries, clustered and directionless ones."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x[: n // 2] = rng.normal(size=(12, 32))[rng.integers(0, 12, n // 2)] + 0.4 * x[: n // 2]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.search(df)
    assert found.count() == 20 * -(-n // 20)
    least = ann.recall(df, ann.search(df, share=0.01))
    assert least + 0.1 < ann.recall(df, found) < 1 and ann.recall(df, found) >= 0.9  # cells that aren't passed aren't searched


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(11)
    a, b, n = rng.normal(size=7), rng.normal(size=9), rng.integers(0, 5, (7, 9))
    sums = (a[:, None] + b[None, :]).ravel()
    order = np.argsort(-sums, kind="stable")
    for need in (1, 20, 60, 10_000):
        k = int(np.searchsorted(np.cumsum(n.ravel()[order]), need))
        assert ann.walk(a, b, n, need) == sums[order[min(k, 62)]]
    assert ann.walk(a, b, n, 0) == np.inf


def test_parts_have_bounded_size():
    rng = np.random.default_rng(12)
    counts = rng.integers(0, 40, 50)
    counts[7] = 500
    parts = ann.dealt(counts, 100, 4)
    total = defaultdict(float)
    for (first, n), c in zip(parts, counts):
        for p in range(first, first + n):
            total[p] += c / n
    assert max(total.values()) <= 100 and parts[7][1] == 5


# --- pipeline -----------------------------------------------------------------------------------------------------


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_near(rows):
    """Smallest id of each row's class, by comparing all sets."""
    sets, root = {i: plain_shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("part", [near.PART, 400])
def test_near_duplicates_agree_with_brute_force(spark, part):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((len(rows), " ".join(w)))
        for changed in (1, 3, 4, 5, 9):  # of 196 shingles each change takes up to five: similarities of 0.95 to 0.6
            v = list(w)
            for at in rng.choice(200, changed, replace=False):
                v[at] = "other"
            rows.append((len(rows), " ".join(v)))
    rows += [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "ONE  two"), (905, "one three"), (906, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.classes(docs, part).collect()}
    want = plain_near(rows)
    assert got == want
    assert got[906] == 0 and got[900] == got[902] == 900 and got[905] == 905
    assert near.classes(docs.limit(0)).count() == 0


def test_pipeline_drops_near_copies_of_similarity_four_fifths(spark):
    import corpus_pipeline

    w = [f"w{k}" for k in range(200)]
    v, u = list(w), list(w)
    v[20] = v[60] = v[100] = v[140] = "other"  # 176 of 216 shingles: 0.81
    u[20] = u[60] = u[100] = u[140] = u[180] = "another"  # 171 of 221: 0.77
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((w, v, u))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [0, 2]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (None, b + " ", 0), (None, c, 1), (None, c, 0), (7, c.upper(), 0), (None, None, 0), (None, "x y", 0), (9, "", 0), (1, "x y z", 3), (1, "x y z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int")
    got = sorted(map(tuple, near.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, a, 0), (5, b, 0), (7, c.upper(), 0), (9, "", 0), (None, "x y", 0), (1, "x y z", 2)], key=repr)
    assert near.one_of_each(docs.limit(0)).count() == 0


def test_contaminated_rows_go_by_their_own_text(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item}"), (None, "clean"), (3, item), (3, "clean too"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.not_contaminated(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, "clean"), (3, "clean too"), (4, None)], key=repr)


def test_pipeline_drops_whole_short_items(spark, tmp_path):
    import corpus_pipeline

    items = ["a1 a2 a3 a4 a5 a6 a7 a8", "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10", " ".join(f"c{k}" for k in range(20)), "d1 d2 d3"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = items[2].split()
    texts = [f"x {items[0]} y", f"x {items[1]}, y", f"x {items[1][:-4]} y", f"x {' '.join(c[4:16])} y", f"x {' '.join(c[4:17])} y", f"x {items[3]} y", "x y", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.not_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {2, 3, 5, 6, 7}  # 9 of 10 words, 12 of 20 and an item of less than a window stay


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    assert len(corpus_pipeline.STAGES) == 5 and all(k.startswith("op") for k in QUERIES) and set(ORACLE_SQL) <= set(QUERIES)
    rng = np.random.default_rng(12)
    good = sentences(rng, 60)
    passage = [f"alpha beta gamma delta epsilon zeta eta theta iota kappa {k}" for k in "ab"]
    texts = dict(enumerate(good)) | {100 + k: t.upper().replace(" ", "!! ") for k, t in enumerate(good)} | {200 + k: t + " idiot moron " + t for k, t in enumerate(good)}
    texts |= {300: good[0], 301: good[1], 302: " ".join(passage) + " " + good[2], 303: None, 304: "", 305: good[3] + " one two three four five six seven eight nine ten eleven twelve thirteen fourteen " + good[4]}
    texts |= {306: good[5] + " one two three four five six seven eight " + good[6]}
    more = sentences(np.random.default_rng(13), 2)
    texts |= {307: more[0] + " " + " ".join(passage) + " " + more[0], 308: more[1] + " one two three four five six seven eight nine ten eleven twelve thirteen fourteen"}
    passage.append("one two three four five six seven eight nine ten eleven twelve thirteen fourteen")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, p) for k, p in enumerate(passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(i, int(i < 100 or i >= 200), int(200 <= i < 260)) for i in texts if i < 260]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["quality"] & {303, 304} == set() and not any(100 <= i < 160 for i in kept["quality"])
    assert not any(200 <= i < 260 for i in kept["toxicity"])
    assert kept["near_dedup"] == set(plain_near([(i, texts[i]) for i in sorted(kept["toxicity"])]).values())
    assert {307, 308} <= kept["near_dedup"], {k: v & set(range(300, 310)) for k, v in kept.items()}
    assert kept["decontaminate"] == kept["near_dedup"] - {302, 305, 307, 308} and 306 in kept["bpe"] and kept["bpe"] == kept["decontaminate"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["bpe"]


def test_queries_run_over_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_licenses", "op2_simhash", "op5_decontaminate"):
        assert queries.QUERIES[name](spark, sf).count() == documents
    kinds = {
        "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    }
    for name, columns in kinds.items():
        df = queries.QUERIES[name](spark, sf)
        rows = df.collect()
        assert columns.items() <= dict(df.dtypes).items() and len(rows) == documents
        for r in rows if "held_out" in columns else ():
            fold_of = zlib.crc32(str(r.doc_id).encode())
            assert r.held_out == (fold_of % 5 == 0 if name == "op7_quality" else fold_of % 4 == 2) and 0 <= r.score <= 1
            assert "predicted" not in columns or r.predicted == (r.score >= 0.3)
    pages = queries.QUERIES["op3_url_filter"](spark, sf)
    assert pages.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and pages.where("verdict not in ('allow', 'block') or verdict is null or host is null").count() == 0
    near = queries.QUERIES["op10_ann"](spark, sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert near.count() == 20 * vectors.where("vec_id % 20 = 0").count() and dict(near.dtypes)["rank"] == "int" and ann.recall(vectors, near) >= 0.9
    assert queries.QUERIES["op4_chat"](spark, sf).where("conv_id = -1 and n_turns = 2").count() == 1
    json.dumps(sorted(queries.QUERIES))
