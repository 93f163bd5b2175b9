"""Operators that look at one text at a time, against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from vigilake.llm import bpe_codec, license_scan, quality_ledger, token_count
from vigilake.llm.bpe import BacktrackingEncoder, merge, read_ranks

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, id string, n_words int"
TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world", "a<|endoftext|> b<|endoftext|>", "x" * 3000, "ab" * 2000 + "  \n\n x", "日本語テキスト です。 é ñ ß", "don't I'll we've 12345 678 !!!??",
    "\x00\x01\x7f tab\there", "the the the the the the", "word " * 5000, "  leading and trailing  ", "naïve café — “quotes” … 👩‍👩‍👧",
]


def frame(spark, texts=TEXTS):
    rows = [(k if k != 4 else None, text, "clash", 1) for k, text in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


def by_text(rows):
    """Rows in order of their ids; the null id stands for its place, repeated rows must agree."""
    return {4 if r.doc_id is None else r.doc_id: r for r in rows}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encoder_equals_library(library):
    encoder, pick = BacktrackingEncoder(RANKS), random.Random(0)
    for k in range(3000):
        data = bytes(pick.choice(b"abcdeth  \xc3\xa9inou") if k % 3 else pick.randrange(256) for _ in range(pick.randint(1, 40)))
        assert encoder.encode(data) == library._encode_single_piece(data)
        assert b"".join(encoder.bytes_of[x] for x in encoder.encode(data)) == data
    small = BacktrackingEncoder({bytes([x]): x for x in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259}, False)
    for k in range(2000):
        data = bytes(pick.choice(b"abc") for _ in range(pick.randint(1, 12)))
        assert [small.bytes_of[x] for x in small.encode(data)] == merge(data, small.ranks)


def test_codec(spark, library):
    rows = bpe_codec.round_trip(frame(spark), P.path(bpe_codec.RANKS)).collect()
    assert len(rows) == len(TEXTS) + 1
    got = by_text(rows)
    for k, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    ids = bpe_codec.encode_texts(frame(spark), P.path(bpe_codec.RANKS))
    back = bpe_codec.decode_ids(ids, P.path(bpe_codec.RANKS)).collect()
    assert {k: r.text for k, r in by_text(back).items()} == {k: text or "" for k, text in enumerate(TEXTS)}
    assert bpe_codec.round_trip(frame(spark).limit(0), P.path(bpe_codec.RANKS)).count() == 0


def test_token_counts(spark):
    tokenizer = Tokenizer.from_file(P.path(token_count.VOCABULARY))
    got = by_text(token_count.token_counts(frame(spark), P.path(token_count.VOCABULARY)).collect())
    for k, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 512)


def test_only_proven_words_are_whole():
    merges, proven, special = token_count.load(P.path(token_count.VOCABULARY))
    assert special == ("<|endoftext|>",) and not proven & set(special)
    toy = token_count.Merges([("a", "b"), ("b", "c"), ("ab", "c")])
    assert toy.parts("abc") == ["abc"] and toy.parts("bc") == ["bc"] and toy.parts("abbc") == ["ab", "bc"]
    long = "abc" * 40
    assert toy.parts(long) == ["abc"] * 40 == toy._short(list(long))


def brute_measures(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    times, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for k in range(len(words) - 2):
        if times[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark):
    texts = [*TEXTS, "one two three " * 30, "a # b $ c\n" * 40, "SHOUT!! " * 60, "\xa0no break\x85here " * 10, "plain different words of a text " + " ".join(f"w{k}x" for k in range(60))]
    book = quality_ledger.ledger(frame(spark, texts))
    rows = book.collect()
    got = by_text(rows)
    for k, text in enumerate(texts):
        n, chars, symbols, dup, rep = brute_measures(text or "")
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert bool(r.failed & quality_ledger.BASE_POLICY.mask) == (n < 50 or 100 * rep > 50 * n)
    kept = {4 if r.doc_id is None else r.doc_id for r in book.where(quality_ledger.keeps(quality_ledger.POLICY)).collect()}
    assert kept == {len(texts) - 1}
    told = {r.rule: (r.n_failed, r.n_only) for r in quality_ledger.ablations(book, quality_ledger.POLICY).collect()}
    bits = {name: 1 << k for k, name in enumerate(quality_ledger.RULES)}
    assert told == {name: (sum(bool(r.failed & b) for r in rows), sum(r.failed == b for r in rows)) for name, b in bits.items()}
    s = quality_ledger.summary(book).first()
    assert s.n == len(rows) and s.any_failed & bits["few_words"] and s.all_failed == 0
    assert quality_ledger.summary(book.limit(0)).first().any_failed == 0


def test_licenses(spark):
    mit = license_scan.TEMPLATES["mit"][0].replace("[[permission notice]]", "").replace("[[(including the next paragraph)]]", "")
    cases = [
        ("Released under the MIT License.", 1, 1, "mit", "mit"),
        ("the Apache License, Version 2.0 and the APACHE license version 2", 2, 1, "apache-2", "apache-2"),
        ("cc by nc cc by-nc", 2, 0, "cc-by-nc", "cc-by-nc"),
        ("This work is licensed under the GNU General Public License, version 3.", 0, None, "", "gpl-3"),
        ("x " + mit, 0, None, "", "mit"),
        (mit.replace("sublicense", "resell"), 0, None, "", ""),
        ("Licensed under CC BY-NC 4.0.", 1, 2, "cc-by-nc", "cc-by-nc"),
        (None, 0, None, "", ""), ("", 0, None, "", ""), ("mit license", 0, None, "", ""), ("under the mit licenses", 0, None, "", ""),
    ]
    df = spark.createDataFrame([(k, c[0], "x", 1) for k, c in enumerate(cases)], SCHEMA)
    for r in license_scan.scan_licenses(df).collect():
        text, n, first, base, labels = cases[r.doc_id]
        assert (r.n_base, r.first_word, r.base_labels, r.labels) == (n, first, base, labels), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_automaton():
    a = license_scan.Automaton("one [[two]] <<x:2>> three")
    match = lambda text: a.match(text.encode().split(), 0)
    assert [match(x) for x in ("one two a three", "one a three", "one a b three", "one two a b three z", "one three", "one a b c d three", "two a three")] == [4, 3, 4, 5, -1, -1, -1]
    assert a.anchor == b"three"
