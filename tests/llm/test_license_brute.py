"""The licence query against templates written out: every choice of optional regions and numbers of free words, tried at every word."""

import random
import re

from pyspark.sql import functions as F

from vigilake.llm import license_scan

SCHEMA = "doc_id long, text string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def variants(template):
    """Lists of words, None for any word, that a template stands for; optional regions may hold each other."""
    def parse(tokens):
        out = [[]]
        while tokens:
            token = tokens.pop(0)
            if token == "]]":
                break
            if token == "[[":
                inner = parse(tokens)
                out = [a + b for a in out for b in [[], *inner]]
            elif token.startswith("<<"):
                out = [a + [None] * n for a in out for n in range(1, int(token[2:-2].split(":")[1]) + 1)]
            else:
                out = [a + words_of(token) for a in out]
        return out

    return parse(re.findall(r"\[\[|\]\]|<<\w+:\d+>>|(?:(?!\[\[|\]\]|<<).)+", template, re.S))


VARIANTS = [(label, variants(x)) for label, some in license_scan.TEMPLATES.items() for x in some]


def brute(text):
    words = words_of(text)
    starts, base, spans = [], set(), []
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        n = len(phrase.split())
        for k in range(len(words) - n + 1):
            if words[k : k + n] == phrase.split():
                starts.append(k)
                base.add(label)
                spans.append((k, k + n))
    labels = set(base)
    for label, some in VARIANTS:
        first = {x[0] for x in some}
        for k in range(len(words)):
            if None in first or words[k] in first:
                ends = [k + len(x) for x in some if k + len(x) <= len(words) and all(a is None or a == b for a, b in zip(x, words[k : k + len(x)], strict=False))]
                if ends:
                    labels.add(label)
                    spans.append((k, max(ends)))
    covered = len({k for a, b in spans for k in range(a, b)})
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(covered / len(words), 9) if words else 0.0)


def texts():
    pick = random.Random(8)
    plain = "the of a license this work is licensed under terms mit cc by nc gnu version 3 2 0 apache public software ü".split()
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(pick.randrange(1, 4)):
            parts.append(" ".join(pick.choice(plain) for _ in range(pick.randrange(8))))
            label, some = pick.choice(VARIANTS)
            told = [x or pick.choice(plain) for x in pick.choice(some)]
            if pick.random() < 0.4:  # one word changed, left out or put in
                k = pick.randrange(len(told))
                told[k : k + 1] = pick.choice([["other"], [], [told[k], "very"]])
            parts.append(pick.choice([" ", ", ", "\n* "]).join(pick.choice([x, x.upper(), x.title()]) for x in told))
        rows.append(" ".join(parts))
    return rows


def ran(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("id", "n_words", "labels", "score")}).write.parquet(f"{path}/documents.parquet")
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return [(r.doc_id, *(round(r[x], 9) if x == "score" else r[x] for x in names)) for r in license_scan.op9_license_scan(spark, str(path)).collect()]


def test_query_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts()))
    rows += [(1000, None), (1001, ""), (1002, "...\n"), (None, "Under the MIT license"), (None, None), (5, rows[5][1]), (1003, "word " * 30_000 + "under the mit license" + " x" * 1000)]
    rows += [(1004, " ".join(["this is free and unencumbered software released into the public"] * 300)), (1005, "cc by nc " * 500), (1006, "under the mit under the mit license license")]
    got = ran(spark, tmp_path, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(((k, *brute(x)) for k, x in rows), key=key)
    assert len({r[6] for r in got}) > 12 and sum(r[2] > 0 for r in got) > 5


def test_empty_table(spark, tmp_path):
    assert ran(spark, tmp_path, []) == []


def test_variants():
    assert variants("one [[two [[x]]]] <<n:2>> three") == [["one", None, "three"], ["one", None, None, "three"], ["one", "two", None, "three"], ["one", "two", None, None, "three"], ["one", "two", "x", None, "three"], ["one", "two", "x", None, None, "three"]]
