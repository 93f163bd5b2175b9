"""The audit of sources against sums over all terms."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vigilake.llm import source_divergence as audit_of

SCHEMA = "text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    docs = {}
    for text, lang, source in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.setdefault(lang or "", {}).setdefault(source or "", []).append(Counter(TERM.findall(plain)))
    out = []
    for lang, sources in docs.items():
        held, total = Counter(), Counter()
        for own in sources.values():
            for doc in own:
                held.update(set(doc))
                total.update(doc)
        kept = [x for x in held if held[x] >= least]
        counts = {s: {t: sum(doc[t] for doc in own) for t in kept} for s, own in sources.items()}

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of():
    pick = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Éa", "éa", "ÉA", "x日本"]
    rows = []
    for k in range(300):
        lang, source = pick.choice(["en", "en", "de", None]), pick.choice(["hot"] * 5 + ["a", "b", "é", None, ""])
        rows.append((" ".join(pick.choice(words[: pick.choice((5, 64))]).upper() if k % 3 else pick.choice(words) + "1," for _ in range(pick.randrange(12))), lang, source))
    rows += [(None, "en", "void"), ("", "en", "blank"), ("rare rare", "la", "x"), ("other", "la", "y"), ("alone", "zz", "z")]
    rows += [("same line here", "en", "copies")] * 40 + [("long " * 50_000 + "rare", "en", "a")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    """Also with tiles of few sources and slices of few counts; columns of clashing names don't matter."""
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("term", "n", "block", "value", "rank", "cells", "item")})
    want = brute(rows, 12, 4)
    assert {x[2] for x in want} == {"pair", "term"}
    assert sorted(map(tuple, audit_of.audit(df, least=12, top=4).collect())) == want
    monkeypatch.setattr(audit_of, "CELLS", 20)
    monkeypatch.setattr(audit_of, "BLOCK", 2)
    monkeypatch.setattr(audit_of, "ENTRIES", 50)
    assert sorted(map(tuple, audit_of.audit(df, least=12, top=4).collect())) == want


def test_no_kept_terms_and_empty_table(spark):
    df = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y"), (None, None, None)], SCHEMA)
    assert sorted(map(tuple, audit_of.audit(df).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert audit_of.audit(df.where("false")).collect() == []


def test_shares_of_large_counts(spark):
    counts = [0, 7, 10**12, 3 * 10**14]
    got = audit_of.shares(np.array(counts), 10**15, 10**6).tolist()
    assert got == [1 + 10**9 * (x + 5) // (10**15 + 5 * 10**6) for x in counts]
    df = spark.createDataFrame([(x, 10**15, 10**6) for x in counts], "c long, t long, v long")
    assert [r[0] for r in df.select(audit_of.share(F.col("c"), F.col("t"), F.col("v"))).collect()] == got
