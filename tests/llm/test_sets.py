"""Operators that compare texts with each other, against brute force."""

import hashlib
import random
import re

import pytest

from vigilake.llm import contamination, order_minhash, suffix_dedup
from vigilake.llm.words import plain_words

SCHEMA = "doc_id long, text string, id string, key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
INF = float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(doc, text, "clash", 7) for doc, text in rows], SCHEMA)


def brute_repeats(rows, size):
    words = [(INF if doc is None else doc, WORD.findall(text or "")) for doc, text in rows]
    first = {}
    for doc, some in words:
        for k in range(len(some) - size + 1):
            window = tuple(some[k : k + size])
            first[window] = min(doc, first.get(window, INF))
    out = []
    for (doc, some), (name, _) in zip(words, rows, strict=True):
        gone = set()
        for k in range(len(some) - size + 1):
            if first[tuple(some[k : k + size])] < doc:
                gone |= set(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(some) if k not in gone)
        out.append((name, len(some), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [{}, {"block_words": 60, "least_parts": 3, "part_suffixes": 20}])
def test_repeats(spark, bounds):
    pick = random.Random(5)
    passages = [[f"p{k}w{j}" for j in range(30)] for k in range(4)]
    rows = []
    for doc in range(40):
        words = []
        for _ in range(pick.randint(0, 4)):
            some = pick.choice(passages)
            at = pick.randrange(20)
            words += some[at : at + pick.randint(5, 30)] + [pick.choice("abc") for _ in range(pick.randint(0, 6))]
        rows.append((doc if doc != 7 else None, pick.choice([" ", "\n", "\t"]).join(words)))
    rows += [(50, "same " * 100), (51, "same " * 90), (52, None), (53, ""), (54, rows[3][1]), (3, rows[3][1]), (3, rows[9][1] + " z"), (None, rows[3][1])]
    got = suffix_dedup.remove_repeats(frame(spark, rows), size=8, **bounds)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == brute_repeats(rows, 8)
    for r in got.limit(5).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0), size=8).count() == 0


def test_frequent_run_is_split(spark):
    """A passage shorter than a window, in all documents and with other words around it, is one subtree; its windows are still dealt to bounded groups."""
    pick = random.Random(11)
    own = lambda n: [f"o{pick.randrange(10**9)}" for _ in range(n)]
    rows = [(k, " ".join(own(30) + [f"p{j}" for j in range(20)] + own(30))) for k in range(200)]
    rows += [(300 + k, rows[k][1] + " end") for k in range(3)]
    bound, parts, known, block = 600, 8, suffix_dedup.WordHashes(), suffix_dedup.Suffixes(50, 16)
    for doc, text in rows:
        words = suffix_dedup.hashes_of(text.encode(), known)
        block.add(doc, doc, words, suffix_dedup.window_minima(block.rolling.runs(block.rolling.sums(words), 16), 35))
    np = suffix_dedup.np
    docs = spark.createDataFrame([(k,) for k in range(2)], "k long")
    large = suffix_dedup.large_groups(docs, lambda batches, b=block: [b for batch in batches for _ in range(batch.num_rows)], parts, bound)  # each row counts the block once
    of, _, *depths = block.columns()
    sizes = np.bincount(suffix_dedup.group_of(depths, parts, large))
    assert len(of) == 200 * 31 + 3 * 32 and large[:parts].all() and large[parts : 2 * parts].all() and sizes[: 2 * parts].sum() == 0  # prefixes of 16 and 32 words are too frequent
    unlike = np.bincount(suffix_dedup.group_of(depths, parts, np.repeat([True, False, False], parts)))
    assert unlike[:parts].sum() == 0 and unlike[parts:].sum() == len(of)
    got = suffix_dedup.remove_repeats(frame(spark, rows), least_parts=8, part_suffixes=bound, block_words=900)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == brute_repeats(rows, 50)


def brute_contamination(text, items, size):
    words, hit, names = plain_words((text or "").encode()), set(), set()
    for name, item in items:
        own = plain_words((item or "").encode())
        for k in range(max(1, len(own) - size + 1) if own else 0):
            window = own[k : k + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    names.add(name)
    return len(words), len(hit), sorted(x for x in names if x is not None)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    pick = random.Random(2)
    text = lambda n: " ".join(pick.choice("ab the of X y1") for _ in range(n))
    items = [("1", "The quick Brown fox, jumps over the lazy dog and runs away"), ("2", "short item"), ("3", text(14)), ("10", None), (None, "null id item words here"), ("2", "short item"), ("4", "...")]
    docs = [(1, "x the QUICK brown fox jumps over the lazy dog and runs z"), (2, "a Short; item. short ITEM"), (3, None), (4, ""), (None, "null-id item words here"), (5, text(300)), (5, text(300)), (6, items[2][1] + " " + items[2][1]), (7, "short")]
    table = spark.createDataFrame(items, "item_id string, text string")
    got = contamination.contamination(frame(spark, docs), table, carry=("text", "id"))
    read = sorted(((r.text, r.n_words, contamination._covered(r.spans), r.items) for r in got.collect()), key=str)
    assert read == sorted(((t, *brute_contamination(t, items, 10)) for _, t in docs), key=str)
    said = {r.n_words: r for r in contamination.report(contamination.contamination(frame(spark, docs[:2]), table)).collect()}
    assert said[13].contaminated and said[13].items_sha256 == hashlib.sha256(b"1").hexdigest()
    none = contamination.report(contamination.contamination(frame(spark, docs), table.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_band_equals_whole_table():
    pick = random.Random(3)

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(4000):
        a = [pick.choice("abcd") for _ in range(pick.randint(0, 25))]
        b = list(a) if pick.random() < 0.8 else [pick.choice("abcd") for _ in range(pick.randint(0, 25))]
        for _ in range(pick.randint(0, 8)):
            k, what = pick.randrange(len(b) + 1), pick.random()
            b[k : k + (what < 0.6)] = [] if what < 0.3 else [pick.choice("abcd")]
        most = pick.randint(0, 12)
        assert order_minhash.edits_within(a, b, most) == min(whole(a, b), most + 1)


def test_near_classes(spark):
    pick = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, group = [], {}
    for g in range(30):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(60, 300))]
        for c in range(pick.choice([1, 2, 5])):
            words = list(base)
            for _ in range(int(len(words) * 0.04) if c else 0):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            doc = len(rows)
            rows.append((doc, " ".join(words)))
            group[doc] = g
    hot = " ".join(vocabulary[:14])
    singles = [(1000 + k, hot + " " + " ".join(pick.choice(vocabulary) for _ in range(150))) for k in range(40)]
    edge = [(2000, None), (2001, ""), (2002, "..."), (2003, "two words"), (2004, "Two, words!"), (None, rows[0][1]), (None, "nothing like it at all here"), (2005, "repeat " * 40), (2006, "repeat " * 41), (0, rows[0][1])]
    out = order_minhash.near_classes(frame(spark, [*rows, *singles, *edge])).collect()
    assert len(out) == len(rows) + len(singles) + len(edge)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.class_id)
    first = {}
    for doc, g in group.items():
        first.setdefault(g, doc)
    assert all(got[doc] == {first[g]} for doc, g in group.items())
    assert all(got[doc] == {doc} for doc, _ in singles)
    assert [got[k] for k in (2000, 2001, 2002, 2003, 2004, 2005, 2006)] == [{2000}, {2001}, {2002}, {2003}, {2003}, {2005}, {2005}]
    assert got[None] == {0, None}
    assert order_minhash.near_classes(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"MEMBERS": 7, "FEW_NODES": 3, "MOST_WORDS": 170}])
def test_near_copies_behind_unlike_texts(spark, bounds, monkeypatch):
    """Unlike texts with smaller ids hold the passage of near copies, so the first centre of each sketch is none of theirs."""
    for name, value in bounds.items():
        monkeypatch.setattr(order_minhash, name, value)
    pick = random.Random(8)
    passage = [f"p{k}" for k in range(150)]
    own = lambda n: [f"o{pick.randrange(10**9)}" for _ in range(n)]
    longer = [(k, " ".join(passage + own(75))) for k in range(100)]
    equal = [(200 + k, " ".join(passage[:100] + own(58))) for k in range(20)]  # as long as the copies, but unlike
    copies = [(300 + k, " ".join(passage + own(8))) for k in range(30)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(frame(spark, [*longer, *equal, *copies])).collect()}
    assert got == {doc: doc for doc, _ in [*longer, *equal]} | {doc: 300 for doc, _ in copies}


def test_near_dedup_keeps_unrelated_rows(spark):
    """Rows that share an id keep apart; rows without an id take part; very long texts, repeated rows and clashing columns do no harm."""
    pick = random.Random(12)
    one, other, third, long = (" ".join(f"{x}{pick.randrange(500)}" for _ in range(n)) for x, n in (("a", 60), ("b", 60), ("c", 60), ("d", 80_000)))
    rows = [(1, one), (3, one + " more"), (3, other), (5, other + " more"), (None, third), (None, third + " more"), (None, third.upper()), (7, long), (8, long + " more"), (9, None), (9, None), (10, ""), (1, one)]
    df = frame(spark, rows).withColumnRenamed("key", "_node_key").selectExpr("*", "1 AS root", "2 AS digest")
    got = order_minhash.near_dedup(df)
    assert got.columns == df.columns
    # Of the rows without an id, equal texts are one node, and the smaller of the two nodes stands for the class.
    kept = sorted(((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None), key=str)
    assert kept == sorted([(1, one), (3, other), (7, long), (9, None), (9, None), (10, "")], key=str)
    assert sum(r.doc_id is None for r in got.collect()) == 1 and order_minhash.near_dedup(df.limit(0)).count() == 0
    told = sorted(((r.doc_id, r.copy_of, r.class_id, r.kept) for r in order_minhash.near_classes(frame(spark, rows[:6])).collect()), key=str)
    assert told[:4] == [(1, 1, 1, True), (3, 3, 1, False), (3, 3, 3, True), (5, 5, 3, False)] and [x[:3] for x in told[4:]] == [(None, None, None)] * 2


def test_recall_of_links(spark):
    """Against all pairs: links of five-word shingles of 0.8 or more, and links by edits alone."""
    pick = random.Random(13)
    texts = []
    for _ in range(60):
        base = [f"v{pick.randrange(3000)}" for _ in range(pick.randint(30, 250))]
        texts.append(base)
        for share in (0.01, 0.02, 0.04, 0.08, 0.12):
            words = list(base)
            for _ in range(max(1, int(share * len(words)))):
                k = pick.randrange(len(words))
                words[k : k + pick.choice((0, 1, 1, 1))] = [f"v{pick.randrange(3000)}"]
            texts.append(words)
    shingles = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in texts]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(frame(spark, [(k, " ".join(x)) for k, x in enumerate(texts)])).collect()}
    found = {"shingles": [], "edits": []}
    for a in range(len(texts)):
        for b in range(a):
            if abs(len(texts[a]) - len(texts[b])) <= 0.2 * max(len(texts[a]), len(texts[b])) and shingles[a] & shingles[b]:
                if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                    found["shingles"].append(got[a] == got[b])
                if order_minhash.alike(texts[a], texts[b], 0.8):
                    found["edits"].append(got[a] == got[b])
                else:
                    assert got[a] != got[b] or a // 6 == b // 6
    assert len(found["shingles"]) > 100 and sum(found["shingles"]) >= 0.99 * len(found["shingles"])
    assert len(found["edits"]) > 500 and sum(found["edits"]) >= 0.9 * len(found["edits"])


def test_components(spark):
    pick = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 40)] + [(pick.randrange(100, 160), pick.randrange(100, 160)) for _ in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_pairs_of_two_beyond_the_candidates(spark, monkeypatch):
    """A sketch of two nodes is compared in the first pass alone, so no number of smaller candidates may crowd its pair out."""
    unlike = order_minhash.CENTERS + 2
    base = [f"w{k}" for k in range(40)]
    texts = {k: " ".join(f"x{k}y{i}" for i in range(40)) for k in range(1, unlike + 1)} | {50: " ".join(base), 60: " ".join(["other", *base[1:]])}
    keys = {k: [k] for k in range(1, unlike + 1)} | {50: [50], 60: [*range(1, unlike + 1), 50]}
    rows = [(*order_minhash.node_of(k, plain_words(x.encode())), 40, keys[k]) for k, x in texts.items()]
    monkeypatch.setattr(order_minhash, "signatures", lambda *_: spark.createDataFrame([(bytearray(a), bytearray(b), n, x) for a, b, n, x in rows], "node binary,digest binary,n_words long,keys array<long>"))
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: k for k in texts} | {60: 50}
