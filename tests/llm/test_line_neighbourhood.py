"""Line dedup against all pairs of lines."""

import random

import pytest

from vigilake.llm import line_neighbourhood
from vigilake.llm.line_neighbourhood import dedup_lines, least_length, within_one

SCHEMA = "doc_id long, text string, id string, line int"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, similarity=0.8):
    """doc_id -> (kept text, lines with a word, removed, removed by no equal line), for distinct ids."""
    lines = [((float("inf") if doc is None else doc, k), line.strip(" \t\n\x0b\x0c\r")) for doc, text in rows for k, line in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[1]]
    gone, near = set(), set()
    for place, line in lines:
        if any(other < place and line == said for other, said in lines):
            gone.add(place)
        elif any(other < place and 1 <= (1 - similarity) * max(len(said), len(line)) + 1e-9 and abs(len(said) - len(line)) < 2 and within_one(line, said) for other, said in lines):
            gone.add(place)
            near.add(place)
    out = {}
    for doc, text in rows:
        at = float("inf") if doc is None else doc
        split = (text or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(split) if (at, k) not in gone)
        out[doc] = (kept, sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in split), sum(x[0] == at for x in gone), sum(x[0] == at for x in near))
    return out


def run(spark, rows, **bounds):
    df = spark.createDataFrame([(doc, text, "x", 3) for doc, text in rows], SCHEMA)
    return {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_near) for r in dedup_lines(df, **bounds).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_matches_all_pairs(spark, seed):
    pick = random.Random(seed)
    seeds = ["".join(pick.choice("abc é") for _ in range(pick.choice((2, 4, 5, 6, 9, 14, 22)))) for _ in range(12)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(pick.randint(0, 5)):
            line = list(pick.choice(seeds))
            for _ in range(pick.choice([0, 1, 1, 2])):
                k, what = pick.randrange(len(line)), pick.randrange(3)
                line[k : k + 1] = [[], [pick.choice("abc é")], [line[k], pick.choice("abz")]][what]
            lines.append(pick.choice(["", " "]) + "".join(line))
        rows.append((doc if doc else None, "\n".join(lines)))
    for similarity in (0.8, 0.9, 0.0):
        assert run(spark, rows, least_parts=5, similarity=similarity) == brute(rows, similarity)
    assert sum(x[3] for x in brute(rows).values()) > 5 and [least_length(x) for x in (0.8, 0.9, 0.0, 0.75)] == [5, 10, 1, 4]


def test_blocks(spark, monkeypatch):
    """Texts in many blocks, with halves that many lines share."""
    monkeypatch.setattr(line_neighbourhood, "BLOCK_BYTES", 100)
    pick = random.Random(4)
    rows = [(k, "\n".join(f"2024-01-01 INFO {pick.randrange(10**6):06d} done" for _ in range(3)) + "\nsame\n" + pick.choice("ab") * 5) for k in range(150)]
    assert run(spark, rows, least_parts=3) == brute(rows)


def test_within_one():
    pick = random.Random(0)
    for _ in range(5000):
        a, b = ("".join(pick.choice("ab") for _ in range(pick.randint(0, 6))) for _ in range(2))
        assert within_one(a, b) == (distance(a, b) <= 1)


def test_edge_cases(spark):
    long = ("word " * 20_000).strip()
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, long), (5, long + "x\nshort"), (6, "short\nshorx"), (7, "a line of some length\ra line"), (None, "short")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[5] == ("short", 2, 1, 1)
    assert got[6] == ("", 2, 2, 1)


def test_repeated_rows_and_carried_columns(spark):
    df = spark.createDataFrame([(1, "the very same line here", "x", 1), (1, "the very same line here", "y", 2), (2, "the very same line here", None, None)], SCHEMA)
    out = dedup_lines(df, carry=("id", "line"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed", "n_near", "id", "line"]
    assert sorted((r.doc_id, r.text, r.id or "") for r in out.collect()) == [(1, "the very same line here", "x"), (1, "the very same line here", "y"), (2, "", "")]
    assert dedup_lines(df.limit(0)).count() == 0
