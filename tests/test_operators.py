"""Operators whose queries have no SQL twin, on small rows."""

import datetime as dt
import hashlib
import io
import json
import random
import tarfile
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilake.functions import fuzzy, segments, text, times
from vigilake.operators import campaign, gates, history, limits, matching, queue, reports, scoring, trace
from vigilake.sources import archives, feeds, tables
from vigilake.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def rows(df, *names):
    return sorted(tuple(r[x] for x in names) for r in df.collect())


def test_archives(spark):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in (("pkg/a.py", b"1"), ("../../etc/x", b"2"), ("/abs", b"3")):
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
        link = tarfile.TarInfo("pkg/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("w/b.py", "4")
    df = spark.createDataFrame([("a.tar.gz", buffer.getvalue()), ("b.whl", zipped.getvalue()), ("c.zip", b"junk")], "path string, content binary")
    got = {(r.archive, r.path): r.content for r in archives.extract(df).collect()}
    assert {k: bytes(v) for k, v in got.items() if v is not None} == {("a.tar.gz", "pkg/a.py"): b"1", ("a.tar.gz", "etc/x"): b"2", ("b.whl", "w/b.py"): b"4"}
    assert ("c.zip", None) in got
    assert rows(archives.listing(df), "archive", "path") == [("a.tar.gz", "etc/x"), ("a.tar.gz", "pkg/a.py"), ("b.whl", "w/b.py")]
    import base64
    import hashlib

    sri = "sha512-" + base64.b64encode(hashlib.sha512(b"x").digest()).decode()
    downloads = spark.createDataFrame([(1, b"x", sri, None, None), (2, b"y", sri, None, None), (3, b"x", None, None, hashlib.sha1(b"x").hexdigest()), (4, b"x", None, None, None)], "id int, content binary, integrity string, sha256 string, sha1 string")
    assert rows(archives.verified(downloads), "id", "intact") == [(1, True), (2, False), (3, True), (4, False)]


def test_feeds(spark):
    rss = "<rss><item><title>good 1.2.3</title></item><item><title>bad notaversion</title></item><item><title>fresh added to PyPI</title></item></rss>"
    df = spark.createDataFrame([(rss,)], "value string")
    assert rows(feeds.rss_titles(df), "name", "version") == [("good", "1.2.3")]
    assert rows(feeds.new_names(df), "name") == [("fresh",)]
    crates = "<item><title>New crate created: foo</title><link>https://crates.io/crates/foo</link></item><item><title>New crate version published: bar v0.2.0</title></item>"
    items = feeds.crate_items(spark.createDataFrame([(crates,)], "value string"))
    assert rows(items, "name", "version") == [("bar", "0.2.0"), ("foo", "latest")]
    resolved = spark.createDataFrame([("foo", "9.1.0")], "name string, version string")
    known = spark.createDataFrame([("bar",)], "name string")
    assert rows(feeds.resolve_latest(items, resolved, known), "name", "version") == [("foo", "9.1.0")]
    lines = [json.dumps({"Path": "a/b", "Version": "v1.0.0", "Timestamp": "2024-01-01T00:00:00.000005Z"}), json.dumps({"Path": "a/b", "Version": "v0.0.0-20240101000000-abcdef123456"}), "broken"]
    assert rows(feeds.go_index(spark.createDataFrame([(x,) for x in lines], "value string")), "name", "version", "cursor") == [("a/b", "v1.0.0", 1704067200000005)]
    npm = spark.createDataFrame([("5-x", "a", False), ("9-y", "a", False), ("7", "_design/q", False), ("8", "b", True)], "seq string, id string, deleted boolean")
    assert rows(feeds.npm_changes(npm), "seq", "name") == [(9, "a")]
    log = spark.createDataFrame([(1, "n", None, "create"), (2, "n", "1", "new release"), (3, "m", "2", "remove release"), (4, "k", "3", "new release")], "serial long, name string, version string, action string")
    assert rows(feeds.serial_changes(log, 0), "name", "serial", "brand_new") == [("k", 4, False), ("n", 2, True)]
    focus = [(1, "# all"), (2, "[pypi]"), (3, "requests>=2.0,<3"), (4, ""), (5, "[npm]"), (6, "@scope/pkg@^1.2.0  # note"), (7, "left-pad")]
    got = rows(feeds.focus_lines(spark.createDataFrame([("f", *x) for x in focus], "file string, line_no int, line string")), "ecosystem", "name", "version")
    assert sorted(got, key=str) == sorted([("pypi", "requests", "2.0"), ("npm", "@scope/pkg", "1.2.0"), ("npm", "left-pad", None)], key=str)


def test_names_and_versions(spark):
    df = spark.createDataFrame([("99.9.9",), ("2024.1.1",), ("10.10.10",), ("1.2.3",), ("v9.9",), ("120.0.1",), ("x.y",), (None,)], "v string")
    got = {r.v: (r.a, r.b) for r in df.select("v", gates.suspicious_version(F.col("v")).alias("a"), gates.confusion_version(F.col("v")).alias("b")).collect()}
    assert got == {"99.9.9": (True, True), "2024.1.1": (True, False), "10.10.10": (True, True), "1.2.3": (False, False), "v9.9": (True, True), "120.0.1": (True, True), "x.y": (False, False), None: (False, False)}
    scope = spark.createDataFrame([("npm", "@Org/x"), ("npm", "plain"), ("gomod", "github.com/a/b"), ("pypi", "foo-bar"), ("pypi", "x-y"), ("crates", "a-b")], "e string, n string")
    assert [r.s for r in scope.select(gates.scope_of(F.col("e"), F.col("n")).alias("s")).collect()] == ["@org", None, "github.com/a", "foo", None, None]
    names = spark.createDataFrame([("npm", "@org/x"), ("npm", "@orgx/y"), ("pypi", "foo_bar"), ("pypi", "foobar"), ("gomod", "a.io/b/c")], "ecosystem string, name string")
    scopes = spark.createDataFrame([("npm", "@Org"), ("pypi", "foo"), ("gomod", "a.io/b")], "ecosystem string, scope string")
    assert rows(gates.in_scope(names, scopes), "name") == [("@org/x",), ("a.io/b/c",), ("foo_bar",)]
    top = spark.createDataFrame([("requests", 1), ("numpy", 2), ("my.pkg", 3)], "name string, rank long")
    tried = spark.createDataFrame([(x,) for x in ("requests", "request", "reqeusts", "num-py", "python-numpy", "numpy-sdk", "mypkg", "zzz")], "name string")
    got = {r.name: (r.rule_id.split("_")[1], r.target) for r in matching.typosquats(tried, top).collect()}
    assert got == {"request": ("candidate", "requests"), "num-py": ("candidate", "numpy"), "python-numpy": ("prefix", "numpy"), "numpy-sdk": ("suffix", "numpy"), "mypkg": ("candidate", "my.pkg")}


def test_history(spark):
    schema = "name string, version string, published_at timestamp, scripts map<string,string>, size long, file_count int, publisher string"
    day = lambda k: T0 + dt.timedelta(days=k)
    versions = [("a", "1", day(1), {}, 10, 5, "p"), ("a", "2", day(2), {"postinstall": "node x.js"}, 10, 5, "p"), ("b", "1", day(1), None, 10, 5, "p"), ("b", "2", day(2), None, 10, 50, "p"), ("c", "1", day(1), None, 10, 5, "p"), ("c", "2", day(2), None, 40, 5, "q")]
    got = {r.name: (r.flags, r.priority) for r in history.packument_anomalies(spark.createDataFrame(versions, schema)).collect()}
    assert got == {"a": ("hook_added,bundled_exec", "high"), "c": ("size_jump,publisher_change", "high")}
    pairs = spark.createDataFrame([("p", "A", "a@x", "B", "b@x", ["1", "2", "3", "4"], ["1"]), ("q", "A", "", "a", None, ["1"], [])], "package string, author string, author_email string, prev_author string, prev_author_email string, deps array<string>, prev_deps array<string>")
    assert rows(history.metadata_diff(pairs), "package", "rule_id") == [("p", "version_diff.author_changed"), ("p", "version_diff.dependency_spike")]
    files = spark.createDataFrame([("p", "wheel", "p/a.py"), ("p", "wheel", "p/b.so"), ("p", "wheel", "p/_version.py"), ("p", "sdist", "p/a.py"), ("q", "wheel", "z.py")], "package string, archive_kind string, path string")
    assert rows(history.archive_mismatch(files), "package", "missing") == [("p", "b.so")]


def test_queue(spark):
    fresh = spark.createDataFrame([("aa", None, "c1")], "sha256 string, ssdeep string, campaign string")
    seeds = spark.createDataFrame([("aa", "3:x:y", "c2"), ("bb", None, "c3")], "sha256 string, ssdeep string, campaign string")
    assert rows(queue.seed_merge(fresh, seeds), "sha256", "campaign") == [("aa", "c1"), ("bb", "c3")]
    changes = spark.createDataFrame([(10,), (20,)], "seq long")
    held = spark.createDataFrame([(15, 1), (12, 5)], "seq long, attempts int")
    assert queue.hold_back(changes, held).first().cursor == 14
    assert queue.hold_back(changes, held.limit(0)).first().cursor == 20
    q = spark.createDataFrame([(1, "pending", 0, None, None), (2, "done", 1, None, None)], "id long, status string, attempts int, claim_token string, claimed_at timestamp")
    got = rows(queue.claim(q, q.select("id"), "t", F.lit(T0)), "id", "status", "attempts")
    assert got == [(1, "claimed", 1), (2, "done", 1)]
    weights = spark.createDataFrame([("high", "a", 0.7), ("high", "b", 0.3)], "priority string, ecosystem string, weight double")
    assert rows(queue.weighted_order(weights, 1), "place") == [(1,), (2,)]
    sweeps = spark.createDataFrame([("npm", "m", T0, 1), ("npm", "m", T0 + dt.timedelta(minutes=30), 2), ("npm", "m", T0 + dt.timedelta(hours=2), 3)], "ecosystem string, maintainer string, at timestamp, scan_id long")
    assert rows(campaign.deduped_sweeps(sweeps), "scan_id", "first") == [(1, True), (2, False), (3, True)]
    steady = spark.createDataFrame([("npm", "mM"[k % 2], T0 + dt.timedelta(minutes=50 * k), k) for k in range(5)], "ecosystem string, maintainer string, at timestamp, scan_id long")
    assert rows(campaign.deduped_sweeps(steady), "scan_id", "first") == [(0, True), (1, False), (2, True), (3, False), (4, True)]
    candidates = spark.createDataFrame([("npm", f"n{k}", T0 + dt.timedelta(seconds=k)) for k in range(5)], "ecosystem string, name string, at timestamp")
    watch = spark.createDataFrame([("npm", "n0", 9_999_999), ("npm", "n1", 5)], "ecosystem string, name string, rank long")
    blocked = spark.createDataFrame([("npm", "n2")], "ecosystem string, name string")
    got = rows(campaign.promotion_status(candidates, watch, blocked, per_hour=1), "name", "status")
    assert got == [("n0", "refreshed"), ("n1", "already_popularity"), ("n2", "blocklisted"), ("n3", "added"), ("n4", "rate_limited")]


def test_trace(spark):
    lines = [
        json.dumps({"time": "2024-01-01T00:00:01Z", "process_exec": {"process": {"pid": 1, "binary": "/usr/bin/node", "arguments": "x.js", "docker": "abc123"}}}),
        json.dumps({"time": "2024-01-01T00:00:02Z", "process_kprobe": {"function_name": "tcp_connect", "process": {"pid": 1, "binary": "n", "docker": "abc"}, "args": [{"sock_arg": {"daddr": "93.184.216.34", "dport": 443, "family": "AF_INET"}}]}}),
        json.dumps({"time": "2024-01-01T00:00:03Z", "process_kprobe": {"function_name": "security_file_open", "process": {"pid": 1, "binary": "n", "docker": "abc123"}, "args": [{"string_arg": "/root/.npmrc"}]}}),
        json.dumps({"process_exec": {"process": {"docker": "other"}}}), "junk",
    ]
    events = trace.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"), ("abc123",))
    assert rows(events, "category", "operation") == [("file", "open"), ("network", "connect"), ("process", "exec")]
    full = events.withColumns({"detonation_id": F.lit(1), "event_id": F.monotonically_increasing_id(), "phase": F.lit("install"), "name": F.lit(None).cast("string"), "hostname": F.lit("x.workers.dev")})
    kept = trace.drop_noise(full, paths=("/usr/lib",), binaries=("node",), hosts=("workers.dev",), abuse=("workers.dev",))
    assert rows(kept, "category", "abuse_host") == [("file", False), ("network", True), ("process", False)]
    got = {r.rule_id for r in trace.dynamic_findings(kept, canaries=("npmrc",)).collect()}
    assert got == {"dyn_install_exfil", "dyn_abuse_hosting_callback", "dyn_credential_read", "dyn_honeytoken_exfil"}
    addresses = [("10.1.2.3", 443.0, False), ("127.0.0.1", 1.0, False), ("8.8.8.8", 53.0, False), ("8.8.8.8", 443.0, True), ("::1", 1.0, False), ("fe80::1", 1.0, False), ("2001:db8::1", 1.0, True), ("junk", 1.0, True), (None, None, True)]
    df = spark.createDataFrame(addresses, "a string, p double, want boolean")
    assert df.where(~trace.is_external(F.col("a"), F.col("p")).eqNullSafe(F.col("want"))).count() == 0
    hosts = spark.createDataFrame([("a.b.c", "b.c", True), ("xb.c", "b.c", False), ("b.c", "=b.c", True), ("a.b.c", "=b.c", False)], "h string, p string, want boolean")
    assert hosts.where(trace.host_matches(F.col("h"), F.col("p")) != F.col("want")).count() == 0


def test_piecewise_hash_by_single_steps():
    """The hash in passes over bytes is that of one step for each byte, also of texts shorter than the window."""

    def pieces(data, block, most):
        out, h, fresh = "", 0x28021967, True
        for k, x in enumerate(data):
            h, fresh, last = h * 0x01000193 & 0xFFFFFFFF ^ x, False, data[max(0, k - 6) : k + 1][::-1]
            shifted = 0
            for back, y in enumerate(last):
                shifted ^= y << 5 * back
            if (sum(last) + sum((7 - back) * y for back, y in enumerate(last)) + (shifted & 0xFFFFFFFF)) % block == block - 1 and len(out) < most - 1:
                out, h, fresh = out + fuzzy.ALPHABET[h & 63], 0x28021967, True
        return out if fresh else out + fuzzy.ALPHABET[h & 63]

    def slow(data):
        block = 3
        while block * 64 < len(data):
            block *= 2
        while block > 3 and len(pieces(data, block, 64)) < 32:
            block //= 2
        return f"{block}:{pieces(data, block, 64)}:{pieces(data, 2 * block, 32)}"

    some = random.Random(5)
    for size in (*range(9), 63, 64, 65, 191, 192, 193, 1000, 5000):
        for data in (some.randbytes(size), bytes(size), b"\xff" * size, (b"abc " * size)[:size], bytes(some.choices(b"etaoin shrdlu", k=size))):
            assert fuzzy.ctph(data) == slow(data), (size, data[:20])


def test_fuzzy(spark):
    pick = random.Random(1)
    data = bytes(pick.randrange(97, 123) for _ in range(4000))
    near = data[:2000] + b"changed here" + data[2000:]
    other = bytes(pick.randrange(97, 123) for _ in range(4000))
    assert fuzzy.similarity(fuzzy.ctph(data), fuzzy.ctph(data)) == 100 and fuzzy.similarity(fuzzy.ctph(data), fuzzy.ctph(near)) >= 70
    assert fuzzy.similarity(fuzzy.ctph(data), fuzzy.ctph(other)) == 0
    assert fuzzy.distance(fuzzy.tlsh(data), fuzzy.tlsh(data)) == 0 and fuzzy.distance(fuzzy.tlsh(data), fuzzy.tlsh(near)) < 40 < fuzzy.distance(fuzzy.tlsh(data), fuzzy.tlsh(other))
    assert fuzzy.tlsh(b"short") is None and fuzzy.ctph(b"") == "3::"
    df = spark.createDataFrame([(1, data), (2, near), (3, other), (4, None)], "file_id long, content binary")
    hashed = df.select("file_id", F.lit("s").alias("sha256"), fuzzy.ctph_hash("content").alias("ssdeep"), fuzzy.tlsh_hash("content").alias("tlsh"), fuzzy.byte_entropy("content").alias("entropy"))
    prints = hashed.where("file_id = 1").select(F.lit("seed").alias("sha256"), F.lit("camp").alias("campaign"), "ssdeep", "tlsh", F.lit("manual").alias("source"))
    assert rows(matching.fuzzy_matches(hashed, prints), "file_id", "campaign", "kind") == [(1, "camp", "ssdeep"), (2, "camp", "ssdeep")]


def test_text(spark):
    df = spark.createDataFrame([("https://User@Evil.Example.io:80/a?b", "aab")], "u string, t string")
    r = df.select(text.url_host(F.col("u")).alias("h"), text.defang(F.col("u")).alias("d"), F.round(text.char_entropy("t"), 4).alias("e"), text.printable_ratio(F.lit("a\x00")).alias("p"), times.cursor_micros(F.lit("2024-01-01T00:00:00.000005Z")).alias("c")).first()
    assert (r.h, r.e, r.p, r.c) == ("evil.example.io", 0.9183, 0.5, 1704067200000005) and r.d.startswith("hxxps://") and "[.]" in r.d
    assert spark.range(1).select(times.cursor_text(F.lit(1704067200000005))).first()[0] == "2024-01-01T00:00:00.000005Z"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("npm", "a\x00b", ["x\x00"], {"k": "\x00v"}, 1)], "ecosystem string, s string, a array<string>, m map<string,string>, n int")
    tables.write_table(df, str(tmp_path), "t")
    r = tables.read_table(spark, str(tmp_path), "t").first()
    assert (r.s, r.a, r.m, r.ecosystem) == ("ab", ["x"], {"k": "v"}, "npm")
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, v string, at int")
    assert rows(tables.upserted(old, new, ["id"], "at"), "id", "v") == [(1, "c"), (2, "b"), (3, "e")]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    told = [{"ecosystem": "npm", "name": n, "version": "1", "priority": "normal", "at": "2024-01-01T00:00:00Z"} for n in ("a", "b", "a")]
    (source / "1.json").write_text("\n".join(map(json.dumps, told)))
    watch = spark.createDataFrame([("npm", "a")], "ecosystem string, name string")
    stream = ingest.gated(ingest.first_seen(ingest.change_stream(spark, str(source))), watch)
    ingest.run_once(stream, str(tmp_path / "c1"), "seen")
    assert rows(spark.table("seen"), "name", "priority") == [("a", "high"), ("b", "normal")]
    events = tmp_path / "ev"
    events.mkdir()
    kinds = [("claimed", 1), ("failed", 2), ("claimed", 3), ("done", 4)]
    (events / "1.json").write_text("\n".join(json.dumps({"ecosystem": "npm", "name": "a", "version": "1", "kind": k, "at": f"2024-01-01T00:00:0{s}Z"}) for k, s in kinds))
    read = lambda: ingest.change_stream(spark, str(events), ingest.QUEUE_EVENTS)
    ingest.run_once(ingest.retries(read()), str(tmp_path / "c2"), "state", "update")
    assert rows(spark.table("state"), "name", "status", "attempts") == [("a", "done", 2)]
    ingest.run_once(ingest.throughput(read()), str(tmp_path / "c3"), "hours", "update")
    assert sum(r.n for r in spark.table("hours").collect()) == 4
    batch = spark.read.schema(ingest.QUEUE_EVENTS).json(str(events))
    assert rows(ingest.latest_state(batch), "name", "status") == [("a", "done")]


def test_admitted_against_brute_force(spark):
    pick = random.Random(3)
    told = sorted((T0 + dt.timedelta(seconds=60 * pick.randrange(400)), k, pick.choice("aB")) for k in range(500))
    df = spark.createDataFrame([(key, at, k) for at, k, key in told] + [("a", None, 999)], "key string, at timestamp, id long")
    for limit, closed in ((1, False), (3, True), (0, True)):
        held, want = {}, {999: False}
        for at, k, key in told:
            near = [x for x in held.get(key, ()) if (at - x).total_seconds() < 1800 + closed]
            want[k] = len(near) < limit
            held[key] = [*near, at] if want[k] else near
        assert {r.id: r.allowed for r in limits.admitted(df, ["key"], "at", "id", 1800, limit, closed).collect()} == want


def test_places(spark):
    pick = random.Random(5)
    told = [(pick.choice([None, "a", "b"]) if pick.random() < 0.3 else "a", pick.randrange(30), k) for k in range(400)]
    df = spark.createDataFrame(told, "g string, x long, id long")
    got = {r.id: r.place for r in queue.placed(df, [F.col("g")], [F.desc("x"), F.col("id")]).collect()}
    want = {}
    for g in (None, "a", "b"):
        want |= {k: n for n, (_, _, k) in enumerate(sorted((y for y in told if y[0] == g), key=lambda y: (-y[1], y[2])), 1)}
    assert got == want


def test_places_of_many_rows(spark):
    """Ranges are sampled from large inputs, and branches that read different columns must still agree on them."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(100_000).select("id", F.when(F.col("id") % 7 < 4, "a").when(F.col("id") % 7 < 6, "b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("x"), F.repeat(F.lit("y"), 40).alias("wide"))
        got = queue.placed(df, [F.col("g")], [F.desc("x"), F.col("id")]).select("id", "g", "place")
        want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"), "id")).cast("long").alias("want"))
        told = got.join(want, "id")
        assert (told.count(), told.where("place <> want").count()) == (100_000, 0)
        cut = queue.over_cap(df, "g", "x", 900).select("id")
        old = df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"), F.desc("id")))).where("p > 900").select("id")
        assert cut.count() == old.count() and cut.exceptAll(old).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_broken_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as made:
        made.writestr("a.py", "x = 1\n" * 50)
        made.writestr("b.py", "y = 2\n" * 50)
    good = buffer.getvalue()
    second = good.index(b"b.py") + 4
    locked = bytearray(good)
    for at in (6, good.index(b"PK\x01\x02") + 8):
        locked[at] |= 1
    rotten = good[: second] + b"\xff" * 8 + good[second + 8 :]
    rows_ = [("good.whl", good), ("locked.zip", bytes(locked)), ("rotten.whl", rotten), ("none.zip", None), ("junk.tar.gz", b"junk")]
    got = archives.extract(spark.createDataFrame(rows_, "path string, content binary")).collect()
    assert sorted((r.archive, r.path) for r in got if r.error is None) == [("good.whl", "a.py"), ("good.whl", "b.py")]
    assert {r.archive for r in got if r.error} == {"locked.zip", "rotten.whl", "none.zip", "junk.tar.gz"}


def test_decoded_and_metadata_findings(spark):
    import base64

    from vigilake.operators import metadata
    from vigilake.operators.decoded import decoded_findings

    hide = lambda x: base64.b64encode(x).decode()
    files = [
        (1, "a.js", "x = '" + hide(b"go http://c2.odd.dev/x now") + "'"), (2, "a.js", "x = '" + hide(b"see https://github.com/a/b or 10.0.0.1") + "'"), (3, "b.go", "y = '" + b"call 93.184.216.34 now!".hex() + "'; exec.Command(x)"),
        (4, "c.py", "os.system(z); z = '" + hide(b"\x7fELF" + b"\0" * 60) + "'"), (5, "tests/c.py", "z = '" + hide(b"\x7fELF" + b"\0" * 60) + "'"), (6, "d.js", "'" + hide(b"eval(require('child_process').exec('id'))") + "'"), (7, "README.md", hide(b"go http://c2.odd.dev/x now")), (8, "e.js", None),
    ]
    got = {(r.scan_id, r.rule_id.split(".")[1], r.severity) for r in decoded_findings(spark.createDataFrame(files, "scan_id long, path string, text string")).collect()}
    assert got == {(1, "encoded_url", "medium"), (3, "encoded_ip", "high"), (4, "decoded_executable", "critical"), (5, "decoded_executable", "low"), (6, "decoded_code", "high")}
    releases = [(1, "a/b", "1.0", T0, None, ["A"], []), (2, "github.z9.workers.dev/m", "10.10.10", T0, T0 - dt.timedelta(hours=23), ["A"], ["a"]), (3, "gitlab.arm.com/m", "2024.1.1", T0, T0 - dt.timedelta(hours=25), ["a", "b"], ["a"]), (4, None, None, None, None, None, None)]
    df = spark.createDataFrame(releases, "scan_id long, name string, version string, published_at timestamp, prev_published_at timestamp, maintainers array<string>, prev_maintainers array<string>")
    got = {(r.scan_id, r.rule_id.split(".")[1]) for r in metadata.metadata_findings(df).collect()}
    assert got == {(2, "gomod_impersonating_forge_host"), (2, "dependency_confusion_version"), (2, "rapid_release"), (3, "maintainer_change")}
    loads = spark.createDataFrame([(1, "x.whl", False, 2), (2, "y", True, 1), (3, "", False, 0)], "scan_id long, path string, intact boolean, n_files int")
    assert {(r.scan_id, r.rule_id) for r in metadata.download_findings(loads).collect()} == {(1, "fetch.sha256_mismatch"), (3, "fetch.no_release_files")}


def test_decoded_findings_read_a_file_once(spark, capsys):
    """Layers, single runs and calls come from one reading of a file; a call in another row of the same file counts, one without a key doesn't."""
    import base64

    from vigilake.operators.decoded import FILE_SINK, decoded_findings, runs_something

    hide = lambda x: base64.b64encode(x).decode()
    binary = "z = '" + hide(b"\x7fELF" + b"\0" * 60) + "'"
    files = [
        (1, "a.py", binary), (1, "a.py", "OS.System(x)"), (2, "a.py", binary), (3, "a.py", "os.system(x)"), (None, "a.py", binary + " os.system(x)"), (4, "b.js", "s = '" + "".join(f"\\x{x:02x}" for x in b"go http://c4.odd.dev/x") + "'"),
        (5, "c.go", "\u00e4" * 9 + hide(b"at 93.184.216.34 now") + "\u00e4"), (6, "d.js", "nothing spawned here"), (7, "e.js", hide(b"go http://c7.odd.dev/x now") + " " + "word" * 9),
    ]
    found = decoded_findings(spark.createDataFrame(files, "scan_id long, path string, text string"))
    found.explain()
    assert capsys.readouterr().out.count("Scan ") == 1
    calls = ["exec.Command(", "SYSCALL.ForkExec (", "os/exec", "child_process", "a.execFile(", "Spawn(", "spawnSync\t(", "EXECSYNC", "os.system", "subprocess.run", "CreateProcess", "ShellExecute", "winexec", "exec(x)", "a process", "os.systen", None]
    sinks = spark.createDataFrame([(x,) for x in calls], "text string").select("text", runs_something("text").alias("is"), F.col("text").rlike(FILE_SINK).alias("want")).collect()
    assert [r["is"] for r in sinks] == [r.want for r in sinks] == [True] * 13 + [False] * 3 + [None]
    got = [(r.scan_id, r.rule_id.split(".")[1], r.severity, r.evidence) for r in found.collect()]
    told = "an executable behind base64"
    assert sorted(got, key=str) == sorted([
        (1, "decoded_executable", "critical", told), (2, "decoded_executable", "medium", told), (None, "decoded_executable", "medium", told), (4, "encoded_url", "medium", "decoded: http://c4.odd.dev/x"),
        (5, "encoded_ip", "high", "decoded: 93.184.216.34"), (7, "encoded_url", "medium", "decoded: http://c7.odd.dev/x"),
    ], key=str)


def test_carry_forward_matches_by_path_and_safe_base_name(spark):
    def files(*some):
        return spark.createDataFrame([("p", path, sha) for path, sha in some], "package string, path string, sha256 string")

    def found(*some):
        return spark.createDataFrame([("p", rule, file, "e") for rule, file in some], "package string, rule_id string, file string, evidence string")

    prior = found(("r1", "a/x.js"), ("r2", "package/a/x.js"), ("r2", "a/x.js"), ("r3", "y.js"), ("r4", "z.js"), ("r5", ""), ("r6", None), ("r7", "old/y.js"), ("r8", "a/x.js"), ("r9", "new.js"))
    before = files(("a/x.js", "1"), ("a/y.js", "2"), ("a/z.js", "3"), ("b/z.js", "4"))
    now = files(("a/x.js", "1"), ("a/y.js", "2"), ("a/z.js", "3"), ("b/z.js", "5"), ("c/x.js", "6"), ("d/new.js", "7"))
    got = history.carry_forward(prior, before, now, found(("r8", "package/a/x.js")))
    # The new c/x.js makes the base name x.js unsafe, its own path is still the same; z.js has changed in one folder.
    assert rows(got, "rule_id", "file") == [("r1", "a/x.js"), ("r2", "a/x.js"), ("r3", "y.js"), ("r7", "old/y.js")]
    assert history.carry_forward(prior.limit(0), before, now, prior).count() == 0


def test_prior_scans_within_the_window(spark):
    at = lambda day: T0 + dt.timedelta(days=day)
    scans = spark.createDataFrame([("npm", "a", 1, at(0)), ("npm", "a", 2, at(5)), ("npm", "a", 3, at(5)), ("npm", "a", 4, at(8)), ("npm", "b", 5, at(0)), ("npm", "c", 6, None)], "ecosystem string, name string, scan_id long, finished_at timestamp_ntz")
    current = scans.where("scan_id IN (4, 5, 6)")
    assert rows(history.prior_scans(scans, current, F.lit(at(8)).cast("timestamp_ntz")), "scan_id", "prior_id") == [(4, 3)]


def test_function_segments(spark):
    python = "class A:\n    def f(self):\n        return 'ä'\n\n    async def g(self): pass\n"
    other = "export function one(a) {\n  if (a) { b }\n}\nfunc (r *T) Two() {}\nconst x = 1\ny = (a) => { c }\nfn three() { open {\n"
    df = spark.createDataFrame([(1, "a.py", python), (2, "b.js", other), (3, "c.py", "def ("), (4, "d.go", None), (5, "e.js", "}} {{" * 50_000), (6, "f.py", "")], "scan_id long, path string, text string")
    got = segments.function_segments(df)
    assert rows(got.where("scan_id = 1"), "name", "kind", "line", "end_line") == [("A", "ClassDef", 1, 5), ("f", "FunctionDef", 2, 3), ("g", "AsyncFunctionDef", 5, 5)]
    # The fixed pattern takes a condition with a block for a declaration, too.
    assert rows(got.where("scan_id = 2"), "name", "line", "end_line") == [("Two", 4, 4), ("if", 2, 2), ("one", 1, 3), ("three", 7, 8), ("y", 6, 6)]
    assert rows(got.where("name = 'f'"), "sha256") == [(hashlib.sha256("def f(self):\n        return 'ä'".encode()).hexdigest(),)]
    assert rows(got.where("scan_id > 2"), "scan_id", "kind") == [(3, "unparsed")]



def test_segments_come_in_batches():
    """Segments of many small files share a batch, many large ones don't; definitions are found wherever statements are held."""
    import ast

    import pyarrow as pa

    def found(texts, path="a.py"):
        given = pa.RecordBatch.from_pydict({"scan_id": list(range(len(texts))), "path": [path] * len(texts), "text": texts}, schema=pa.schema([("scan_id", pa.int64()), ("path", pa.string()), ("text", pa.string())]))
        return list(segments.segments_of(iter([given, given])))

    small = found([f"def f{k}(): pass" for k in range(segments.MOST_ROWS)] + [None, "x = 1"])
    assert [x.num_rows for x in small] == [segments.MOST_ROWS] * 2 and small[1].column("name")[-1].as_py() == f"f{segments.MOST_ROWS - 1}"
    assert [x.num_rows for x in found(["function f() {" + " " * segments.MOST_BYTES + "}", "function g() {}"], "a.js")] == [1, 2, 1]
    held = "if a:\n  def a(): pass\nelif b:\n  def b(): pass\nelse:\n  def c():\n    class D: pass\ntry:\n  def e(): pass\nexcept* E:\n  async def f(): pass\nelse:\n  def g(): pass\nfinally:\n  def h(): pass\n"
    held += "for x in y:\n  def i(): pass\nelse:\n  def j(): pass\nwhile x:\n  def k(): pass\nwith x:\n  def l(): pass\nmatch x:\n  case 1 if (lambda: 1):\n    def m(): pass\ntry:\n  pass\nexcept E:\n  def n(): pass\n"
    want = [x.name for x in ast.walk(ast.parse(held)) if isinstance(x, segments.DEFINITIONS)]
    assert [x[0] for x in segments.by_tree(held)] == want and len(want) == 14


def test_kept_archives_and_campaigns(spark):
    df = spark.createDataFrame([(1, "malicious", None), (2, "malicious", "benign"), (3, "clean", "malicious"), (4, "suspicious", None)], "scan_id long, verdict string, llm_verdict string")
    assert rows(scoring.kept_archives(df), "scan_id", "keep") == [(1, True), (2, False), (3, True), (4, False)]
    prints = spark.createDataFrame([(1, "auto:npm:x", "auto"), (2, "auto:npm:x", "promoted"), (3, "auto:npm:x", "manual"), (4, "x", "auto"), (5, None, "auto"), (6, "auto:npm:xy", "auto")], "id long, campaign string, source string")
    assert rows(reports.promote_campaign(prints, "x").where("source = 'promoted'"), "id") == [(1,), (2,)]
    assert rows(reports.remove_campaign(prints, "x"), "id") == [(3,), (4,), (5,), (6,)]


def test_canonical_names(spark):
    held = spark.createDataFrame([("gomod", "a", 1), ("gomod", "b", 2), ("gomod", "c", 3), ("gomod", "d", 4), ("npm", "a", 5)], "ecosystem string, name string, rank long")
    renames = spark.createDataFrame([("gomod", "a", "b"), ("gomod", "c", "z"), ("gomod", "d", "z"), ("gomod", "q", "r")], "ecosystem string, original string, canonical string")
    assert rows(queue.canonical_names(held, renames), "ecosystem", "name", "rank") == [("gomod", "b", 2), ("gomod", "z", 3), ("npm", "a", 5)]
