"""Main text of web pages, by differencing against the page of the nearest URL, with the help of markup.

A page becomes lines, one for each block element: character references decoded, white space turned into single spaces, blocks without text left out. Scripts,
styles and other content that is never shown give no lines; everything else does, menus and footers included.

Differencing: within each host, pages of equal lines are copies, and count as one page under the first of their paths. These pages are
ordered by path, and each is paired with the page before it (the first of a host with the next). The lines of the two are aligned by a
longest common subsequence; lines in common belong to the site rather than to the page, and are deleted, from all copies alike. A page whose host holds
nothing but copies of it has no partner.

Markup helps where lines alone can't tell. Articles quote each other, so shared lines inside an element that a page marks as its article or main part stay.
Adverts, comments and notices are often unlike from page to page, so lines go too where the markup names them: elements for navigation, asides, footers, forms and
dialogs, by tag or role, and containers whose class is such a word in whole (NOISE_WORDS, with a word like box or list beside it at most). Headings, paragraphs and inline
elements are never judged by their class, nothing inside the main part by its id. Where a main part is marked, lines outside it go.

The order over all pages is that of a range partitioning of slim rows (URL and hashes of lines), so a host with a third of all pages is
spread over many tasks; the last row of each task's range is handed to the next one, one row for each partition.

Rows: one for each input row. Null or empty html gives an empty text; a page without a URL has no partner; pages that agree in
id, url and html get the same text. A null id stays null. Unclosed elements end with their parent or the page. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import decoded, raw, shared_checkpoint, table, to_arrow
from vigilake.llm.pieces import packed_text

#: Cells of an alignment that are held at once; larger ones are divided.
CELLS = 200_000_000

RAW = frozenset("script style textarea title noscript iframe xmp noembed template".split())
UNSHOWN = frozenset("svg object canvas head video audio map".split()) | RAW
NOISE_TAGS = frozenset("nav footer aside form button select option label input dialog menu".split()) | UNSHOWN
CONTAINERS = frozenset("div section ul ol dl table details header figure fieldset center dir td".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar aside nav navbar navigation menu breadcrumb breadcrumbs
    masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share
    sharing social related recommended comment comments disqus reply replies respond pagination pager search copyright""".split()
)
#: Words that may stand beside one of them in a class: they name a container and nothing else.
BESIDE = frozenset("box bar list block container wrapper wrap section area banner links link buttons button form slot unit top bottom left right site page main".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
#: A tag from its name on, quotes included; and without regard to quotes.
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


OWN, PLAIN, NOISE, HIDDEN_LINE = 0, 1, 2, 3


def names_noise(value: str) -> bool:
    """Whether one of the names in a class or id says noise, and nothing else."""
    for name in value.split():
        words = {x.lower() for x in WORDS.findall(name)}
        if words & NOISE_WORDS and words <= NOISE_WORDS | BESIDE:
            return True
    return False


def kind_of(name: str, attributes: str, inside_main: bool) -> int:
    """What an element's own markup says of its lines: PLAIN, NOISE, or HIDDEN_LINE for content that isn't shown."""
    if name in UNSHOWN:
        return HIDDEN_LINE
    kind = NOISE if name in NOISE_TAGS or name == "header" and not inside_main else PLAIN
    if not attributes or name in ("html", "body"):
        return kind
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((x for x in values if x), "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return HIDDEN_LINE
        named = (key == "class" or key == "id" and not inside_main) and name in CONTAINERS and names_noise(value)
        if named or key == "role" and value.lower() in NOISE_ROLES:
            kind = NOISE
    return kind


def is_main(name: str, attributes: str) -> bool:
    return name in MAIN_TAGS or "role" in attributes and any(key.lower() == "role" and (a or b or c).lower() in MAIN_ROLES for key, a, b, c in ATTRIBUTE.findall(attributes))


def lines_of(page: str) -> list[tuple[str, int]]:
    """The lines of a page, each with what markup says of it: OWN (of a marked main part), PLAIN or NOISE. In time linear in the page."""
    lines: list[tuple[str, int]] = []
    said: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, kind, within main
    blocks: list[int] = []  # where the stack holds blocks
    opened: Counter = Counter()  # names on the stack
    at, kind, main, pattern = 0, PLAIN, False, TAG

    def close() -> None:
        if said:
            if text := " ".join(html.unescape("".join(said)).split()):
                lines.append((text, OWN if main and kind == PLAIN else kind))
            said.clear()

    def pop() -> None:
        nonlocal kind, main
        opened[stack.pop()[0]] -= 1
        while blocks and blocks[-1] >= len(stack):
            blocks.pop()
        _, kind, main = stack[-1] if stack else ("", PLAIN, False)

    def say(end: int) -> None:
        if kind != HIDDEN_LINE and end > at:
            said.append(page[at:end])

    while (start := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), start):
            say(start)
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + (4 if mark == "-->" else 2))
            at = end + len(mark) if end >= 0 else len(page)
            continue
        found = pattern.match(page, start + 1)
        if not found and pattern is TAG and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
            pattern = PLAIN_TAG  # quotes don't end: from here on they aren't looked at
            found = pattern.match(page, start + 1)
            if not found:  # no tag ends here or further on
                break
        if not found:
            say(start + 1)
            at = start + 1
            continue
        say(start)
        at, name = found.end(), found[2].lower()
        if name in BLOCKS:
            close()
        elif name == "br" and kind != HIDDEN_LINE:
            said.append(" ")
        if found[1]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in BLOCKS and blocks:  # an open paragraph ends before a block, an open item before the next
            top = stack[blocks[-1]][0]
            if top == "p" or name == top == "li":
                k = blocks[-1]
                while len(stack) > k:
                    pop()
        if name in RAW:
            end = _raw_end(name).search(page, at)
            at = end.start() if end else len(page)
        if not found[3].rstrip().endswith("/") or name in BLOCKS or name in RAW:
            if name in BLOCKS:
                blocks.append(len(stack))
            kind = max(kind, kind_of(name, found[3], main))
            main = main or is_main(name, found[3])
            opened[name] += 1
            stack.append((name, kind, main))
    say(len(page))
    close()
    return lines


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}[\s/>]", re.I)


def common(a: list, b: list) -> list[int]:
    """Indices in a of a longest common subsequence, by bit-parallel rows over b; large alignments are divided in halves."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    tail = list(range(len(a) - j, len(a)))
    found = list(range(i))
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b or not set(a) & set(b):
        return found + tail
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        left, right = _counts(_rows(a[:half], b)[-1], len(b)), _counts(_rows(a[half:][::-1], b[::-1])[-1], len(b))
        cut = max(range(len(b) + 1), key=lambda k: left[k] + right[len(b) - k])
        return found + [i + k for k in common(a[:half], b[:cut])] + [i + half + k for k in common(a[half:], b[cut:])] + tail
    rows, k, m, inner = _rows(a, b, True), len(a) - 1, len(b) - 1, []
    while k >= 0 and m >= 0:
        if a[k] == b[m]:
            inner.append(i + k)
            k, m = k - 1, m - 1
        elif k and _count(rows[k - 1], m) >= _count(rows[k], m):  # line k adds nothing up to m
            k -= 1
        else:
            m -= 1
    return found + inner[::-1] + tail


def _rows(a: list, b: list, every: bool = False) -> list[int]:
    places: dict = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if every:
            rows.append(row)
    return rows or [row]


def _count(row: int, upto: int) -> int:
    return upto + 1 - (row & ((2 << upto) - 1)).bit_count()


def _counts(row: int, n: int) -> list[int]:
    out = [0]
    for k in range(n):
        out.append(out[-1] + (not row >> k & 1))
    return out


SLIM = "page_id long,key long,host string,path string,lines binary,hashes array<long>"
PAIRED = "page_id long,key long,host string,path string,hashes array<long>,part int,first boolean,last boolean,shared array<int>"


def slim_pages(pages: DataFrame) -> DataFrame:
    """(page_id, key, host, path, a hash of all lines, hashes of lines) of rows (page_id, key, url, html) that have a host."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, hosts, paths, lines, hashes = [], [], [], [], [], []
            for page, key, url, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), raw(batch.column(3)), strict=True):
                try:
                    split = urlsplit(url or "")
                except ValueError:
                    continue
                if split.netloc:
                    ids.append(page)
                    keys.append(key)
                    hosts.append(split.netloc.lower())
                    paths.append(split.path + ("?" + split.query if split.query else ""))
                    hashes.append([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) for line, _ in lines_of(decoded(data or b""))])
                    lines.append(xxhash.xxh3_128_digest(np.array(hashes[-1], np.int64).tobytes()))
            yield pa.RecordBatch.from_pydict({"page_id": ids, "key": keys, "host": hosts, "path": paths, "lines": lines, "hashes": hashes}, schema=to_arrow(SLIM))

    return pages.mapInArrow(go, SLIM)


def neighbours(slim: DataFrame) -> DataFrame:
    """(key, shared): the lines that each page shares with the page before it on its host, in the order of paths. Copies are one page."""
    order = ("host", "path", "page_id", "key")
    held = shared_checkpoint(slim.withColumn("copies", F.xxhash64("host", "lines")))
    copies = held.groupBy("copies").agg(F.min(F.struct("host", "path", "page_id")).alias("first"), F.any_value("hashes").alias("hashes"))
    pages = copies.select("first.page_id", F.col("copies").alias("key"), "first.host", "first.path", "hashes")
    ranged = shared_checkpoint(pages.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = ranged.withColumn("part", F.spark_partition_id())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if before is not None:
                    if before["shared"] is None and before["host"] == row["host"]:
                        before["shared"] = common(before["hashes"], row["hashes"])
                    out.append(before)
                    shared = common(row["hashes"], before["hashes"]) if before["host"] == row["host"] else None
                else:
                    shared = None
                before = row | {"first": before is None, "last": False, "shared": shared}
            if out:
                yield pa.RecordBatch.from_pylist([x if x["first"] else x | {"hashes": None} for x in out], schema=to_arrow(PAIRED))
                out = []
        if before is not None:
            yield pa.RecordBatch.from_pylist([before | {"last": True}], schema=to_arrow(PAIRED))

    paired = marked.mapInArrow(go, PAIRED)
    # One row for each partition: the first of each gets the last of the one before.
    edges = shared_checkpoint(paired.where("first OR last"))
    ends = edges.where("last").select("part", F.col("host").alias("end_host"), F.col("hashes").alias("end_hashes"))
    heads = edges.where("first").select("part", F.lit(None).cast("string").alias("end_host"), F.lit(None).cast("array<long>").alias("end_hashes"), "page_id", "key", "host", "hashes", "shared")
    lined = heads.withColumn("order", F.lit(0)).unionByName(ends.withColumn("order", F.lit(1)), allowMissingColumns=True)
    upto = Window.orderBy("part", "order").rowsBetween(Window.unboundedPreceding, -1)
    told = lined.withColumn("end", F.last(F.when(F.col("order") == 1, F.struct("end_host", "end_hashes")), ignorenulls=True).over(upto)).where("order = 0")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"page_id": x["page_id"], "key": x["key"], "shared": common(x["hashes"], x["end"]["end_hashes"]) if x["end"] and x["end"]["end_host"] == x["host"] else x["shared"]}
                for x in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow("page_id long,key long,shared array<int>"))

    mended = told.select("page_id", "key", "host", "hashes", "shared", "end").mapInArrow(mend, "page_id long,key long,shared array<int>")
    found = paired.where("NOT first").select("page_id", "key", "shared").union(mended).where(F.size("shared") > 0)
    return held.select("key", "copies").distinct().join(found.select(F.col("key").alias("copies"), "shared"), "copies").select("key", "shared")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_shared, n_deleted): the main text of each page, and how many lines it shares with its partner and lost for that."""
    url, page = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.xxhash64(url, page, F.col(f"`{id_col}`")).alias("key"), url.alias("url"), page.alias("html"))
    shared = neighbours(slim_pages(rows))
    joined = packed_text(rows, "html").join(shared, "key", "left").select("page_id", "url", "html", "shared")
    schema = "page_id long,url string,text string,n_chars long,n_shared long,n_deleted long"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(decoded(zstandard.decompress(x)), same or ()) for x, same in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            names = ("page_id", "url", "text", "n_chars", "n_shared", "n_deleted")
            columns = [list(x) for x in zip(*made, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_pydict(dict(zip(names, [batch.column(0), batch.column(1), *columns], strict=True)), schema=to_arrow(schema))

    return joined.mapInArrow(go, schema).withColumnsRenamed({"page_id": id_col, "url": url_col})


def main_text(page: str, shared) -> tuple[str, int, int, int]:
    """(text, its code points, lines shared with the partner, lines deleted for that)."""
    lines = lines_of(page)
    gone = {k for k in shared if k < len(lines) and lines[k][1] != OWN}
    marked = any(kind == OWN for _, kind in lines)
    text = "\n".join(line for k, (line, kind) in enumerate(lines) if k not in gone and kind == (OWN if marked else PLAIN))
    return text, len(text), len(shared), len(gone)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
