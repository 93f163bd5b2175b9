"""Page texts, chats, and the pipeline."""

import random
import re
import time

import pytest

import corpus_pipeline
from vigilake.llm import chat_grammar, html_diff, queries

PAGE = "<html><head><title>T</title></head><body class='has-sidebar'>{top}<div id='content'>{body}</div>{bottom}</body></html>"


def texts(spark, rows):
    df = spark.createDataFrame([(k, url, page, 5) for k, (url, page) in enumerate(rows)], "page_id long, url string, html string, text int")
    return {r.page_id: r.text for r in html_diff.extract(df).collect()}


def test_markup(spark):
    page = """<!DOCTYPE html><body><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">ok?</div><main><header><h1>Title &amp; x</h1></header>
    <p>One  two<br>three<p>Four <b>five</b> &eacute;&#233;<ul><li>a<li>b</ul><div class="comments"><p>nice</p></div><aside>x</aside><script>var a="</p>";</script><form>f</form>
    <table><tr><td>c1</td><td>c2</td></tr></table><!-- x > y --><p title="a > b">last</main><div>outside</div><footer>f</footer>"""
    got = texts(spark, [("http://a.b/c", page), ("http://a.b/d", None), (None, ""), ("http://a.b/e", "just text &lt; here"), ("http://a.b/[", "<p>y</p>")])
    assert got == {0: "Title & x\nOne two three\nFour five éé\na\nb\nc1\nc2\nlast", 1: "", 2: "", 3: "just text < here", 4: "y"}


def test_differencing(spark):
    rows = [(f"http://h.x/{k:02}", PAGE.format(top="<div>Welcome</div>", body=f"<p>article {k}</p><p>more {k}</p>", bottom="<div>Imprint</div>")) for k in range(30)]
    rows += [("http://h.x/copy", rows[0][1]), ("http://h.x/copy", rows[0][1]), ("http://other.x/1", PAGE.format(top="<div>Welcome</div>", body="<p>alone</p>", bottom=""))]
    got = texts(spark, rows)
    assert all(got[k] == f"article {k}\nmore {k}" for k in range(30))
    assert got[32] == "Welcome\nalone"
    article = PAGE.replace("<div id='content'>", "<article>").replace("</div>{bottom}", "</article>{bottom}")
    marked = [(f"http://m.x/{k}", article.format(top="<div>Top</div>", body=f"<p>said by all</p><p>{k}</p>", bottom="")) for k in range(4)]
    assert texts(spark, marked) == {k: f"said by all\n{k}" for k in range(4)}


def test_copies_are_one_page(spark):
    """Copies lose the lines of the site as the page does that they copy, and so does a page with few lines of its own."""
    site = "".join(f"<div>Site line {k}</div>" for k in range(20))
    rows = [(f"http://h.x/{k:02}", PAGE.format(top=site, body=f"<p>article {k}</p>", bottom="<div>Imprint</div>")) for k in range(6)]
    rows += [("http://h.x/02b", rows[2][1]), ("http://h.x/02b", rows[2][1]), ("http://h.x/zz", rows[0][1])]
    rows += [(f"http://only.x/{k}", rows[0][1].replace("article 0", "copied")) for k in range(3)]
    got = texts(spark, rows)
    assert [got[k] for k in range(9)] == [f"article {k}" for k in (0, 1, 2, 3, 4, 5, 2, 2, 0)]
    assert all("Site line 0" in got[k] and "copied" in got[k] for k in (9, 10, 11))  # nothing on their host to compare with


def test_article_words_are_no_noise(spark):
    parts = ['<h2 id="search">Search algorithms</h2>', '<h2 id="Social_history">Social history</h2>', '<section id="related-work"><h2>Related work</h2><p>by others</p></section>',
             '<div id="promotion-rules">Promotion rules</div>', '<p class="ad">An advert is</p>', '<div class="promotion-rules">More rules</div>', '<h2 class="comments">Comments</h2>']
    noise = ['<div class="ad-box">buy</div>', '<ul class="share buttons"><li>tweet</li></ul>', '<section class="commentList"><p>first!</p></section>', '<div role="alert">late</div>', '<p hidden>no</p>', '<p style="display: none">no</p>']
    page = "<article>" + "".join(a + b for a, b in zip(parts, [*noise, ""], strict=True)) + "</article>"
    want = "Search algorithms\nSocial history\nRelated work\nby others\nPromotion rules\nAn advert is\nMore rules\nComments"
    assert texts(spark, [("http://a.b/c", page)]) == {0: want}


def test_hostile_pages_take_linear_time():
    n = 1 << 20
    for page in ("<i>" * (n // 6) + "</b>" * (n // 6), "<a " * n, "<!" * n, "<" * n, '<a "' * (n // 4) + ">" * (n // 4), "<a '>" * (n // 5), "<ul><li><div>" + "<i><li></li>" * (n // 12), "<div>" * (n // 5), "<p>" * (n // 3), "<!--" * n, "</p>" * (n // 4), "<script>" * (n // 8), "<i><div></div>" * (n // 14)):
        began = time.process_time()
        html_diff.lines_of(page + "end")
        assert time.process_time() - began < 20, page[:20]


def test_whole_query_against_brute_force(spark, tmp_path):
    """Pages with and without marked articles, copies, shared and reordered lines: the nearest page by path, one table of the alignment for each pair."""
    pick = random.Random(21)
    rows = []
    for k in range(120):
        host, body = f"h{pick.randrange(4)}.x", [pick.choice("abcdefgh") * 3 + str(pick.randrange(9)) for _ in range(pick.randint(0, 7))]
        mark = pick.choice(["article", "div", "div"])
        lines = [pick.choice("tuv") for _ in range(pick.randint(0, 3))]
        page = "".join(f"<div>{x}</div>" for x in lines) + f"<{mark}>" + "".join(f"<p>{x}</p>" for x in body) + f"</{mark}>" + pick.choice(["", "<div>end</div>", "<footer>foot</footer>"])
        rows.append((k, f"http://{host}/{pick.randrange(60):02}", page if pick.random() > 0.1 else rows[-1][2] if rows else page))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def table(a, b):
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        return grid[-1][-1]

    first = {}
    for k, url, page in rows:
        host, path = url[7:].split("/", 1)
        key = host, tuple(x for x, _ in html_diff.lines_of(page))
        first[key] = min(first.get(key, ("~", 0)), ("/" + path, k))
    order = sorted((host, *place, lines) for (host, lines), place in first.items())
    partner = {}
    for k, (host, *_, lines) in enumerate(order):
        before, after = (order[j] if 0 <= j < len(order) and order[j][0] == host else None for j in (k - 1, k + 1))
        partner[host, lines] = (before or after or (None,) * 3 + ((),))[3]
    for r in html_diff.op5_html_text(spark, str(tmp_path)).collect():
        lines = html_diff.lines_of(rows[r.page_id][2])
        names = tuple(x for x, _ in lines)
        assert r.n_shared == table(names, partner[rows[r.page_id][1][7:].split("/")[0], names])
        text, _, shared, gone = html_diff.main_text(rows[r.page_id][2], html_diff.common(list(names), list(partner[rows[r.page_id][1][7:].split("/")[0], names])))
        assert (r.text, r.n_chars, r.n_shared, r.n_deleted) == (text, len(text), shared, gone)
        kept = [x for x, kind in lines if kind == html_diff.OWN]
        assert text.split("\n") == kept if kept else len(text.split("\n")) - (not text) == sum(kind == html_diff.PLAIN for _, kind in lines) - sum(kind == html_diff.PLAIN for k, (_, kind) in enumerate(lines) if k in set(html_diff.common(list(names), list(partner[rows[r.page_id][1][7:].split("/")[0], names]))))


def test_pages_at_the_edge(spark):
    df = spark.createDataFrame([(None, "http://a.b/1", "<p>x</p>"), (None, "http://a.b/1", "<p>x</p>"), (2, None, "<p>" + "long " * 300_000 + "</p>")], "page_id long, url string, html string")
    got = html_diff.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [1, 1, 1_499_999] and html_diff.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [10**9, 8])
def test_alignment(cells, monkeypatch):
    monkeypatch.setattr(html_diff, "CELLS", cells)
    pick = random.Random(1)

    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(1000):
        a, b = ([pick.choice("abcde") for _ in range(pick.randint(0, 14))] for _ in range(2))
        same, rest = html_diff.common(a, b), iter(b)
        assert len(same) == length(a, b) and same == sorted(set(same)) and all(a[k] in rest for k in same)


def test_chats(spark):
    hard = ["a<|im_end|>\nb", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|> <|x <\\\\|", "<", "<|im_end<|im_end|>|>", "</s>[INST] ok [/INST]", "", None, "plain", "x\\", "<\\", "日本 👩", "\ufeffmark", "👩<|im_end|>👩"]
    rows = [(k, j, "user" if j % 2 == 0 else "assistant", hard[(k + j) % len(hard)], "x") for k in range(14) for j in range(3)]
    rows += [(60, j, "assistant" if j % 3 else "user", f"turn {j} <|im_end|>" * (j % 4), "x") for j in range(3000)] + [(61, 0, "assistant", "long 👩 <|x " * 100_000, "x")]
    rows += [(50, 1, "assistant", "tie", "x"), (50, 1, "assistant", "tie", "x"), (50, None, "us%|er\nz", "first", "x"), (None, None, None, "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_grammar.format_chats(df).collect()}
    for conv in got:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(x.role, x.text) for x in got[conv].turns] == [x[1:] for x in own]
        assert got[conv].loss == "".join(x[2] for x in own if x[1] == "assistant")
        spans = [(x.start, x.end) for x in got[conv].mask]
        pieces = [got[conv].formatted[a:b] for a, b in spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in pieces] == [x[2] for x in own if x[1] == "assistant"] and spans == sorted(spans)
        assert got[conv].formatted.count(chat_grammar.START) == len(own) == got[conv].formatted.count(chat_grammar.END)
    assert chat_grammar.format_chats(df.limit(0)).count() == 0


def test_names():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and [f.__name__ for _, f in corpus_pipeline.STAGES] == [f.__name__ for _, f in corpus_pipeline.STAGES]


def test_pipeline(spark, tmp_path):
    """The stages one after another against a brute-force version of each."""
    from test_line_neighbourhood import brute

    from vigilake.llm.order_minhash import alike
    from vigilake.llm.words import plain_words

    pick = random.Random(9)
    words = ["".join(pick.choice("bcdfgmnprst") + pick.choice("aeiou") for _ in range(pick.randint(2, 4))) for _ in range(4000)]
    line = lambda n: " ".join(pick.choice(words) for _ in range(n))
    rows = [(k, "\n".join(line(20) for _ in range(5))) for k in range(30)]
    near = [x.split(" ") for x in (rows[0][1], rows[1][1])]
    for k in range(0, 90, 15):
        near[0][k] = "changed"
    rows += [(40, " ".join(near[0])), (41, rows[1][1]), (42, rows[2][1].replace("a", "e", 1) + "\n" + line(60)), (43, "too short"), (44, "same words here " * 40), (45, None), (46, "# | $ % " * 30 + line(20))]
    item = line(12)
    rows += [(47, line(60) + " " + item + "\n" + line(30))]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {k for k, _ in rows} - {r.doc_id for r in one.collect()} == {43, 44, 45, 46}
    kept = [(r.doc_id, r.text) for r in one.collect()]
    two = stage["line_dedup"](spark, one, str(tmp_path))
    want = {doc: text for doc, (text, n, gone, _) in brute(kept).items() if gone < n}
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == want and 41 not in want
    three = stage["near_dedup"](spark, two, str(tmp_path))
    left, seen = {}, []
    for doc in sorted(want):
        own = plain_words(want[doc].encode())
        if not any(alike(own, other, 0.8) for other in seen):
            left[doc] = want[doc]
        seen.append(own)
    assert three.columns == docs.columns and {r.doc_id: r.text for r in three.collect()} == left
    four = stage["benchmark_decontamination"](spark, three, str(tmp_path))
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == set(left) - {47}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(left) - {47} and "n_tokens" in out.columns
