"""Main text by structure and entropies, with and without names."""

import html
import random
import re
import time

import pytest

from meterloom.llm import style_tree

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    rows = spark.createDataFrame([(i, f"https://{h}.example/{i}", p) for i, (h, p) in enumerate(pages)], PAGES)
    return [r["text"] for r in style_tree.extract(rows).orderBy("page_id").collect()]


def article_of(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
    return "\n".join(b for b in blocks if b)


def test_names_are_not_needed(spark, data, monkeypatch):
    monkeypatch.setattr(style_tree, "LOWERED", 0.0)  # no tag and no word of a class takes anything away
    got = {r["page_id"]: r["text"] for r in style_tree.query(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert {r["page_id"]: article_of(r["html"]) for r in pages} == got and len(got) > 40


def test_a_single_word_takes_no_text(spark):
    body = "".join(f"<p>Paragraph {i} of the article, with a sentence or two of its own.</p>" for i in range(6))
    related = '<section class="related-work"><p>Related work in the field is surveyed here.</p></section>'
    price = '<div class="share-price">The share price rose by a tenth after the news of the day was out.</div>'
    nav = '<nav><ul><li><a href="/a">First</a><li><a href="/b">Second</a></ul></nav>'
    got = texts(spark, [("one", f"<body>{nav}<article>{body}{related}</article></body>"), ("two", f"<body>{nav}<div>{body}{price}</div></body>"), ("three", f"<body>{body}{price}</body>")])
    want = [f"Paragraph {i} of the article, with a sentence or two of its own." for i in range(6)]
    assert got[0].split("\n") == [*want, "Related work in the field is surveyed here."]
    assert got[1].split("\n") == got[2].split("\n") == [*want, "The share price rose by a tenth after the news of the day was out."]


@pytest.mark.parametrize("deep", [3, 40, 513, 2000])
def test_depth_changes_nothing(spark, deep):
    def page(i):
        body = "".join(f"<p>Paragraph {i} {j} of the article, with words of its own.</p>" for j in range(5))
        return "<div>" * deep + f'<nav><ul><li><a href="/">Menu {i}</a></ul></nav><article>{body}</article><footer>Foot {i}</footer>' + "</div>" * deep

    got = texts(spark, [("deep", page(i)) for i in range(3)])
    assert got == ["\n".join(f"Paragraph {i} {j} of the article, with words of its own." for j in range(5)) for i in range(3)]


def test_comments_in_an_article_go_by_their_names(spark):
    body = "".join(f"<p>Paragraph {i} of the article itself, longer than a comment is.</p>" for i in range(5))
    page = f'<body><article>{body}<div class="comments"><p>First!</p><p>I do not agree.</p></div><div class="cookie-notice">We use cookies</div></article></body>'
    assert texts(spark, [("one", page)]) == ["\n".join(f"Paragraph {i} of the article itself, longer than a comment is." for i in range(5))]


def test_what_is_drawn_anew_for_each_page_goes(spark):
    rnd = random.Random(3)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(n))

    pages, want = [], []
    for i in range(40):
        body = [words(25) for _ in range(rnd.randint(3, 9))]
        links = "".join(f'<li><a href="/{j}">{words(1)}</a></li>' for j in range(6))
        pages.append((f"host{i % 3}", f'<body><div class=x1><ul>{links}</ul></div><div class=x2>{words(5)}</div><div class=x3><h1>{words(4)}</h1>' + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class=x4>{words(4)}</div></body>"))
        want.append(body)
    got = texts(spark, pages)
    assert [g.split("\n")[1:] for g in got] == want and all(len(g.split("\n")[0].split()) == 4 for g in got)  # the heading is in the main node


def test_weights_are_those_of_a_plain_count(spark):
    """Shares, main node and weights counted again, page by page, from the blocks."""
    rnd = random.Random(11)
    pages = []
    for i in range(30):
        body = "".join(f"<p>{'w%d ' % rnd.randrange(10**6) * rnd.randint(5, 30)}</p>" for _ in range(rnd.randint(2, 6)))
        pages.append((i, f"https://h{i % 2}.example/", f"<body><div class=a><a href=x>{'l%d ' % i * 3}</a></div><div class=b>{body}</div><div class=c>{'c%d ' % i * rnd.randint(1, 9)}</div></body>"))
    tree = {(r["host"], r["node"]): r for r in style_tree.style_trees(spark.createDataFrame(pages, PAGES)).collect()}
    leaf = {"a": ">body>div.a", "b": ">body>div.b", "p": ">body>div.b>p", "c": ">body>div.c"}
    shares: dict = {}
    for _, url, page in pages:
        found: dict = {}
        for path, text, _, _ in style_tree.blocks_of(page):
            found[path] = found.get(path, 0) + len(text)
        found[leaf["b"]] = found[leaf["p"]]
        total = sum(found[leaf[k]] for k in "apc")
        for k in "abc":
            shares.setdefault((url[8:-1], k), []).append(round(1000 * found[leaf[k]] / total))
    for (host, k), own in shares.items():
        both = [x for (_, other), v in shares.items() if other == k for x in v]
        share = (sum(own) + 20 * sum(both) / len(both)) / (len(own) + 20) / 1000
        want = {"a": (1 - 0.9) * min(1, share / 0.7), "b": 1.0, "c": min(1, share / 0.7)}[k]
        assert abs(tree[host, leaf[k]]["weight"] - want) < 0.01, (host, k)


def test_odd_pages_through_the_query(spark, tmp_path):
    rows = [(1, None, None), (2, "", ""), (3, "https://h.example/", None), (None, "no url", "<p>Text"), (4, "https://h.example/", "<p>Text</p>"), (4, "https://h.example/", "<p>Text</p>"), (5, "https://h.example/x", "<title>Only a title</title>"),
            (6, "https://long.example/", "<article>" + "<p>word</p>" * 30_000 + "</article>"), (7, "https://h.example/", "no markup at all")]
    from pyspark.sql import functions as F

    spark.createDataFrame(rows, PAGES).withColumns({n: F.lit("mine") for n in ("host", "text", "node", "row", "weight")}).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:20], r["n_chars"]) for r in style_tree.query(spark, str(tmp_path)).collect()), key=repr)
    assert [g for g in got if g[0] != 6] == sorted([(1, None, "", 0), (2, "", "", 0), (3, "https://h.example/", "", 0), (0, "no url", "Text", 4), (4, "https://h.example/", "Text", 4), (4, "https://h.example/", "Text", 4), (5, "https://h.example/x", "", 0), (7, "https://h.example/", "no markup at all", 16)], key=repr)
    assert next(g for g in got if g[0] == 6)[3] == 30_000 * 5 - 1


def test_reading_takes_time_with_the_page():
    began = time.time()
    for n in (100_000,):
        for page in ("<div>" * n + "x", "<nav>" * n + "x" + "</nav>" * n, "<b>" * n + "<hr>x" * n, "<table><tr><td>" * n + "x", "<p class=nav>" * n + "x", "<i>" * n + "<p>x</p>" * n):
            style_tree.blocks_of(page)
    assert time.time() - began < 60
