"""Archives, extraction, chat."""

import hashlib
import html
import re
import time

import duckdb
import numpy as np
import pytest

from sheetwright.llm import chat, pages, warc

ROWS = [
    (1, "http://a/\r\nX: y", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://c", "<p>one</p>"), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", "é漢" * 5000),
    (None, "http://g", "<p>two</p>"), (None, None, "alone"), (7, "http://h", "twin"), (7, "http://h", "twin"),
]


def test_archives(spark, tmp_path):
    d = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    got = sorted(map(tuple, warc.archive_report(d).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        first = min((j for j, _, g in ROWS if (g or "") == (h or "") and j is not None), default=None)
        kind = "response" if first is None or first == i else "revisit"
        want.append((i, len(data), warc.base32_sha1(data), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    assert warc.archive_report(d.limit(0)).count() == 0
    small = warc.archive_report(d, min_bytes=6).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in small} == {3, None}


def test_damage():
    good = warc.member(1, "http://a", b"payload", None, False, "2024-01-01T00:00:00Z")
    both = good + warc.member(2, None, b"payload", 1, True, "2024-01-01T00:00:00Z")
    got = list(warc.records(both[i : i + 7] for i in range(0, len(both), 7)))
    assert [r["record_type"] for r in got] == ["response", "revisit"] and got[1]["refers_to"] == 1 and got[0]["payload"] == b"payload"
    with pytest.raises(warc.WarcError):
        list(warc.records([both[:-5]]))
    import gzip

    with pytest.raises(warc.WarcError):
        list(warc.records([gzip.compress(gzip.decompress(good).replace(b"payload", b"pay10ad"))]))


def test_extraction_on_held_out_pages():
    tree = pages.trained()
    right = n = 0
    for page, good in pages.labelled_pages(120, seed=77):
        found = pages.blocks(page)
        for b, row in zip(found, pages.features(found).tolist()):
            right += tree.says(row) == (b["text"] in good)
            n += 1
    assert right / n >= 0.98


def blocks_of(n, seed, unnamed):
    x, y = [], []
    for page, good in pages.labelled_pages(n, seed, unnamed):
        found = pages.blocks(page)
        x.append(pages.features(found))
        y += [b["text"] in good for b in found]
    return np.vstack(x), np.array(y, float)


@pytest.mark.parametrize("features, least", [(10, 0.96), (6, 0.75)])
def test_extraction_where_names_say_nothing(features, least):
    """Half of the adverts and notices without telling names; then a tree of words and links alone, the first six features."""
    tree = pages.trained() if features == 10 else pages.Tree(*[v[:, :6] if v.ndim == 2 else v for v in blocks_of(pages.TRAINING_PAGES, 5, pages.UNNAMED)])
    x, y = blocks_of(120, 78, 0.5)
    assert np.mean([tree.says(row) == bool(v) for row, v in zip(x[:, :features].tolist(), y)]) >= least


def test_extraction_on_the_table(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in pages.extract_pages(d).collect()}
    for r in d.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        text = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_odd_pages(spark):
    tree = pages.trained()
    odd = ["", "no tags at all but many words of plain running text in one single block without any markup around it today", "<div", "<!-- open", "<script>if (a < b) {", "<p>" * 500, "&amp;&#233;&nope;" * 50]
    for page in odd:
        assert isinstance(pages.main_text(page, tree), str)
    page = '<body><div class="cookie-notice"><p>We use cookies on this site for many good reasons, please accept.</p></div><article><header><h1>Title here</h1></header><p>First &amp; foremost a   paragraph\nof text.</p><form><label>Name</label><p>Send us your name and your mail</p></form><div class="comments"><p>I liked this article a lot and want to say so in many words here.</p></div></article><aside>More stories</aside></body>'
    assert pages.main_text(page, tree) == "Title here\nFirst & foremost a paragraph of text."
    d = spark.createDataFrame([(1, None, None, "x")], "page_id long, url string, html string, text string")
    assert tuple(pages.extract_pages(d).first()) == (1, None, "", 0)
    assert pages.extract_pages(d.limit(0)).count() == 0


LONG = " ".join(["The river carried the letters of the old market past the garden and under the bridge every winter"] * 4)


@pytest.mark.parametrize("start, end", [
    ('<div class="content no-sidebar">', "</div>"),
    ('<div id="main" class="article-body share-enabled">', "</div>"),
    ('<article><div class="story-form-wide">', "</div></article>"),
    ('<main class="has-footer"><div class="post sidebar-left">', "</div></main>"),
])
def test_compound_names(start, end):
    page = f'<body><nav class="mainNav"><a href="/">home</a> <a href="/a">all</a></nav>{start}<p>{LONG} one.</p><p>{LONG} two.</p>{end}<div class="comment-body"><p>{LONG} three.</p></div><div id="siteFooter"><p>All rights reserved</p></div></body>'
    assert pages.main_text(page, pages.trained()) == f"{LONG} one.\n{LONG} two."


def test_names():
    kinds = {"no-sidebar": "", "share-enabled": "", "story-form-wide": "main", "comment-body": "other", "post-comments": "other", "mainNav": "other", "sidebar_left": "shape", "site-footer": "other", "entry-content": "main", "ad-300": "other", "shadow": "", "headline": "", "x7f3": ""}
    assert {k: pages.name_kind(k) for k in kinds} == kinds
    assert pages.name_kind("entry-header", 1) == "main" and pages.name_kind("header") == "other"


def test_words_in_buttons_and_formulas():
    page = f"<article><p>{LONG} press <button>Start</button> and <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"
    assert pages.main_text(page, pages.trained()) == f"{LONG} press Start and x=2 holds."


@pytest.mark.parametrize("part", ["<a ", "<div ", "<script ", "<!", "<!--", "<a href='", '<p class="', "<div></section>", "<div>", "</div>", "<b><p>", "&amp", "<"])
def test_a_megabyte_of_broken_tags(part):
    tree = pages.trained()
    began = time.process_time()
    pages.main_text(part * (1_000_000 // len(part)), tree)
    assert time.process_time() - began < 6


TURNS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"), (1, 3, "user", None),
    (2, 0, "user", "only one"), (5, 0, "user", "other only"), (6, 0, "user", "same"), (7, 0, "user", "same"), (8, 0, None, "x"), (8, 0, "assistant", "tie"), (9, 1, "assistant", "tie"), (None, 0, "user", "lost"),
]


def test_chat(spark):
    d = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preference_pairs(chat.paired(d)).collect()}
    r = got[0]
    assert r.n_prompt_turns == 2 and r.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n"
    a, b = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:b] == "hello<|end|>" and r.rejected.count("<|end|>") == 2
    assert got[3].chosen == got[3].rejected == "" and got[1].rejected == "" and got[2].chosen == "" and set(got) == {0, 1, 2, 3, 4}
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    want = {x[0]: x for x in db.execute(f"SELECT pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask FROM ({chat.SQL})").fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want
    assert chat.preference_pairs(chat.paired(d.limit(0))).count() == 0
