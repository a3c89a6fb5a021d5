"""Main text of hand-written pages: what stands beside the article goes, whatever its size."""

import time

import pytest

from delaycohorts.llm import tag_paths

ARTICLE = [f"This is paragraph {k} of the article, and it says something of use. It has two sentences, too." for k in range(3)]
OTHERS = [f"I am reader {k}, and I have to say something else here. It is not of much use, really now." for k in range(12)]


def p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


PAGES = {
    "comments beside content": f"<div class=content>{p(ARTICLE)}</div><div id=comments>{p(OTHERS)}</div>",
    "sidebar beside main": f"<div class=main>{p(ARTICLE)}</div><div class=sidebar>{p(OTHERS)}</div>",
    "aside beside main": f"<div class=main>{p(ARTICLE)}</div><aside>{p(OTHERS)}</aside>",
    "comments beside article": f"<article>{p(ARTICLE)}</article><div id=comments>{p(OTHERS)}</div>",
    "comments in article": f"<article>{p(ARTICLE)}<section class=comments>{p(OTHERS)}</section></article>",
    "list of comments in article": f"<article>{p(ARTICLE)}<ol class=comment-list>{''.join(f'<li>{c}</li>' for c in OTHERS)}</ol></article>",
    "aside in article": f"<article>{p(ARTICLE)}<aside>{p(OTHERS)}</aside></article>",
    "comments beside no named content": f"<div>{p(ARTICLE)}</div><div class=comments-area>{p(OTHERS)}</div>",
    "comments that are articles": f"<main><article>{p(ARTICLE)}</article><div id=comments>{''.join(f'<article class=comment><div class=comment-body><p>{c}</p></div></article>' for c in OTHERS)}</div></main>",
    "wrapper named after its sidebar": f"<div class=has-sidebar><div class=content>{p(ARTICLE)}</div><div class=sidebar>{p(OTHERS)}</div></div>",
    "form around the page": f"<div>My site</div><form><div>{p(ARTICLE)}</div></form><div>© 2024 Example Corporation Ltd. All rights reserved.</div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_only_the_article_is_left(name):
    assert tag_paths.main_text(f"<html><body><nav><a href=/>Home</a></nav>{PAGES[name]}<footer>About us.</footer></body></html>") == "\n".join(ARTICLE)


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "some text, at last." + "</div>" * 20_000,
    "".join(f"<div>text {k}, and more of it here." for k in range(20_000)),
    "<span>" * 20_000 + "hello, you</b>" * 20_000,
    "<p>" + "<ul><li>x" * 10_000 + "</i>" * 10_000,
])
def test_deep_pages_take_linear_time(page):
    started = time.process_time()
    tag_paths.main_text(page)
    assert time.process_time() - started < 5


def test_rows_keep_their_own_result(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, mass string"
    rows = [(1, "u", PAGES["aside in article"], "old", 7, "m"), (1, "u", PAGES["aside in article"], "old", 7, "m"), (None, None, None, None, None, None), (2, "v", "", "x", 1, "y"), (3, "w", "<p>" + "word, " * 200_000, "x", 1, "y")]
    got = {(r["page_id"], r["text"][:20], r["n_chars"]) for r in tag_paths.digest_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, ARTICLE[0][:20], len("\n".join(ARTICLE))), (None, "", 0), (2, "", 0), (3, "word, " * 3 + "wo", 1_199_999)}
    assert tag_paths.digest_rows(spark.createDataFrame([], schema)).count() == 0
