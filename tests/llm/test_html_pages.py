"""Extraction from pages whose article is known, and from odd ones."""

import random
import resource
import time

import pytest

from lodemill.llm import html_extract

WORDS = "river stone bridge over under slowly the old mill turns while water falls and wind goes by again".split()


def _sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def _page(r, host):
    """A page of a host's template and its article: several blocks with entities, inline marks, lists and a table."""
    blocks, html = [], []
    title = _sentence(r, 5)
    head = f"<h1 class=t{r.randrange(99)}>{title}</h1>"
    html.append(f"<header>{head}</header>" if host % 2 and host != 3 else head)
    blocks.append(title)
    for _ in range(r.randrange(2, 9)):
        a, b = _sentence(r, r.randrange(5, 40)), _sentence(r, 6)
        kind = r.randrange(5)
        if kind == 0:
            html.append(f"<p>{a} <b>{b[:9]}</b>{b[9:]}")
            blocks.append(f"{a} {b}")
        elif kind == 1:
            html.append(f"<ul><li>{a}<li>{b}</ul>")
            blocks += [a, b]
        elif kind == 2:
            html.append(f"<p>{a}\n  &amp; {b}</p><!-- <p>not here</p> -->")
            blocks.append(f"{a} & {b}")
        elif kind == 3:
            html.append(f"<table><tr><td>{a}<td>{b}</table>")
            blocks += [a, b]
        else:
            html.append(f"<p>{a} see <a href='/x'>{b}</a></p><script>var p = '<p>{a}</p>';</script>")
            blocks.append(f"{a} see {b}")
    body = "".join(html)
    menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>{r.choice(WORDS)}</a>" for i in range(r.randrange(3, 30))) + "</ul></nav>"
    extra = f"<div class='ad box{r.randrange(9)}'>{_sentence(r, 12)}</div><div id=comments><p>{_sentence(r, r.randrange(5, 300))}</p></div><footer>{_sentence(r, 10)}</footer>"
    wrap = [
        f"<article>{body}<aside>{_sentence(r, 4)}</aside></article>{extra}",
        f"<div id=main><main>{body}</main></div>{extra}",
        f"<div class='post-{r.randrange(999)} entry'>{body}</div>{extra}",
        # The site calls its stories notices; some are short.
        f"<div class='notice-board story'>{body}</div><div class='ad big'><p>{_sentence(r, 900 if r.random() < 0.2 else 3)}</p></div><form>{_sentence(r, 3)}</form>",
    ][host % 4]
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{menu}{wrap}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("host", range(4))
def test_planted_articles(spark, host):
    r = random.Random(host)
    pages = [_page(r, host) for _ in range(60)]
    df = spark.createDataFrame([(i, f"http://h{host}.example.net/{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    out = {x.page_id: x.text for x in html_extract.main_text(df).collect()}
    assert [i for i, (_, article) in enumerate(pages) if out[i] != article] == []


def test_an_article_keeps_its_own_heading_and_formulas():
    page = "<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><footer>by me</footer></article></body>"
    assert html_extract.extract(page, None) == "Title\nWe know that x=2 holds."


@pytest.mark.parametrize(
    "source",
    [
        "<a b " * 200_000, "<div>x" * 100_000, "<ul><li>" + "<b>" * 100_000 + "<li>x" * 10_000, '<a "' * 200_000 + ">x", "<a '>x" * 100_001, "<p><div>" + "<b>" * 50_000 + "<hr>x" * 50_000,
        "<div class=ad>x" * 50_000, "<div>" * 50_000 + "</span>" * 50_000, "< " * 500_000, "<script>" * 100_000, "<p>a<a href=x>" * 70_000, "<!--" * 250_000, "&amp" * 250_000,
    ],
    ids=range(13),
)
def test_odd_pages_take_time_and_memory_in_proportion(source):
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    short = html_extract.extract(source[: len(source) // 8], None)
    middle = time.process_time()
    html_extract.extract(source, None)
    took, first = time.process_time() - middle, middle - began
    assert took < 12 and took < 16 * max(first, 0.1) + 1 and isinstance(short, str)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
