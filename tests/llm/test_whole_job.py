"""Cases in which a bound, a cap or a short cut would leave part of the job undone."""

import collections
import math
import zlib

import numpy as np
import pytest

from lodemill.llm import decontaminate, html_extract, line_dedup, packing, quality_net, quality_rules, suffix_dedup, url_filter
from lodemill.llm.queries import vocabulary


def _grams(text):
    w = text.split()
    return collections.Counter(w) + collections.Counter(zip(w, w[1:], strict=False))


def test_quality_rules_count_all_trusted_texts_and_all_grams(spark):
    n = 20_500  # more than were counted once
    rows = [(i, "good old words" if i < n else "other words") for i in range(n + 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    for limit in (10**6, 10):
        sums = quality_rules.gram_counts(docs, labels, limit).groupBy().sum("raw", "target").first()
        assert tuple(sums) == (5 * n + 3 * 50, 5 * n)
    # Grams of one text, more than there once were buckets, do not share counts.
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(150_000)))], "doc_id long, text string")
    counts = quality_rules.gram_counts(many, labels)
    assert counts.count() == 299_999 and counts.filter("raw <> 1").count() == 0


@pytest.mark.parametrize("heavy", [10**6, 5, 0])
def test_quality_rules_scores_with_joined_counts(spark, heavy):
    texts = ["the old river runs slowly over old stones", "the river sings and the stones sing", None, "buy now now now $$$ the river", "buy now or never", "the river sings and the stones sing"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw += _grams(t or "")
        if i in (0, 1):
            target += _grams(t or "")
    want = []
    for i, t in rows:
        own = _grams(t or "")
        scale = target.total() / max(1, raw.total() - own.total())
        score = sum(n * math.log((target[g] + 1) / ((raw[g] - n) * scale + 1)) for g, n in own.items()) / max(1, own.total())
        want.append((-1 if i is None else i, round(score, 9)))
    out = quality_rules.quality_rules(docs, labels, heavy=heavy).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 9)) for r in out) == sorted(want)


def test_packing_encodes_added_tokens_as_the_json_does(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x", f"x  {end}", f"é <|endoftext {end}| y it's", "plain words here", "", None, f"{end} word " * 30]
    out = {r.doc_id: r for r in packing.pieces(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1), vocabulary()).collect()}
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        assert (out[i].length, out[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


LEAD, BODY = "A lead of some words. " * 3, "The body goes on and on. " * 12


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>menu</nav><div class=content><h1>Title</h1><p>{LEAD}</p><div class=body><p>{BODY}</p></div></div><footer>f</footer></body>",
        f"<body><div class=content><h1>Title</h1><p>{LEAD}</p><blockquote><p>{BODY}</p></blockquote></div><div class=x><a href=1>one</a> <a href=2>two</a></div></body>",
        f"<body><div class='page has-sidebar'><h1>Title</h1><p>{LEAD}</p><p>{BODY}</p><div class=sidebar><p>aside</p></div></div></body>",
        f"<body><div class=no-sidebar><div id=with-header><h1>Title</h1><p>{LEAD}</p><p>{BODY}</p></div></div><div class=comments><p>{BODY * 9}</p></div></body>",
        f"<body><main><h1>Title</h1><article><p>{LEAD}</p><p>{BODY}</p></article></main><div class=z><p>elsewhere</p></div></body>",
    ],
)
def test_html_extraction_keeps_the_whole_article(spark, page):
    pages = spark.createDataFrame([(1, "http://a.b/x", page)], "page_id long, url string, html string")
    assert html_extract.main_text(pages).first().text == "\n".join(["Title", LEAD.strip(), BODY.strip()])


def test_suffix_dedup_deals_a_hot_anchor_by_string(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passage, texts = word(90), []
    for i in range(120):
        before, after = word(30), word(30)
        texts.append(before + passage + after)
        if i % 3 == 0:
            texts.append(word(20) + before[20:] + passage + after[:5] + word(20))
    rows = [*enumerate(texts), (0, texts[0]), (900, texts[3] + texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = lambda size: {
        (r.doc, k) for r in suffix_dedup.repeated_ranges(docs, shard_bytes=size).collect() for k in range(r.start, r.stop)
    }
    seen, want = set(), set()
    for i, t in sorted(set(rows)):
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                want |= {(i, k + j) for j in range(100)}
            seen.add(t[k : k + 100])
    assert ranges(2_000) == want and ranges(10**9) == want and len(want) > 4_000


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_line_dedup_with_heavy_keys_joined_by_salt(spark, max_broadcast):
    rows = [(i, f"a very common line\nanother very common one\nown line {i} here") for i in range(2500)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1])], "doc_id long, text string")
    out = {(r._doc, r.n_dropped) for r in line_dedup.line_keep_bitmaps(docs, heavy_lines=500, max_broadcast=max_broadcast).collect()}
    assert out == {(i, 2) for i in range(1, 2500)}


def test_decontamination_drops_each_set_before_the_next(spark, monkeypatch):
    rows = [(i, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5} w{i + 6} w{i + 7} w{i + 8} other{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(f"b{i}", " ".join(f"w{k}" for k in range(i, i + 12))) for i in range(0, 60, 5)], "item_id string, text string")
    held, most = [], []
    real = decontaminate.Pass.__init__

    def counted(self, *args):
        held[:] = [x for x in held if x.shared._jbroadcast is not None and x.shared._path is not None]
        real(self, *args)
        most.append(sum(len(k[0]) for k in self.shared.value.by_length.values()))

    monkeypatch.setattr(decontaminate.Pass, "__init__", counted)
    names = ("doc_id", "row", "n_words", "array_sort(hits) AS hits", "items")
    many = sorted(map(tuple, decontaminate.scan(docs, items, max_windows=10).selectExpr(*names).collect()))
    assert len(most) > 4 and max(most) < 40
    assert many == sorted(map(tuple, decontaminate.scan(docs, items).selectExpr(*names).collect()))
    assert sum(len(r[3]) > 0 for r in many) > 20


def test_the_network_learns_from_whole_texts(spark, monkeypatch):
    rows = [(i, "é" * (i * 3000), i % 2) for i in range(8)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, q int").drop("q"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_net, "train", lambda texts, y: seen.append([(bytes(t).decode(), int(k)) for t, k in zip(texts, y, strict=True)]))
    quality_net.fit(docs.unionAll(docs), labels)
    assert seen[0] == [(t, q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    # The gradient of a text of many chunks is that of all of them.
    net, rng = quality_net.Net(3), np.random.default_rng(6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = rng.integers(0, 256, 40_000).astype(np.uint8)
    x = quality_net._chunks(data, quality_net.chunk_starts(len(data)), len(data))
    g = net.gradients(x, np.array([0]), np.array([1.0]), np.array([1.0]))
    loss = lambda: -np.log(net.probability(net.hidden(x).max(0, keepdims=True)))[0]
    for name in ("hidden", "filter", "embed"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][k] += 1e-5
        high = loss()
        net.p[name][k] -= 2e-5
        low = loss()
        net.p[name][k] += 1e-5
        assert abs((high - low) / 2e-5 - g[name][k]) < 0.02 * abs(g[name][k]) + 1e-5


def test_scores_are_those_of_a_plain_convolution(spark):
    net = quality_net.Net(9)
    rng = np.random.default_rng(5)
    texts = ["", None, "short", "é" * 300, "".join(chr(97 + x) for x in rng.integers(0, 26, 1000)), "ab " * 4000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in quality_net.scores(docs, net).collect()}
    p = {k: v.astype(float) for k, v in net.p.items()}
    for i, text in enumerate(texts):
        raw = list((text or "").encode())
        top = np.zeros(quality_net.HIDDEN)
        start = 0
        while True:
            chunk = raw[start : start + quality_net.CHUNK]
            padded = chunk + [quality_net.PAD] * (quality_net.CHUNK - len(chunk))
            best = np.full(quality_net.FILTERS, -np.inf)
            for at in range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE):
                best = np.maximum(best, np.concatenate([p["embed"][b] for b in padded[at : at + quality_net.WIDTH]]) @ p["filter"])
            units = np.append(np.maximum(best + p["filter_0"], 0), len(chunk) / quality_net.CHUNK) @ p["hidden"] + p["hidden_0"]
            top = np.maximum(top, units)
            if start + quality_net.CHUNK >= len(raw):
                break
            start += quality_net.STEP
        assert abs(found[i] - 1 / (1 + math.exp(-(top @ p["out"] + p["out_0"][0])))) < 1e-4


def test_url_templates_pool_what_stands_below_merged_branches(spark):
    """Two sections of three pages are few on their own; merged, their children are judged on the sum of both."""
    urls, labels = [], []
    for section in ("a", "b"):
        for kind, good in (("post", 1), ("spam", 0)):
            for i in range(3):
                urls.append((len(urls), f"http://h.net/{section}/{kind}/{i}"))
                labels.append((urls[-1][1], good))
    urls.append((99, "http://h.net/a/post/x/y/z/deep"))
    df, known = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "url string, good int")
    out = {r.page_id: (r.template, r.verdict) for r in url_filter.url_verdicts(df, known).collect()}
    # Below post stands a lone x, so it and the numbers are merged too; a path that shares no template stays as it is.
    want = {i: ("/(*)/spam/*", "block") if "spam" in u else ("/(*)/post/(*)", "allow") for i, u in urls if i < 99}
    assert out == want | {99: ("/(*)/post/(*)/y/z/deep", "allow")}


def test_url_verdicts_of_a_frequent_path_are_joined_in_shares(spark, monkeypatch):
    rows = [(i, f"http://h.net/p/{i}" if i % 3 else f"http://g.net/q{i % 7}") for i in range(3000)]
    df = spark.createDataFrame([*rows, rows[0], (None, None)], "page_id long, url string")
    whole = sorted(map(str, url_filter.url_verdicts(df).collect()))
    monkeypatch.setattr(url_filter, "HOT_PAGES", 100)
    assert sorted(map(str, url_filter.url_verdicts(df).collect())) == whole and len(whole) == 3002
