"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodemill.llm import decontaminate, html_extract, line_dedup, near_dup, packing, quality_net, quality_rules, sharding, suffix_dedup, url_filter
from lodemill.llm.queries import vocabulary

LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, "first line of a text\nshort\nfirst line of a text"), (2, "  FIRST line of a text\t\nsecond line of a text"), (3, None), (4, ""), (None, "second line of a text"),
    (5, LONG), (5, LONG), (6, LONG), (7, "\n\n"), (8, "été à la plage, été à la plage"), (9, " \t\n"),
]
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("keep", "lines", "kept", "n_dropped", "d", "_id", "_doc", "_row", "row", "hits", "n", "block", "shard")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [("b1", "word1 word2 word3 word4 word5 word6 word7 word8 word9"), ("b2", "Plage été"), (None, None), ("b3", ""), ("b2", "à LA")]
    return spark.createDataFrame(rows, "item_id string, text string")


def test_quality_rules(docs, none, labels):
    out = quality_rules.quality_rules(docs, labels).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert (by[1].n_words, by[1].n_dup_lines, by[1].n_repeat_words, by[1].base_failed) == (11, 1, 10, True)
    assert (by[3].n_words, by[3].word_chars, by[3].score, by[3].kept) == (0, 0, 0.0, False)
    assert by[8].word_chars == sum(len(w) for w in ROWS[9][1].split())
    assert by[5].n_words == 3000 and not by[5].base_failed
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).filter("score <> 0").count() == 0


def test_url_filter(spark):
    rows = [(1, "HTTP://A.Example.ORG/en/1?q"), (2, "http://example.org/es/x"), (3, "x.com/fr/"), (4, None), (5, "s://b.com/fr/a#t"), (6, "s://x.net"), (6, "s://x.net"), (None, "://com/de/://")]
    urls = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(urls).collect()]
    assert sorted(out, key=str) == sorted(
        [
            (1, "a.example.org", "/en/1", "example.org/en/1", "block"), (2, "example.org", "/es/x", "example.org/es/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
            (5, "b.com", "/fr/a", "com/fr/", "allow"), (6, "x.net", "", None, "allow"), (6, "x.net", "", None, "allow"), (None, "com", "/de/://", "com/de/", "block"),
        ],
        key=str,
    )
    assert url_filter.url_verdicts(urls.limit(0)).count() == 0


def test_url_filter_rejects_a_bad_template_and_merges_like_ones(spark):
    urls, labels = [], []
    for i in range(40):
        for section, good in (("news", 1), ("blog", 1), ("spam", 0)):
            url = f"http://h.net/{section}/{i}.html"
            urls.append((len(urls), url))
            if i < 20:
                labels.append((url, good))
    df, known = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "url string, good int")
    out = url_filter.url_verdicts(df, known).collect()
    assert {(r.template, r.verdict) for r in out if "/spam/" in r.path} == {("/spam/*", "block")}
    assert {r.verdict for r in out if "/spam/" not in r.path} == {"allow"}


def test_sharding(spark, docs, none):
    out = sharding.balanced_shards(docs, n_shards=3).collect()
    sizes = [sum(r.shard == s for r in out) for s in range(3)]
    assert len(out) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert {(r.doc_id, r.size) for r in out if r.doc_id in (3, 4)} == {(3, 8), (4, 8)}
    assert sharding.balanced_shards(none).count() == 0
    # A text with most of the rows fills whole shards; other copies stay together.
    rows = [(i, "hot" if i < 600 else f"t{i // 4}") for i in range(1000)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=10).collect()
    assert {sum(r.shard == s for r in out) for s in range(10)} == {100}
    hot = zlib.crc32(b"hot")
    assert len({r.shard for r in out if r.text_crc32 == hot}) <= 7
    groups = {}
    for r in out:
        if r.text_crc32 != hot:
            groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 40


def test_line_dedup(docs, none):
    out = {}
    for r in line_dedup.line_digest(docs).collect():
        out.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.kept_sha256))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # A null id is the smallest, so its line stays and document 2 loses both of its lines.
    assert out[None] == [(1, 0, sha("second line of a text"))]
    assert out[1] == [(3, 0, sha(ROWS[0][1]))]
    assert out[2] == [(2, 2, EMPTY)]
    assert out[3] == out[4] == [(1, 0, EMPTY)] and out[7] == [(3, 0, sha("\n\n"))]
    assert out[5] == [(1, 0, sha(LONG))] * 2 and out[6] == [(1, 1, EMPTY)]
    assert line_dedup.line_digest(none).count() == 0
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 1 and kept.filter("doc_id = 2 and text = ''").count() == 1


def test_line_dedup_with_a_heavy_line_and_many_lines(spark):
    many = "\n".join(f"line number {i}" for i in range(500))
    rows = [(i, f"a very common line\nown line {i} here") for i in range(3000)] + [(9000, many), (9001, many + "\nanother line")]
    out = {r.doc_id: r for r in line_dedup.line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 1 for i in range(1, 3000))
    assert out[9000].n_dropped == 0 and out[9001].n_dropped == 500
    assert out[9001].kept_sha256 == hashlib.sha256(b"another line").hexdigest()


def test_suffix_dedup(docs, none, spark):
    out = {}
    for r in suffix_dedup.drop_repeats(docs).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    n = len(LONG)
    assert out[5] == [(n, 0, 0, hashlib.sha256(LONG.encode()).hexdigest())] * 2 and out[6] == [(n, n, 1, EMPTY)]
    assert out[3] == out[4] == [(0, 0, 0, EMPTY)] and None in out
    assert suffix_dedup.drop_repeats(none).count() == 0
    run = spark.createDataFrame([(1, "a" * 150), (2, "b" + "a" * 99 + "c"), (3, "x" * 99)], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.drop_repeats(run).collect()} == {1: (149, 1), 2: (0, 0), 3: (0, 0)}


def test_html_extraction(spark):
    page = "<body><nav>menu</nav><div class='post-7'><h1>Title</h1><p>One &amp; two,\n three<p>Four <b>five</b></div><div id=comments><p>no</p></div><footer>f</footer>"
    rows = [(1, "http://a.b/x", page), (2, "http://a.b/y", page.replace("post-7", "post-8")), (3, None, None), (4, "", ""), (5, "x", "plain"), (5, "x", "plain"), (None, "http://a.b/z", "<script>var a='</p>';</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    out = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_text(pages).collect()]
    text = "Title\nOne & two, three\nFour five"
    assert sorted(out, key=str) == sorted([(1, text, len(text)), (2, text, len(text)), (3, "", 0), (4, "", 0), (5, "plain", 5), (5, "plain", 5), (None, "", 0)], key=str)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_quality_classifier(docs, none, labels):
    out = quality_net.quality_scores(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert quality_net.quality_scores(none, labels).count() == 0
    assert quality_net.keep_good(docs, labels.limit(0), predict_at=0.0).columns == docs.columns


def test_near_duplicates(spark, docs, none):
    classes, links = near_dup.near_duplicates(docs)
    found = {r.doc_id: r for r in classes.collect()}
    assert links.count() == 0
    assert found[6].class_id == found[5].class_id == 5 and found[6].n_links == 2
    assert {found[i].class_id for i in (3, 4, 7, 9)} == {3}
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted([None, 1, 2, 3, 5, 8], key=str)
    assert near_dup.near_duplicates(none)[0].count() == 0


def test_decontamination(spark, docs, none, benchmark):
    out = {}
    for r in decontaminate.scan_digest(docs, benchmark).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[3] == out[4] == [(0, 0, 0, EMPTY, False)]
    assert out[5] == [(3000, 9, 1, sha("b1"), False)] * 2
    assert out[8] == [(8, 6, 1, sha("b2"), False)]
    assert decontaminate.scan_digest(none, benchmark).count() == 0
    assert decontaminate.scan_digest(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    # Several sets of windows give the same result as one.
    one, many = (decontaminate.scan(docs, benchmark, max_windows=k).selectExpr("doc_id", "row", "n_words", "array_sort(hits)", "items") for k in (1000, 1))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    cut = decontaminate.decontaminate(docs, benchmark, remove="spans", min_items=1)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert cut.filter("doc_id = 6").first().text == LONG.replace(benchmark.first().text, "")
    assert decontaminate.decontaminate(docs, benchmark, min_items=1).count() == len(ROWS) - 4


def test_packing(docs, none, spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = packing.pack(docs, vocabulary(), length=256).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert sum(r.length for r in out) == total
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 256 and len(used) == -(-total // 256)
    assert all(r.length == 256 for r in out if r.piece > 0)
    assert packing.pack(none, vocabulary()).count() == 0
