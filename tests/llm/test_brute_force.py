"""Operators that SQL can't express, against plain Python, and models on held-out rows."""

import collections
import hashlib
import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodemill.llm import near_dup, packing, quality_net, sharding, suffix_dedup
from lodemill.llm._base import Scratch
from lodemill.llm.queries import vocabulary
from lodemill.llm.suffix_sort import SuffixOrder, later_repeats
from lodemill.llm.tokens import encode_column

SF = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=2, max_size=120), st.integers(1, 20), st.sampled_from([64, 1 << 20]))
def test_suffix_order(values, cap, limit):
    text = np.array([*values, 0], np.int16)
    found = np.concatenate(list(SuffixOrder(text, cap, limit).ordered()))
    keys = [text[p : p + cap].tolist() for p in found["pos"]]
    assert sorted(found["pos"]) == list(range(len(text))) and keys == sorted(keys)
    for a, b, lcp in zip(found["pos"], found["pos"][1:], found["lcp"][1:], strict=False):
        same = next((k for k in range(cap) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), cap)
        assert same == lcp
    seen, later = set(), []
    for i in range(len(text) - cap + 1):
        w = tuple(text[i : i + cap])
        if min(w) > 1:
            later += [i] * (w in seen)
            seen.add(w)
    assert later_repeats(text, cap, limit).tolist() == later


@with_tables
def test_suffix_dedup(docs):
    found = {r.doc_id: r for r in suffix_dedup.drop_repeats(docs).collect()}
    seen = set()
    for r in docs.orderBy("doc_id").collect():
        raw = r.text.encode()
        gone, end = bytearray(len(raw)), 0
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[max(k, end) : k + 100] = b"\1" * (k + 100 - max(k, end))
                end = k + 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        assert (found[r.doc_id].n_removed, found[r.doc_id].n_spans, found[r.doc_id].kept_sha256) == (sum(gone), spans, hashlib.sha256(kept).hexdigest())


def _near_copies(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 300)))]
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for k in rng.integers(0, len(own), int(rng.integers(0, 6))):
                own[k] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_duplicates_find_all_links(spark):
    rows = _near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes, links = near_dup.near_duplicates(df, all_pairs=True)
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    first = {}
    node = {i: first.setdefault(s, i) for i, s in sets.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(set(node.values())), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.x, r.y) for r in links.collect()} == want and len(want) > 20
    top = {i: i for i in node.values()}
    for _ in top:
        for a, b in want:
            top[a] = top[b] = min(top[a], top[b])
    copies = collections.Counter(node.values())
    for r in classes.collect():
        near = sum(copies[b if a == node[r.doc_id] else a] for a, b in want if node[r.doc_id] in (a, b))
        assert (r.node, r.class_id, r.n_links) == (node[r.doc_id], top[node[r.doc_id]], near + copies[node[r.doc_id]] - 1)


def test_large_trie_nodes_are_compared_in_blocks(spark):
    rows = _near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    nodes = scratch.written(near_dup.sets_of(near_dup.signatures(df, 100)))
    group = lambda links: {(r.node, r.group) for r in near_dup.components(links, scratch).collect()}
    (one, depth, recall), (many, same_depth, same_recall) = (near_dup.candidates(nodes, scratch, 20, 5, 4, block=block) for block in (512, 2))
    assert group(one) == group(many) and (depth, recall) == (same_depth, same_recall)
    groups = near_dup.components(one, scratch)
    whole, blocks = ({(r.x, r.y, round(r.jaccard, 6)) for r in near_dup.verified(df, nodes, groups, all_pairs=True, block=b).collect()} for b in (256, 2))
    assert whole == blocks and len(whole) > 20


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    scratch = Scratch(spark, "test")
    rng = np.random.default_rng(1)

    def depth_of(changes):
        """Pairs of texts that differ in some words."""
        rows = []
        for _ in range(150):
            base = [f"w{x}" for x in rng.integers(0, 9999, 400)]
            other = list(base)
            for k in rng.choice(400, changes, replace=False):
                other[k] = f"x{rng.integers(0, 10**6)}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
        nodes = scratch.written(near_dup.sets_of(near_dup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 160)))
        links, depth, recall = near_dup.candidates(nodes, scratch, target=0.9985)
        return depth, recall, links.count()

    alike, apart = depth_of(1), depth_of(7)
    assert alike[0] > apart[0] and min(alike[1], apart[1]) >= 0.9985 and min(alike[2], apart[2]) >= 149
    # Without any pair the supposed one at the threshold decides.
    assert near_dup.expected_recall({}, 20, 5, 0.8) == 1 - (1 - 0.8**5) ** 20
    # Each pair of one tree is compared at one level only: events add up to those of the shortest prefix alone.
    rows = spark.createDataFrame(_near_copies(9), "doc_id long, text string")
    trie = scratch.written(near_dup.forest_of(near_dup.sets_of(near_dup.signatures(rows, 160)), 20, 8, 4))
    met = lambda at, depth: near_dup.level_links(trie, at, depth, 0.8, 160).groupBy().sum("met").first()[0] or 0
    assert sum(met(at, 8) for at in range(4, 9)) == met(4, 4) > 100


@with_tables
def test_tokens_and_plan(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [r.text for r in docs.limit(60).collect()] + ["a  b ", "\u00a0x \u2003 y z\u3000", "it's 'll  d\n\n e", "日本 語 テスト a", "<|endoftext|> a", "é è", ""]
    ids, at = encode_column(pa.array(texts), vocabulary())
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(x, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=20))
def test_best_fit_plan(counts):
    runs, opened = packing.plan(counts, 64)
    used = collections.Counter()
    for size, n in counts.items():
        found = sorted(runs.get(size, []))
        for rank in range(n):
            first, sequence, offset = max(r for r in found if r[0] <= rank)
            used[sequence + rank - first] += size
            assert offset + size <= 64
    assert all(v <= 64 for v in used.values()) and set(used) == set(range(opened))
    # No two sequences could be one: best fit, largest first, leaves at most one that is half full or less.
    assert sum(v <= 32 for v in used.values()) <= 1


def test_the_network_learns_from_rows_that_are_not_held_out(spark):
    rng = np.random.default_rng(0)
    words = ["the", "river", "runs", "over", "old", "stones", "and", "sings"]
    rows, labels = [], []
    for i in range(500):
        text = " ".join(rng.choice(words, int(rng.integers(20, 200))))
        good = int(rng.random() < 0.7)
        rows.append((i, text + ". End." if good else text.replace(" ", "$$$ ")))
        labels.append((i, good))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality_net.quality_scores(df, known).filter("held_out").join(known, "doc_id").collect()
    assert len(out) > 80 and sum(r.predicted == r.quality for r in out) / len(out) > 0.95


def test_gradients():
    net, rng = quality_net.Net(), np.random.default_rng(1)
    x = rng.integers(0, 257, (5, quality_net.CHUNK)).astype(np.int16)
    first, y, w = np.array([0, 2]), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        top = np.maximum.reduceat(np.maximum(net.pooled(x) @ net.p["hidden"] + net.p["hidden_0"], 0), first)
        p = net.probability(top)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    g = net.gradients(x, first, y, w)
    for name in ("out", "hidden", "filter", "embed"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][k]
        net.p[name][k] = old + 1e-4
        high = loss()
        net.p[name][k] = old - 1e-4
        low = loss()
        net.p[name][k] = old
        assert abs((high - low) / 2e-4 - g[name][k]) < 0.02 * abs(g[name][k]) + 1e-4


def test_supersteps_in_spark_are_those_of_the_plan(spark):
    rng = np.random.default_rng(8)
    counts = collections.Counter(np.minimum(256, 1 + rng.geometric(0.01, 4000)).tolist()) + collections.Counter({1: 900, 7: 2000, 256: 40})
    runs, opened = packing.plan(counts, 256)
    table = spark.createDataFrame(sorted(counts.items()), "length long, n long")
    found = collections.defaultdict(list)
    for r in packing.supersteps(table, 256, Scratch(spark, "test")).collect():
        found[r.size].append((r.lo, r.sequence, r.offset))
    assert {k: sorted(v) for k, v in found.items()} == runs
    # Against best fit, largest first, one piece after the other.
    gaps = []
    for size in sorted(counts.elements(), reverse=True):
        k = min((i for i in range(len(gaps)) if gaps[i] >= size), key=lambda i: gaps[i], default=None)
        if k is None:
            gaps.append(256)
            k = len(gaps) - 1
        gaps[k] -= size
    assert -(-sum(s * n for s, n in counts.items()) // 256) <= opened <= len(gaps) + 1


@with_tables
def test_packed_ids_and_places_of_every_document(docs, spark):
    """Every piece's ids are those of the tokenizers call on its whole text, and no two pieces share a place."""
    import zlib

    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(80).collect()] + [(-1, None), (-2, ""), (-3, "a <|endoftext|>b<|endoftext|>"), (-4, "word " * 30_000)]
    out = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect():
        out[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        want, end = [], len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(end, len(ids), 2048)]):
            stop = end if k == 0 else start + 2048
            want.append((k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
        assert sorted(out[i]) == want
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 2048


@pytest.mark.parametrize("singles", [0, 60, 4000])
def test_sharding_cuts_few_texts(spark, singles):
    """Whole groups in even shards: the best that any assignment can do cuts none, and a line cuts one at each end."""
    import zlib

    rng = np.random.default_rng(singles)
    rows, sizes = [], rng.integers(2, 31, 500).tolist()
    for g, n in enumerate(sizes):
        rows += [f"text {g}"] * n
    rows += [f"single {k}" for k in range(singles)]
    order = rng.permutation(len(rows))
    table = [(int(i), rows[i]) for i in order] + [(int(order[0]), rows[order[0]])] * 5
    out = sharding.balanced_shards(spark.createDataFrame(table, "doc_id long, text string")).collect()
    counts = collections.Counter(r.shard for r in out)
    assert len(out) == len(table) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    texts = dict(table)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((i, len(t) + 8, zlib.crc32(t.encode())) for i, t in table)
    held = collections.defaultdict(set)
    for r in out:
        held[texts[r.doc_id]].add(r.shard)
    cut = [t for t, s in held.items() if len(s) > 1]
    assert len(cut) <= 23 and all(len(held[t]) == 2 for t in cut)
    # The cut in links, against the same documents dealt in turn.
    def links(where):
        n = collections.Counter((texts[r.doc_id], where(i, r)) for i, r in enumerate(out))
        return sum(x * x for x in collections.Counter(texts[r.doc_id] for r in out).values()) - sum(x * x for x in n.values())

    assert links(lambda i, r: r.shard) < 0.1 * links(lambda i, r: i % 24)


@pytest.mark.parametrize("each", [500_000, 7])
def test_components(spark, monkeypatch, each):
    monkeypatch.setattr(near_dup, "CONTRACTED", each)
    rng = np.random.default_rng(3)
    links = [(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1100)]
    top = {}
    for a, b in links * 200:
        top[a] = top[b] = min(top.get(a, a), top.get(b, b))
    found = near_dup.components(spark.createDataFrame(links, "x long, y long"), Scratch(spark, "test")).collect()
    assert {r.node: r.group for r in found} == top
    assert near_dup.components(spark.createDataFrame([], "x long, y long"), Scratch(spark, "test")).count() == 0


def test_near_duplicates_write_few_files(spark):
    """Rounds over few links, sets and classes are no written tables: with many partitions each is a file a partition."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    files = lambda scratch: sum(f.startswith("part-") for _, _, names in os.walk(scratch.root.removeprefix("file:")) for f in names)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        few, all_of_it = Scratch(spark, "few"), Scratch(spark, "all")
        links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10], "x long, y long")
        assert {(r.node, r.group) for r in near_dup.components(links, few).collect()} == {(k, (k - 1) // 10 * 10 + 1) for k in range(1, 301)}
        assert files(few) == 1
        rows = _near_copies(5)
        classes, _ = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch=all_of_it)
        assert classes.count() == len(rows)
        levels = near_dup.DEPTH - near_dup.MIN_DEPTH + 1
        # Rows, then nodes, tries, levels, members and links by partition, and one file for either set of components.
        assert files(all_of_it) <= 4 + 40 * (4 + levels) + 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
