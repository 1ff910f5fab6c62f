"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is the set of its runs of five words (all its words, if they are one to four). Documents with equal sets
are one node, named by a hash of its set, so copies never meet each other again. Two nodes are linked when the Jaccard
similarity of their sets is at least the threshold.

The forest: every node has ``trees`` sequences of ``depth`` min-hashes. In each tree the nodes are sorted by their
sequences, so the members of a trie node of any depth stand together. Matching starts with whole sequences and shortens
the matched prefix by one level at a time; at each level only pairs are compared that share this prefix and no longer one
in that tree. All their min-hashes (eight bits each) say how similar a pair is. From the pairs met so far the number of
pairs that have not been met in any tree is estimated (a pair of similarity s meets in a tree with probability s to the
power of the depth), with one pair more that is just at the threshold; shortening goes on until the expected recall reaches
the target, or ``min_depth``. What looks alike makes candidate groups. In each of them all pairs are compared by their
exact sets, whichever tree they met in.

Pairs stay inside the tasks: a comparison gives its members' link counts and a spanning forest of their links, a row
for each member. A trie node or a group with many members is cut into blocks, and each pair of blocks is compared on its
own, so no group has to fit into a task and none is capped. Blocks of sets grow with the group, so that a set is copied
16 times at most in groups of up to 65,536, and once for 4096 members beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, byte_slices, packed
from lodemill.llm.ranking import ranked
from lodemill.llm.textblock import NOT_SPACE, TextBlock, mix, windows

N = 5
THRESHOLD = 0.8
TREES, DEPTH, MIN_DEPTH = 20, 8, 4
TARGET_RECALL = 0.9999
#: Members of a trie node that one task compares with each other or with as many others.
BLOCK = 512
#: Members of a group whose exact sets one comparison holds, twice: a share of the group between these.
EXACT_BLOCK, EXACT_SHARE, MAX_EXACT_BLOCK = 256, 16, 4096
#: Members of a group that one task numbers.
NUMBERED = 50_000
#: Links of which a task keeps a spanning forest.
CONTRACTED = 500_000
NULL_ID = -(1 << 63)


def expected_recall(met: dict[float, int], trees: int, depth: int, threshold: float) -> float:
    """Expected share of the pairs at or above the threshold that met in any tree at this depth.

    met: similarity -> how often pairs of it met, a pair counted once for each tree. One pair more is supposed to be at
    the threshold, so that a table in which nothing met is no proof that there is nothing.
    """
    found = lambda s: 1 - (1 - s**depth) ** trees
    pairs = {s: n / (trees * s**depth) for s, n in met.items() if s >= threshold}
    return (sum(n * found(s) for s, n in pairs.items()) + found(threshold)) / (sum(pairs.values()) + 1)


def shingles(block: TextBlock, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingles of each text; text i has hashes[first[i]:first[i + 1]]."""
    words = block.words(NOT_SPACE)
    single = block.hashes(words.starts, words.ends)
    h, at = windows(single, words, n)
    all_hashes, all_texts = [h], [words.text[at]]
    counts = words.counts()
    for k in range(1, n) if (counts < n).any() else ():
        h, at = windows(single, words, k)
        short = counts[words.text[at]] == k
        all_hashes.append(h[short])
        all_texts.append(words.text[at][short])
    h, text = np.concatenate(all_hashes), np.concatenate(all_texts)
    order = np.lexsort((h, text)) if block.n > 1 else np.argsort(h)
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(block.n + 1))


def _set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x51ED2701A3C5B79D, 0x2545F4914F6CDD1D):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, slots: int, n: int = N) -> DataFrame:
    """id, row (hash of the text), k1 and k2 (name of the set), n (its size) and mh (``slots`` min-hashes of 32 bits) of
    every row. A null id is NULL_ID."""
    rng = np.random.default_rng(77)
    flips, factors = rng.integers(0, 1 << 32, slots, dtype=np.uint32), rng.integers(0, 1 << 31, slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            block = TextBlock(batch.column("text"))
            h, first = shingles(block, n)
            size = np.diff(first)
            full = np.flatnonzero(size)
            low = (h >> np.uint64(32)).astype(np.uint32)
            mh = np.zeros((block.n, slots), "<u4")
            if len(full):
                for k in range(slots):
                    mh[full, k] = np.minimum.reduceat((low ^ flips[k]) * factors[k], first[full])
            k1, k2 = _set_keys(h, first)
            packed_rows = pa.array([r.tobytes() for r in mh], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(k1), pa.array(k2), pa.array(size), packed_rows], names=["id", "row", "k1", "k2", "n", "mh"])

    rows = docs.select(_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "id long, row long, k1 long, k2 long, n long, mh binary")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def sets_of(rows: DataFrame) -> DataFrame:
    """The nodes: a row for each distinct set, with how many rows have it (members) and the first of them (id, row)."""
    found = rows.groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("r"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("mh").alias("mh"))
    return found.select(F.col("k1").alias("node"), "k1", "k2", "r.id", "r.row", "members", "n", "mh")


def _prefixes(mh: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """(rows, depth): hashes of the prefixes of all lengths; prefixes of different trees never agree."""
    key = mix(tree.astype(np.uint64) + np.uint64(1))
    out = np.empty((len(mh), depth), np.int64)
    for k in range(depth):
        key = mix(key * np.uint64(31) + mh[:, k].astype(np.uint64) + np.uint64(1))
        out[:, k] = key.view(np.int64)
    return out


def forest_of(nodes: DataFrame, trees: int, depth: int, min_depth: int) -> DataFrame:
    """The tries, without what shares no prefix of min_depth with any other: node, n, sig (all min-hashes, eight bits
    each) and prefix (hashes of the prefixes of all lengths), a row for each node and tree."""
    nodes = nodes.filter("n > 0").select("node", "n", "mh")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mh = np.frombuffer(b"".join(batch.column("mh").to_pylist()), "<u4").reshape(batch.num_rows * trees, depth)
                tree = np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)
                node = np.repeat(batch.column("node").to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(_prefixes(mh, tree, min_depth)[:, -1]), pa.array(node)], names=["tree", "bucket", "node"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mh = np.frombuffer(b"".join(batch.column("mh").to_pylist()), "<u4").reshape(batch.num_rows, trees, depth)
                tree = batch.column("tree").to_numpy()
                prefix = _prefixes(mh[np.arange(len(mh)), tree], tree, depth)
                sig = ((mh.reshape(len(mh), -1) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                arrays = [batch.column("node"), batch.column("n"), pa.array([r.tobytes() for r in sig], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(prefix.ravel()), depth).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "sig", "prefix"])

    leaf = nodes.select("node", "mh").mapInArrow(leaves, "tree int, bucket long, node long")
    shared = leaf.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket")
    met = leaf.join(shared, "bucket", "left_semi").select("tree", "node")
    return met.join(nodes, "node").select("node", "n", "tree", "mh").mapInArrow(grown, "node long, n long, sig binary, prefix array<long>")


def _compare(threshold: float, slots: int):
    """Compare the runs of (bucket, a, b): a forest of what looks alike, and how often pairs agree in how many slots."""
    # Eight bits a slot agree by chance in 1 of 256; 4.5 standard errors below the threshold loses no pair to speak of.
    least = (threshold - 4.5 * (threshold * (1 - threshold) / slots) ** 0.5) * slots

    def pairs(run_id: np.ndarray, cross: np.ndarray, block: np.ndarray, deeper: np.ndarray, node: np.ndarray, size: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right, met = [], [], np.zeros(slots + 1, np.int64)
        for d in range(1, len(run_id)):
            i = np.flatnonzero(run_id[d:] == run_id[:-d])
            if not len(i):
                break
            j = i + d
            # Only pairs that no longer prefix brought together before.
            ok = (~cross[i] | (block[i] != block[j])) & (deeper[i] != deeper[j]) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            if len(i):
                same = (sig[i] == sig[j]).sum(1)
                met += np.bincount(same, minlength=slots + 1)
                ok = same >= least
                left.append(np.minimum(node[i][ok], node[j][ok]))
                right.append(np.maximum(node[i][ok], node[j][ok]))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(left or empty), np.concatenate(right or empty), met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots + 1, np.int64)
        for rows in whole_runs(batches, ("bucket", "a", "b"), 4096):
            rows = rows.combine_chunks()
            columns = {c: rows.column(c).to_numpy() for c in ("bucket", "a", "b", "block", "deeper", "node", "n")}
            change = np.zeros(rows.num_rows, bool)
            for c in ("bucket", "a", "b"):
                change[1:] |= columns[c][1:] != columns[c][:-1]
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(rows.num_rows, slots)
            x, y, met = pairs(np.cumsum(change), columns["a"] != columns["b"], columns["block"], columns["deeper"], columns["node"], columns["n"], sig)
            total += met
            x, y = forest(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), -1, np.int32)), pa.array(np.zeros(len(x), np.int64))], names=["x", "y", "same", "met"])
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int64)), pa.array(np.zeros(len(k), np.int64)), pa.array(k.astype(np.int32)), pa.array(total[k])], names=["x", "y", "same", "met"])

    return run


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows that never end inside a run of rows with equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            # With the last row before it: a run may go on.
            values = [np.concatenate([held[-1].column(c).to_numpy()[-1:] if held else part.column(c).to_numpy()[:1], part.column(c).to_numpy()]) for c in keys]
            change = np.zeros(part.num_rows, bool)
            for v in values:
                change |= v[1:] != v[:-1]
            at = np.flatnonzero(change)
            if len(at):
                cut = int(at[-1])
                if held or cut:
                    yield pa.Table.from_batches([*held, part.slice(0, cut)])
                held = [part.slice(cut)]
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest member, other member) that connect what the pairs connect, one for each other member."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _numbered(df: DataFrame, key: str, total: int) -> DataFrame:
    """df with ``place`` inside each key, in two levels: no task numbers a key alone."""
    block = F.pmod(F.xxhash64("node"), F.lit(max(1, total // NUMBERED))).cast("int")
    return ranked(df.withColumn("block", block), [key], ["n", "node"], "place").drop("block")


def level_links(trie: DataFrame, at: int, depth: int, threshold: float, slots: int, block: int = BLOCK) -> DataFrame:
    """(x, y, same, met) of ``_compare`` for the pairs that share a prefix of length ``at`` and no longer one."""
    deeper = F.col("node") if at == depth else F.get("prefix", F.lit(at))
    rows = trie.select(F.get("prefix", F.lit(at - 1)).alias("bucket"), deeper.alias("deeper"), "node", "n", "sig")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("deeper").alias("lo"), F.max("deeper").alias("hi"))
    rows = rows.join(sizes.filter("lo <> hi").select("bucket", "members"), "bucket")
    zero = [F.lit(0).alias(c) for c in ("a", "b", "block")]
    small = rows.filter(F.col("members") <= block).select("bucket", *zero, "deeper", "node", "n", "sig")
    large = rows.filter(F.col("members") > block)
    n_large = large.count()
    if n_large:
        large = _numbered(large, "bucket", n_large).withColumn("block", (F.col("place") / block).cast("int"))
        other = F.explode(F.sequence(F.lit(0), ((F.col("members") - 1) / block).cast("int")))
        large = large.withColumn("other", other).select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "deeper", "node", "n", "sig")
        small = small.unionByName(large)
    dealt = small.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.mapInArrow(_compare(threshold, slots), "x long, y long, same int, met long")


def candidates(
    nodes: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH, min_depth: int = MIN_DEPTH, threshold: float = THRESHOLD, target: float = TARGET_RECALL, block: int = BLOCK
) -> tuple[DataFrame, int, float]:
    """((x, y), x < y: links that connect the nodes that share a trie node and look similar by all their min-hashes; the
    depth to which prefixes were shortened; the expected recall there)."""
    slots = trees * depth
    trie = scratch.written(forest_of(nodes, trees, depth, min_depth))
    links, met = None, {}
    for at in range(depth, min_depth - 1, -1):
        found = scratch.written(level_links(trie, at, depth, threshold, slots, block))
        here = found.filter("same < 0").select("x", "y")
        links = here if links is None else links.unionByName(here)
        for r in found.filter("same >= 0").groupBy("same").agg(F.sum("met").alias("met")).collect():  # at most a row for each slot
            met[r["same"] / slots] = met.get(r["same"] / slots, 0) + r["met"]
        recall = expected_recall(met, trees, at, threshold)
        if recall >= target:
            break
    return links.distinct(), at, recall


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between sorted sets, as a matrix; sets come as arrays of hashes."""
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    # Shingles of one set alone don't count; the rest is taken some thousands at a time.
    column = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    column, owner = column[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (low, low + width))
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[owner[i:j], column[i:j] - low] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _exact(threshold: float, all_pairs: bool):
    """Compare the runs of (group, a, b): link counts and a spanning forest of the links, or all linked pairs."""

    def compared(rows: pa.Table) -> list[tuple]:
        rows = rows.combine_chunks()
        node, block, size, members = (rows.column(c).to_numpy() for c in ("node", "block", "n", "members"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        cross = rows.column("a")[0] != rows.column("b")[0]
        one = np.flatnonzero(block == rows.column("a")[0].as_py())
        two = np.flatnonzero(block == rows.column("b")[0].as_py()) if cross else one
        common = _overlaps([sets[i] for i in one], [sets[i] for i in two])
        jaccard = common / np.maximum(1, size[one][:, None] + size[two][None, :] - common)
        # One rounding of the quotient doesn't decide.
        linked = common >= threshold * (size[one][:, None] + size[two][None, :] - common) - 1e-6
        if not cross:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked if cross else np.triu(linked))
        x, y = np.minimum(node[one[i]], node[two[j]]), np.maximum(node[one[i]], node[two[j]])
        if all_pairs:
            return [(x, y, jaccard[i, j].astype(np.float64), np.zeros(len(x), np.int64))]
        p, q = forest(x, y)
        out = [(p, q, np.zeros(len(p)), np.zeros(len(p), np.int64))]
        for own, weights in ((one, linked @ members[two]), *([(two, linked.T @ members[one])] if cross else [])):
            some = weights > 0
            out.append((node[own][some], node[own][some], np.zeros(some.sum()), weights[some].astype(np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ("group", "a", "b"), 256):
            keys = [rows.column(c).to_numpy() for c in ("group", "a", "b")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            found: list[tuple] = []
            for i, j in zip([0, *change], [*change, rows.num_rows], strict=True):
                if j - i > 1:
                    found += compared(rows.slice(i, j - i))
            if found:
                arrays = [np.concatenate([f[k] for f in found]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["x", "y", "jaccard", "others"])

    return run


def verified(
    docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, n: int = N, all_pairs: bool = False, block: int = EXACT_BLOCK, scratch: Scratch | None = None
) -> DataFrame:
    """(x, y, jaccard, others): links between the members of each group by their exact sets.

    By default rows with x < y are a spanning forest of the links, and rows with x = y say how many documents
    (``others``) node x is linked to. With ``all_pairs`` every link is a row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sets")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            h, first = shingles(TextBlock(batch.column("text")), n)
            k1, k2 = _set_keys(h, first)
            rows = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(rows, pa.binary())], names=["k1", "k2", "set"])

    members = scratch.written(nodes.select("node", "k1", "k2", "id", "row", "n", "members").join(groups, "node"))
    texts = docs.select(_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    found = texts.join(members.select("id", "row").hint("shuffle_hash"), ["id", "row"], "left_semi").mapInArrow(sets, "k1 long, k2 long, set binary")
    found = found.dropDuplicates(["k1", "k2"])
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    placed = _numbered(members, "group", members.count()).join(sizes, "group")
    width = F.greatest(F.lit(block), F.least(F.lit(MAX_EXACT_BLOCK), (F.col("size") / EXACT_SHARE).cast("int")))
    placed = placed.withColumn("block", (F.col("place") / width).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / width).cast("int"))))
    dealt = placed.select("group", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "k1", "k2", "n", "members")
    dealt = dealt.join(found, ["k1", "k2"]).select("group", "a", "b", "block", "node", "n", "members", "set")
    dealt = dealt.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b")
    return dealt.mapInArrow(_exact(threshold, all_pairs), "x long, y long, jaccard double, others long")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of all links of a task."""
    x, y = [], []
    for batch in batches:
        x.append(batch.column("x").to_numpy())
        y.append(batch.column("y").to_numpy())
    if x:
        x, y = forest(np.concatenate(x), np.concatenate(y))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, group) of all links, which one task has."""
    for batch in _contracted(batches):
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        top = np.unique(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([top, y])), pa.array(np.concatenate([top, x]))], names=["node", "group"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, group): every linked node with the smallest node that it can be reached from.

    Up to CONTRACTED links are the work of one task. More are dealt to tasks of as many, which keep only a spanning forest
    of theirs. Then every round takes the smallest label among the neighbours and then the label of that label; each round
    is a written table. Rounds grow with the logarithm of the longest chain of links. links are read twice.
    """
    links = links.select("x", "y")
    tasks = -(-links.count() // CONTRACTED)
    if tasks <= 1:
        return scratch.written(links.repartition(1).mapInArrow(_labelled, "node long, group long"))
    links = scratch.written(links.repartition(tasks).mapInArrow(_contracted, "x long, y long"))
    edges = scratch.written(links.select(F.col("x").alias("node"), F.col("y").alias("to")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("to"))))
    label = scratch.written(edges.groupBy("node").agg(F.least(F.min("node"), F.min("to")).alias("group")))
    while True:
        seen = edges.join(label.select(F.col("node").alias("to"), F.col("group").alias("theirs")), "to").groupBy("node").agg(F.min("theirs").alias("theirs"))
        least = label.join(seen, "node").select("node", F.col("group").alias("old"), F.least("group", "theirs").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("group").alias("far"))
        after = scratch.written(least.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("group")))
        changed = after.filter("old <> group").limit(1).count()
        scratch.drop(label)
        label = after.select("node", "group")
        label._lodemill_path = after._lodemill_path
        if not changed:
            return label


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
    all_pairs: bool = False,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes has a row for every row of docs: doc_id, node (smallest id with an equal set), class_id (smallest id of
    the connected group), n_copies (other documents with an equal set), n_links (other documents that reach the
    threshold, copies included), and ``row`` (hash of the text) and ``class`` (a name of the group that no other has,
    whatever the ids). links: (x, y) between nodes, x < y, which connect each class; with ``all_pairs`` all links, with
    their ``jaccard``, as many as a group has pairs.

    Texts without words (null, empty, white space) have the empty set: they are copies of each other and linked to
    nothing else. Sets, not ids, make the groups: rows that share an id, or have none, are in different classes unless
    their texts are near. A null id comes before all others, and stays null where it names a node or a class. Repeated rows
    are copies; ties go to the smaller id; further columns are ignored. A long text is one slice, of some 50 bytes a byte.
    An empty table gives empty results. Sets are named by 64 bits: two of a billion nodes share a name with probability
    0.03.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    rows = scratch.written(signatures(docs, trees * depth))
    nodes = scratch.written(sets_of(rows))
    found, _, _ = candidates(nodes, scratch, trees, depth, min(MIN_DEPTH, depth), threshold, target_recall)
    candidate_groups = components(found, scratch)
    exact = scratch.written(verified(docs, nodes, candidate_groups, threshold, scratch=scratch))
    linked = exact.filter("x = y").groupBy(F.col("x").alias("node")).agg(F.sum("others").alias("others"))
    groups = components(exact.filter("x < y").select("x", "y"), scratch)
    tops = groups.join(nodes.select("node", "id"), "node").groupBy("group").agg(F.min("id").alias("top"))
    grouped = groups.join(tops, "group").join(linked, "node")
    known = nodes.select("k1", "k2", "node", "id", "members").join(grouped, "node", "left")
    known = known.withColumn("group", F.coalesce("group", "node")).withColumn("top", F.coalesce("top", "id"))
    real = lambda c: F.when(c != NULL_ID, c)
    of_row = rows.select("id", "row", "k1", "k2").join(known, ["k1", "k2"]).drop("node")
    classes = of_row.select(
        real(rows["id"]).alias("doc_id"),
        real(known["id"]).alias("node"),
        real(F.col("top")).alias("class_id"),
        (F.col("members") - 1).cast("long").alias("n_copies"),
        (F.col("members") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        "row",
        F.col("group").alias("class"),
    )
    links = exact.filter("x < y")
    if all_pairs:
        links = verified(docs, nodes, candidate_groups, threshold, all_pairs=True, scratch=scratch)
    of = lambda c: nodes.select(F.col("node").alias(c), real(F.col("id")).alias(f"{c}_id"))
    named = links.join(of("x"), "x").join(of("y"), "y")
    named = named.select(F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y"), *(["jaccard"] if all_pairs else []))
    return classes, named


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """docs with one row of each connected group: the one with the smallest id (null first) and, of rows that share that
    id, the smallest text hash. Of texts without words one stays, and of repeated rows one. All columns stay."""
    scratch = scratch or Scratch(docs.sparkSession, "kept")
    classes, _ = near_duplicates(docs, threshold, scratch=scratch)
    first = classes.groupBy("class").agg(F.min(F.struct(_id(F.col("doc_id")).alias("id"), "row")).alias("r"))
    stay = first.select(F.col("r.id").alias("_id"), F.col("r.row").alias("_row")).distinct()
    named = packed(docs).select("d", _id(F.col("d.doc_id")).alias("_id"), F.xxhash64("d.text").alias("_row"))
    kept = named.join(stay.hint("shuffle_hash"), ["_id", "_row"], "left_semi")
    return kept.groupBy("_id", "_row").agg(F.first("d").alias("d")).select("d.*")
