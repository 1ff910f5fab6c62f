"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the words of every document.

Words are runs of digits, letters and bytes beyond ASCII, after A-Z is lower-cased. The windows of an item are its
runs of ``n`` words; an item of fewer words, but not none, is one window of all its words.

Windows go to the executors as a sorted array of 64-bit hashes, for a quick scan, with their words, for an exact
check of every hit. One set holds at most about ``max_windows`` windows. A larger benchmark stays a table, dealt into
several sets by hash: one set after the other is fetched and broadcast, scans the documents in a pass of its own, whose
hits are written, and is dropped before the next. So the driver never holds more than one. The hits of all passes are
joined per document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, byte_slices, packed
from lodemill.llm.textblock import ALNUM, TextBlock, covered, per_text, windows

#: Words of a window.
N = 8
#: Windows that are broadcast at once, about 200 bytes each.
MAX_WINDOWS = 500_000


class WindowSet:
    """Windows by length: sorted hashes, the words as bytes, and the numbers of the items that hold them."""

    def __init__(self) -> None:
        self.items: list = []
        self.by_length: dict[int, tuple[np.ndarray, list[list[bytes]], list[list[list[int]]]]] = {}

    @staticmethod
    def of(items: list[tuple]) -> WindowSet:
        """items: (item_id, window as words) rows."""
        found: dict[int, dict[int, dict[bytes, set[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        out = WindowSet()
        number: dict = {}
        for item, window in items:
            k = number.setdefault(item, len(number))
            block = TextBlock(pa.array([window]), lowered=True)
            words = block.words(ALNUM)
            h, _ = windows(block.hashes(words.starts, words.ends), words, len(words))
            found[len(words)][int(h[0])][window.encode()].add(k)
        out.items = list(number)
        for length, by_hash in found.items():
            keys = sorted(by_hash)
            out.by_length[length] = (
                np.array(keys, np.uint64),
                [list(by_hash[h]) for h in keys],
                [[sorted(x) for x in by_hash[h].values()] for h in keys],
            )
        return out


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id, window): the distinct windows of each item, words joined by a space. Items without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            block = TextBlock(batch.column("text"), lowered=True)
            words = block.words(ALNUM)
            ids, out = [], []
            for i in range(block.n):
                a, b = int(words.first[i]), int(words.first[i + 1])
                own = [block.data[words.starts[k] : words.ends[k]].tobytes() for k in range(a, b)]
                for k in range(max(1, len(own) - n + 1) if own else 0):
                    ids.append(i)
                    out.append(b" ".join(own[k : k + n]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids, pa.int64())), pa.array(out, pa.string())], names=["item_id", "window"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "item_id string, window string").distinct()


def _hits(block: TextBlock, sets: WindowSet) -> tuple[np.ndarray, object, dict[int, set[int]]]:
    """Flag of every word, the words, and the items found in each text."""
    words = block.words(ALNUM)
    single = block.hashes(words.starts, words.ends)
    flags = np.zeros(len(words), bool)
    items: dict[int, set[int]] = defaultdict(set)
    for length, (keys, texts, holders) in sets.by_length.items():
        h, at = windows(single, words, length)
        place = np.searchsorted(keys, h)
        place[place == len(keys)] = 0
        begins = []
        for j in np.flatnonzero(keys[place] == h):
            w, p = at[j], place[j]
            here = b" ".join(block.data[words.starts[k] : words.ends[k]].tobytes() for k in range(w, w + length))
            if here in texts[p]:  # a hash may lie
                begins.append(w)
                items[int(words.text[w])].update(holders[p][texts[p].index(here)])
        if begins:
            flags |= covered(len(words), np.array(begins), length)
    return flags, words, items


class Pass:
    """One set of windows on the executors, and the scan with it."""

    def __init__(self, spark: SparkSession, windows: DataFrame):
        """windows: (item_id, window) rows of one set."""
        self.shared = spark.sparkContext.broadcast(WindowSet.of([tuple(r) for r in windows.toLocalIterator()]))

    def hits(self, rows: DataFrame) -> DataFrame:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in byte_slices(batches):
                block = TextBlock(batch.column("text"), lowered=True)
                flags, words, items = _hits(block, shared.value)
                hits = [np.flatnonzero(flags[words.first[i] : words.first[i + 1]]) if i in items else () for i in range(block.n)]
                names = [sorted({shared.value.items[k] or "" for k in items.get(i, ())}) for i in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), pa.array(words.counts()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                    names=["doc_id", "row", "n_words", "hits", "items"],
                )

        return rows.mapInArrow(run, "doc_id long, row long, n_words long, hits array<int>, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, row (hash of the text), n_words, hits (numbers of the hit words) and items (sorted ids) of every row.

    Null and empty texts have no words. An empty benchmark hits nothing. A null item id is the empty string. Repeated
    rows and null document ids are scanned like others; further columns are ignored; an empty table gives an empty
    result. A text is scanned whole, in memory of some 50 bytes a byte.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "windows")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    windows = scratch.written(item_windows(benchmark, n))
    sets = max(1, -(-windows.count() // max_windows))
    if sets == 1:
        return Pass(spark, windows).hits(rows)
    part = F.pmod(F.xxhash64("window"), F.lit(sets))
    every = None
    for k in range(sets):
        one = Pass(spark, windows.filter(part == k))
        found = one.hits(rows).withColumn("first", F.lit(int(k == 0)))
        # Every row once, and rows with hits once for each set that hits them.
        found = scratch.written(found if k == 0 else found.filter(F.size("items") > 0))
        one.shared.destroy()
        every = found if every is None else every.unionByName(found)
    merged = every.groupBy("doc_id", "row", "n_words").agg(
        F.sum("first").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def scan_digest(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def _without_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if text is None or not hits:
                out.append(text)
                continue
            raw, gone = text.encode(), set(hits)
            keep = np.ones(len(raw), bool)
            words = TextBlock(pa.array([text]), lowered=True).words(ALNUM)
            for a in hits:
                # A run of hit words goes with what stands between them.
                keep[words.starts[a] : words.starts[a + 1] if a + 1 in gone else words.ends[a]] = False
            out.append(np.frombuffer(raw, np.uint8)[keep].tobytes().decode())
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field("d"), pa.field("text", pa.string())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", min_items: int = 2) -> DataFrame:
    """docs without what leaked from the benchmark. All columns stay, and so does every row that isn't named here.

    ``remove="documents"`` drops the rows that hold windows of ``min_items`` items or more; ``"spans"`` cuts the hit
    words of these rows; ``"both"`` drops these rows and cuts hit words from rows with fewer items. Repeated rows share
    their fate. A null text is never contaminated.
    """
    if remove not in ("documents", "spans", "both"):
        raise ValueError("remove must be documents, spans or both")
    least = 1 if remove == "both" else min_items
    marked = (
        scan(docs, benchmark)
        .filter(F.size("items") >= least)
        .groupBy("doc_id", "row")
        .agg(F.first("hits").alias("hits"), (F.size(F.first("items")) >= min_items).alias("whole"))
        .select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "hits", "whole")
        .hint("shuffle_hash")
    )
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("d.text") == F.col("_row"))
    if remove == "documents":
        return packed(docs).join(marked, same, "left_anti").select("d.*")
    hit = packed(docs).join(marked, same, "left")
    if remove == "both":
        hit = hit.filter(~F.coalesce("whole", F.lit(False)))
    kind = f"d {packed(docs).schema['d'].dataType.simpleString()}, text string"
    cut = hit.select("d", F.col("d.text").cast("string").alias("text"), "hits").mapInArrow(_without_words, kind)
    return cut.select(*[F.col("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


#: DuckDB. Words as a list, item windows as strings, an equi-join of windows.
SCAN_SQL = r"""
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), lengths AS (SELECT DISTINCT n FROM item_windows
), doc_windows AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (
    SELECT d.r, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.win = t.win
), words_hit AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""
