"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous supersteps.

Documents become token ids and are cut into pieces of at most ``length`` tokens. Pieces of equal length are alike, and so
are sequences with equal gaps, so supersteps work on runs: ranks [a, b) of the pieces of one length, and sequences [a, b)
that have one gap left. Runs lie in a Spark table, range-partitioned by size. In a superstep

1. every range sorts its runs and sweeps its pieces, largest first: the successor of a length is the smallest gap at hand
   that holds it;
2. pieces that want the same gap are resolved by rank: the largest first, then those of lower rank, which go to the
   sequences of lower number; a sequence takes as many pieces of one length as fit;
3. gaps are updated: what is left of one goes to the range of its new size, and gaps that a range has no use for go down
   to the next range, for the superstep that follows.

It begins with as many empty sequences as the tokens fill at least. When no gap is left and pieces are, sequences for the
rest are opened at the top. The driver counts what is left; it sees neither runs nor pieces. There are at most
``length`` lengths and gaps, so runs are few, whatever the number of documents. Pieces are numbered within their length
in two levels and find their sequence and place in the table of placed runs, which is broadcast.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, byte_slices, text_or_empty
from lodemill.llm.ranking import ranked
from lodemill.llm.tokens import added_tokens, encode_column

LENGTH = 2048
#: Appended to the ids of every document.
END = 0
#: Bytes of text that are encoded together.
SLICE_BYTES = 2 << 20
#: Pieces that one task numbers.
BLOCK_ROWS = 20_000
#: Kinds of runs.
GAP, PIECE, PLACED = 0, 1, 2
_RUN = "at int, kind int, size int, lo long, n long, sequence long, offset int"


def pieces(docs: DataFrame, ranks_path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row of docs, with its number ``nth`` in a
    ``block``. Null texts are empty.

    Added tokens of the JSON beside the ranks that stand in a text become their ids.
    """
    added = added_tokens(ranks_path.removesuffix(".tiktoken") + ".json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        for batch in byte_slices(batches, limit=SLICE_BYTES):
            at, piece, start, size, crc = [], [], [], [], []
            flat, offsets = encode_column(batch.column("text"), ranks_path, added)
            for i in range(batch.num_rows):
                ids = np.append(flat[offsets[i] : offsets[i + 1]], np.uint32(END)).astype("<u4")
                begin, end, k = 0, len(ids) % length or length, 0
                while begin < len(ids):
                    at.append(i)
                    piece.append(k)
                    start.append(begin)
                    size.append(end - begin)
                    crc.append(zlib.crc32(ids[begin:end].tobytes()))
                    begin, end, k = end, end + length, k + 1
            which = pa.array(at, pa.int64())
            nth = np.arange(n, n + len(at))
            n += len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(which),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, size, crc)],
                    pa.array(task + nth // BLOCK_ROWS),
                    pa.array(nth),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"],
            )

    text = text_or_empty(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long")


def range_of(size: int, length: int = LENGTH) -> int:
    """Range of a size: each goes down to half of the one above; 0 has the largest."""
    return min(LOWEST, (length // size).bit_length() - 1)


#: The lowest range.
LOWEST = 4


def sweep(at: int, runs: Iterable[tuple], length: int = LENGTH) -> list[tuple]:
    """One range's part of a superstep, on (at, kind, size, lo, n, sequence, offset) rows; such rows come back.

    Gaps that are left go down one range; below the lowest they are closed. Pieces without a gap stay.
    """
    gaps: list[int] = []  # sizes in order
    held: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences [a, b), in order
    out: list[tuple] = []

    def put(gap: int, a: int, b: int) -> None:
        if gap and a < b:
            if range_of(gap, length) > at:
                out.append((range_of(gap, length), GAP, gap, a, b - a, -1, -1))
                return
            if gap not in held:
                held[gap] = []
                insort(gaps, gap)
            insort(held[gap], (a, b))

    pieces = []
    for _, kind, size, lo, n, _, _ in runs:
        if kind == PIECE:
            pieces.append((-size, lo, n))
        else:
            # A larger gap that came down is used like one of this range.
            if size not in held:
                held[size] = []
                insort(gaps, size)
            insort(held[size], (lo, lo + n))
    for size, rank, left in sorted(pieces):
        size = -size
        while left and (k := bisect_left(gaps, size)) < len(gaps):
            gap = gaps[k]
            a, b = held[gap].pop(0)
            if not held[gap]:
                del held[gap]
                gaps.pop(k)
            each = gap // size
            full = min(b - a, left // each)
            more = left % each if full < b - a and left // each == full else 0
            # Layer by layer: the j-th piece of every sequence.
            for j in range(each):
                n = full + (j < more)
                if n:
                    out.append((at, PLACED, size, rank, n, a, length - gap + j * size))
                    rank += n
                    left -= n
            put(gap - each * size, a, a + full)
            if more:
                put(gap - more * size, a + full, a + full + 1)
            put(gap, a + full + bool(more), b)
        if left:
            out.append((at, PIECE, size, rank, left, -1, -1))
    if at < LOWEST:
        out += [(at + 1, GAP, gap, a, b - a, -1, -1) for gap in gaps for a, b in held[gap]]
    return out


def first_runs(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple], int]:
    """Runs of all pieces and of the sequences that they fill at least; the number of the latter."""
    opened = -(-sum(s * n for s, n in counts.items()) // length)
    pieces = [(range_of(s, length), PIECE, s, 0, n, -1, -1) for s, n in counts.items() if n]
    return [*pieces, (0, GAP, length, 0, opened, -1, -1)], opened


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """The supersteps without Spark, for small inputs.

    Returns for each size the runs (first rank, first sequence, offset), sorted: the piece of rank r in the run goes
    to sequence first sequence + (r - first rank) at that offset. And the number of sequences.
    """
    runs, opened = first_runs(counts, length)
    placed: dict[int, list[tuple[int, int, int]]] = {}
    while any(r[1] == PIECE for r in runs):
        if not any(r[1] == GAP for r in runs):
            more = -(-sum(r[2] * r[4] for r in runs) // length)
            runs.append((0, GAP, length, opened, more, -1, -1))
            opened += more
        after = [x for at in range(LOWEST + 1) for x in sweep(at, [r for r in runs if r[0] == at], length)]
        for _, kind, size, lo, _, sequence, offset in after:
            if kind == PLACED:
                placed.setdefault(size, []).append((lo, sequence, offset))
        runs = [r for r in after if r[1] != PLACED]
    return {size: sorted(found) for size, found in placed.items()}, opened


def _superstep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ranges.setdefault(row[0], []).append(row)
        for at, rows in sorted(ranges.items()):
            if found := sweep(at, rows, length):
                columns = list(zip(*found, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["at", "kind", "size", "lo", "n", "sequence", "offset"])

    return run


def supersteps(counts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(size, lo, n, sequence, offset): where the ranks of each length go. counts: (length, n)."""
    spark = counts.sparkSession
    lowest = F.least(F.lit(LOWEST), F.length(F.bin(F.floor(F.lit(length) / F.col("length")))) - 1)
    none = [F.lit(-1).cast(k).alias(c) for c, k in (("sequence", "long"), ("offset", "int"))]
    runs = counts.select(lowest.cast("int").alias("at"), F.lit(PIECE).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("n"), *none)
    placed, opened, gaps = [], 0, 0
    pending = runs.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("n")).first()["n"]
    while pending:
        if not gaps:
            more = -(-pending // length)
            runs = runs.unionByName(spark.createDataFrame([(0, GAP, length, opened, more, -1, -1)], _RUN))
            opened += more
        dealt = runs.repartitionByRange(LOWEST + 1, "at").sortWithinPartitions("at", F.desc("size"), "kind", "lo")
        after = scratch.written(dealt.mapInArrow(_superstep(length), _RUN))
        placed.append(after.filter(F.col("kind") == PLACED).select("size", "lo", "n", "sequence", "offset"))
        runs = after.filter(F.col("kind") != PLACED)
        left = runs.agg(F.coalesce(F.sum(F.when(F.col("kind") == PIECE, F.col("size") * F.col("n"))), F.lit(0)).alias("pending"), F.count_if(F.col("kind") == GAP).alias("gaps")).first()
        pending, gaps = left["pending"], left["gaps"]
    empty = spark.createDataFrame([], "size int, lo long, n long, sequence long, offset int")
    for p in placed:
        empty = empty.unionByName(p)
    return empty


def pack(docs: DataFrame, ranks_path: str, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null or empty text is one piece with the end id alone. Null ids, repeated rows and ties are packed like others;
    further columns are ignored; an empty table gives an empty result. A long text is encoded whole, in memory of some 20
    bytes a byte of text.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    cut = scratch.written(pieces(docs, ranks_path, length))
    found = supersteps(cut.groupBy("length").agg(F.count("*").alias("n")), length, scratch).toArrow()  # bounded by lengths and gaps
    size = found.column("size").to_numpy()
    order = np.lexsort((found.column("lo").to_numpy(), size))
    size, lo, sequence, offset = (found.column(c).to_numpy()[order] for c in ("size", "lo", "sequence", "offset"))
    shared = spark.sparkContext.broadcast((np.searchsorted(size, np.arange(length + 2)), lo, sequence, offset))
    numbered = ranked(cut, ["length"], ["nth"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, lo, sequence, offset = shared.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            to, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                k = first[s] + np.searchsorted(lo[first[s] : first[s + 1]], rank[own], "right") - 1
                to[own], at[own] = sequence[k] + rank[own] - lo[k], offset[k]
            same = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(to), pa.array(at)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
