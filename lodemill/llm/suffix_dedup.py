"""Removal of long repeated passages, byte for byte, by suffix sorting of content-defined shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also begins earlier: in a smaller document id, or further
to the front of the same document. All strings are judged on the input.

How it runs:

1. Every string of ``LENGTH`` bytes belongs to an anchor, the run of ``GRAM`` bytes in it with the smallest hash.
   Neighbouring strings with one anchor are a segment. Equal strings have equal anchors, wherever they stand, so
   anchors deal all strings out to shards without losing a match. Only (anchor, hash of the segment, place) moves.
2. Of equal segments all but the first go at once: in the task that reads them, then per anchor in a sorted stream
   that holds one row. This takes what copies repeat, however many there are. An anchor with one segment is done.
3. Segments that share an anchor but differ (the ends of a repeat, and near copies) are fetched with their bytes and
   dealt by anchor into shards, whose suffixes are sorted by external induced sorting (``suffix_sort``). Runs of
   suffixes with a common prefix of ``LENGTH`` bytes are equal strings; all but the first go. An anchor with more
   bytes of segments than one shard (a passage in many surroundings) is dealt once more, by the hash of each of its
   strings: sorted by hash and place, all but the first of each hash go, in a stream that holds one row.
4. What goes is merged per document and cut out.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, byte_slices, text_or_empty
from lodemill.llm.suffix_sort import later_repeats
from lodemill.llm.textblock import TextBlock, mix

LENGTH = 100
#: Bytes of an anchor.
GRAM = 24
#: Bytes of text whose strings are dealt at once; with what they overlap less than twice as many.
PIECE = 1 << 20
#: Bytes of segments that a suffix-sorting task aims at.
SHARD_BYTES = 2 << 20
#: Anchors dealt by string that are broadcast; more are joined.
MAX_HOT = 100_000
NULL_ID = -(1 << 63)

_SEGMENT = "gone boolean, anchor long, seg long, doc long, row int, start int, stop int"


def _least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    n = len(x)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    size = n - w + 1
    return np.minimum(behind[:size], ahead[w - 1 : w - 1 + size])


def _segments(block: TextBlock, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first byte, byte after the last, text) of every segment. A block longer than PIECE is read in pieces, at
    whose ends segments end; every string still has its own anchor, and is in one segment."""
    found = [_piece(block, at, length, gram) for at in range(0, max(1, len(block.data) - length + 1), PIECE)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _piece(block: TextBlock, begin: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the strings that begin in the PIECE bytes from begin on."""
    n = min(len(block.data), begin + PIECE + length - 1) - begin
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty
    at = np.arange(n - gram + 1)
    grams = block.hashes(at + begin, at + begin + gram)
    # The place in the low bits, as many in every piece: of equal hashes the first counts.
    bits = np.uint64(PIECE.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = _least_in_windows((mix(grams) & ~mask) | at.astype(np.uint64), length - gram + 1)
    place = (least & mask).astype(np.int64)
    starts = begin + np.arange(len(place))
    text = np.searchsorted(block.at, starts, "right") - 1
    inside = np.flatnonzero(starts + length <= block.at[text + 1])
    if not len(inside):
        return empty.astype(np.uint64), empty, empty, empty
    opens = np.ones(len(inside), bool)
    opens[1:] = (np.diff(inside) != 1) | (place[inside][1:] != place[inside][:-1])
    first = np.flatnonzero(opens)
    start = inside[first]
    stop = inside[np.append(first[1:], len(inside)) - 1] + length
    return grams[place[start]], start + begin, stop + begin, text[start]


def _merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each key with overlapping and touching ones joined."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((stop, start, key))
    key, start, stop = key[order], start[order], stop[order]
    # A running maximum of the ends that begins anew with each key.
    shift = np.cumsum(np.append(0, key[1:] != key[:-1])) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    opens = np.ones(len(key), bool)
    opens[1:] = (key[1:] != key[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(opens)
    return key[first], start[first], (reach - shift)[np.append(first[1:], len(key)) - 1]


def _rows(docs: DataFrame) -> DataFrame:
    text = text_or_empty(F.col("text"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(text).alias("row"), text.alias("text"))


def _read_segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            block = TextBlock(batch.column("text"))
            doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            anchor, start, stop, text = _segments(block, length, gram)
            seg = block.hashes(start, stop)
            # Texts in order of id, and equal rows under one number.
            order = np.lexsort((row, doc))
            new = np.ones(block.n, bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1])
            number = np.empty(block.n, np.int64)
            number[order] = np.cumsum(new)
            start, stop, who = start - block.at[text], stop - block.at[text], number[text]
            order = np.lexsort((start, who, seg))
            seg, anchor, text, who, start, stop = (x[order] for x in (seg, anchor, text, who, start, stop))
            first = np.ones(len(seg), bool)
            first[1:] = seg[1:] != seg[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(seg)), 0))
            later = (who != who[lead]) | (start != start[lead])
            t, b, e = _merged(text[later], start[later], stop[later])
            k = np.flatnonzero(first)
            t, b, e = np.concatenate([text[k], t]), np.concatenate([start[k], b]), np.concatenate([stop[k], e])
            gone = np.arange(len(t)) >= len(k)
            zero = np.zeros(len(t) - len(k), np.uint64)
            # Ranges that are settled ride along, spread over the partitions.
            a = np.concatenate([anchor[k], mix(zero + np.arange(len(zero), dtype=np.uint64) + np.uint64(batch.num_rows))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gone), pa.array(a.view(np.int64)), pa.array(np.concatenate([seg[k], zero]).view(np.int64)), pa.array(doc[t]), pa.array(row[t]), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))],
                names=["gone", "anchor", "seg", "doc", "row", "start", "stop"],
            )

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by anchor, segment and place: later equal segments go, first ones of shared anchors stay for the shards."""
    last = None  # the last row that was kept: (anchor, seg, doc, row, start)
    held = None  # the first segment of the last anchor, as long as it is the only one
    for batch in batches:
        settled = batch.filter(batch.column("gone"))
        if settled.num_rows:
            yield settled
        batch = batch.filter(pa.array(~batch.column("gone").to_numpy(zero_copy_only=False)))
        n = batch.num_rows
        if not n:
            continue
        anchor, seg, doc, row, start = (batch.column(c).to_numpy() for c in ("anchor", "seg", "doc", "row", "start"))
        first = np.ones(n, bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
        if last is not None and (anchor[0], seg[0]) == last[:2]:
            first[0] = False
        lead = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        own = [np.where(lead >= 0, x[np.maximum(lead, 0)], 0 if last is None else last[2 + i]) for i, x in enumerate((doc, row, start))]
        later = ~first & ((doc != own[0]) | (row != own[1]) | (start != own[2]))
        if later.any():
            part = batch.filter(pa.array(later))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(part.num_rows, bool)), *part.columns[1:]], names=part.schema.names)
        k = np.flatnonzero(first)
        if len(k):
            a = anchor[k]
            shared = np.zeros(len(k), bool)
            shared[1:] |= a[1:] == a[:-1]
            shared[:-1] |= a[1:] == a[:-1]
            if last is not None and a[0] == last[0]:
                shared[0] = True
                shared[: np.searchsorted(a != a[0], True) if (a != a[0]).any() else len(a)] = True
                if held is not None:
                    yield held
            held = None
            if not shared[-1]:
                held = batch.slice(int(k[-1]), 1)
            if shared.any():
                yield batch.filter(pa.array(first)).filter(pa.array(shared))
            i = k[-1]
            last = (anchor[i], seg[i], doc[i], row[i], start[i])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches):
        block, parts = TextBlock(batch.column("text")), batch.column("parts")
        which, anchor, start, data = [], [], [], []
        for i, own in enumerate(parts.to_pylist()):
            raw = block.bytes_of(i)
            for p in own:
                which.append(i)
                anchor.append(p["anchor"])
                start.append(p["start"])
                data.append(raw[p["start"] : p["stop"]])
        w = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), batch.column("doc").take(w), batch.column("row").take(w), pa.array(start, pa.int32()), pa.array(data, pa.binary())],
            names=["anchor", "doc", "row", "start", "bytes"],
        )


def _without_repeats(batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """Without rows that repeat the place before them (they come from repeated rows); and the last place."""
    if not batch.num_rows:
        return batch, last
    place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "row", "start")], 1)
    keep = np.ones(len(place), bool)
    keep[1:] = (place[1:] != place[:-1]).any(1)
    keep[0] = last is None or tuple(place[0]) != last
    return batch.filter(pa.array(keep)), tuple(place[-1])


def _sort_shard(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, row, start, size = [], [], [], []
        last = None
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                batch, last = _without_repeats(batch, last)
                for data in batch.column("bytes"):
                    raw = np.frombuffer(data.as_buffer(), np.uint8)
                    file.write(np.append(raw.astype("<i2") + 2, np.int16(1)).astype("<i2").tobytes())
                    size.append(len(raw) + 1)
                for out, c in ((doc, "doc"), (row, "row"), (start, "start")):
                    out.append(batch.column(c).to_numpy())
            if not size:
                return
            file.write(np.int16(0).tobytes())
            file.flush()
            text = np.memmap(file, "<i2", "r")
            found = later_repeats(text, length)
        doc, row, start = np.concatenate(doc), np.concatenate(row), np.concatenate(start)
        begin = np.concatenate([[0], np.cumsum(size)])
        of = np.searchsorted(begin, found, "right") - 1
        b = start[of] + (found - begin[of])
        k, b, e = _merged(of, b, b + length)
        yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(row[k]), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "row", "start", "stop"])

    return run


def _string_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            block = TextBlock(batch.column("text"))
            sizes = [[(p["start"], p["stop"]) for p in own] for own in batch.column("parts").to_pylist()]
            text = np.repeat(np.arange(block.n), [len(x) for x in sizes])
            spans = np.array([x for own in sizes for x in own], np.int64).reshape(-1, 2)
            n = spans[:, 1] - spans[:, 0] - length + 1
            which = np.repeat(text, n)
            start = np.repeat(spans[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = block.at[which] + start
            w = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.hashes(at, at + length).view(np.int64)), batch.column("doc").take(w), batch.column("row").take(w), pa.array(start.astype(np.int32))],
                names=["string", "doc", "row", "start"],
            )

    return run


def _later_strings(length: int):
    """Sorted by string and place: the ranges of all strings but the first of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # the first place of the last string: (string, doc, row, start)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            string, *place = (batch.column(c).to_numpy() for c in ("string", "doc", "row", "start"))
            first = np.ones(n, bool)
            first[1:] = string[1:] != string[:-1]
            if lead is not None and string[0] == lead[0]:
                first[0] = False
            at = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            own = [np.where(at >= 0, x[np.maximum(at, 0)], 0 if lead is None else lead[1 + i]) for i, x in enumerate(place)]
            # Repeated rows are one document, so the first place may come twice.
            later = np.flatnonzero(~first & ((place[0] != own[0]) | (place[1] != own[1]) | (place[2] != own[2])))
            if at[-1] >= 0:
                lead = (string[at[-1]], *(x[at[-1]] for x in place))
            if len(later):
                start = place[2][later]
                yield pa.RecordBatch.from_arrays([pa.array(place[0][later]), pa.array(place[1][later]), pa.array(start), pa.array(start + np.int32(length))], names=["doc", "row", "start", "stop"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, scratch: Scratch | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, row, start, stop): byte ranges that go, for each text (named by id and hash). Ranges may overlap.

    Null and empty texts, and texts under ``length`` bytes, lose nothing. A null id is the smallest. Of rows that share
    an id the one with the smaller text hash is earlier; repeated rows are one document.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    rows = _rows(docs)
    segments = rows.mapInArrow(_read_segments(length, gram), _SEGMENT)
    order = ["anchor", "seg", "doc", "row", "start"]
    settled = scratch.written(segments.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_settle, _SEGMENT))
    open_ = settled.filter("not gone")
    sums = open_.groupBy("anchor").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
    hot = scratch.written(sums.filter(F.col("n") > shard_bytes).select("anchor"))
    n_hot = hot.count()
    out = settled.filter("gone").select("doc", "row", "start", "stop")
    if n_hot:
        # At most one anchor for each shard of bytes.
        hot = F.broadcast(hot) if n_hot <= MAX_HOT else hot
        strings = _with_parts(rows, open_.join(hot, "anchor", "left_semi")).mapInArrow(_string_hashes(length), "string long, doc long, row int, start int")
        dealt = strings.repartition("string").sortWithinPartitions("string", "doc", "row", "start")
        out = out.unionByName(dealt.mapInArrow(_later_strings(length), "doc long, row int, start int, stop int"))
        open_ = open_.join(hot, "anchor", "left_anti")
    total = open_.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("n")).first()["n"]
    fetched = _with_parts(rows, open_).mapInArrow(_fetch, "anchor long, doc long, row int, start int, bytes binary")
    shards = max(8, total // shard_bytes)
    compared = fetched.repartition(int(shards), "anchor").sortWithinPartitions("doc", "row", "start").mapInArrow(_sort_shard(length), "doc long, row int, start int, stop int")
    return out.unionByName(compared)


def _with_parts(rows: DataFrame, segments: DataFrame) -> DataFrame:
    parts = segments.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("parts"))
    return rows.join(parts.hint("shuffle_hash"), ["doc", "row"]).select("doc", "row", "text", "parts")


def drop_repeats(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay, for every row of docs.

    Further columns are ignored; an empty table gives an empty result.
    """
    ranges = repeated_ranges(docs, length, scratch=scratch).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    whole = _rows(docs).join(ranges.hint("shuffle_hash"), ["doc", "row"], "left").select("doc", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            block, removed, spans, digest = TextBlock(batch.column("text")), [], [], []
            for i, ranges in enumerate(batch.column("ranges")):
                raw, gone, n = block.bytes_of(i), 0, 0
                kept = hashlib.sha256()
                at = 0
                if ranges.is_valid:
                    flat = ranges.values
                    b, e = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                    _, b, e = _merged(np.zeros(len(b), np.int64), b.astype(np.int64), e.astype(np.int64))
                    for x, y in zip(b.tolist(), e.tolist(), strict=True):
                        kept.update(raw[at:x])
                        at, gone = y, gone + y - x
                    n = len(b)
                kept.update(raw[at:])
                removed.append(gone)
                spans.append(n)
                digest.append(kept.hexdigest())
            doc = batch.column("doc").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if x == NULL_ID else x for x in doc], pa.int64()), pa.array(np.diff(block.at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
