"""Quality rules: counts of a text, and a log-likelihood ratio between trusted texts and the raw corpus.

Words and pairs of neighbouring words are grams, named by a hash whose width grows with the corpus (``hash_bits``).
Their counts over all documents (raw) and over all trusted documents (target) give two smoothed multinomials. A
document's score is the mean over its grams of log(target / raw), so length does not matter; its own counts are left
out of raw. Every document at or above a fixed threshold passes.

How it runs:

1. Tasks add up the grams of their texts and send (gram, raw, target) to parts, by the high bits of the hash, as sorted
   arrays of differences: about three bytes a gram. A part adds them up and keeps the grams that occur twice or more.
   Of a gram that occurs once nothing need be kept: its text knows that raw without its own count is nothing.
2. The most frequent grams, at most ``heavy``, are broadcast. Their share of a score is known where the text is read.
3. The other grams of a text go to their parts, packed alike, with the number of the text in its chunk. Counts found
   there go back to the chunk, whose header (the rule counts of its texts) waits for them. So no row of any exchange
   belongs to a frequent gram, no text is moved, and nothing on the driver or in a task grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, byte_slices
from lodemill.llm.textblock import NOT_SPACE, TextBlock, covered, mix, per_text, windows

#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

THRESHOLD = -0.25
#: Trusted ids that are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Grams whose counts are broadcast; counts of all others are joined.
HEAVY = 1 << 21
#: Distinct grams that a counting task adds up before it hands them on.
HELD = 1 << 22
#: Counts of this size and above are one class when the heavy grams are chosen.
TOP = 1 << 16
#: Bytes of text for each part of the table, and in a chunk of texts that asks for counts.
PART_BYTES, CHUNK_BYTES = 16 << 20, 8 << 20

_COUNTS = "part int, size int, grams binary, raw binary, target binary"


def hash_bits(n_bytes: int) -> int:
    """Wide enough that a gram shares its name with another one in few of 10,000 cases, whatever the corpus."""
    return min(64, max(40, int(n_bytes).bit_length() + 12))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as the planes of their bytes, lowest first, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], size).T
    return out.view("<u8").ravel()


def _steps(grams: np.ndarray) -> bytes:
    return _pack(np.diff(grams, prepend=np.uint64(0)))


def _by_part(gram: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted grams with their ranges."""
    part = (gram >> np.uint64(shift)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False):
        yield int(part[a]), slice(a, b)


class Names:
    """Width of the grams' hash and of the parts' numbers for a corpus of so many bytes."""

    def __init__(self, n_bytes: int, part_bytes: int = PART_BYTES):
        self.bits = hash_bits(n_bytes)
        self.part_bits = max(0, (max(1, n_bytes) // part_bytes).bit_length())
        #: A shift by 64 is none in numpy, so one part has the low 63 bits.
        self.shift = min(63, self.bits - self.part_bits)

    def grams(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """(gram, text) of every word and every pair of words."""
        words = block.words(NOT_SPACE)
        single = block.hashes(words.starts, words.ends)
        double, at = windows(single, words, 2)
        return np.concatenate([single, double]) >> np.uint64(64 - self.bits), np.concatenate([words.text, words.text[at]])


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams with their counts. ``parts`` is emptied, so that its arrays can go while the rest is made."""
    gram, raw, target = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(gram)
    gram = gram[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    if not len(first):
        return gram, raw, target
    gram = gram[first]
    return gram, np.add.reduceat(raw[order], first), np.add.reduceat(target[order], first)


def _with_trust(docs: DataFrame, trusted: DataFrame, max_broadcast_ids: int) -> DataFrame:
    """doc_id, text and is_target. Null ids are not trusted and stay out of a shuffle, where they would be one key."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if ids.count() <= max_broadcast_ids:
        return rows.join(F.broadcast(ids), "doc_id", "left")
    flagged = rows.filter("doc_id is not null").join(ids.hint("merge"), "doc_id", "left")
    return flagged.unionByName(rows.filter("doc_id is null").withColumn("is_target", F.lit(False)))


def packed_counts(flagged: DataFrame, names: Names, least: int = 1) -> DataFrame:
    """A row for each part with its grams that occur ``least`` times or more, sorted, and their counts; and
    ``n_raw`` and ``n_target``, the sums over all grams of the part."""

    def rows_of(sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        gram, raw, target = sums
        parts = list(_by_part(gram, names.shift))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in parts], pa.int32()),
                pa.array([s.stop - s.start for _, s in parts], pa.int32()),
                pa.array([_steps(gram[s]) for _, s in parts], pa.binary()),
                *[pa.array([_pack(x[s]) for _, s in parts], pa.binary()) for x in (raw, target)],
            ],
            names=["part", "size", "grams", "raw", "target"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in byte_slices(batches):
            gram, text = names.grams(TextBlock(batch.column("text")))
            chosen = batch.column("is_target").fill_null(False).to_numpy(zero_copy_only=False)
            held.append(_summed([(gram, np.ones(len(gram), np.uint32), chosen[text].astype(np.uint32))]))
            size += len(held[-1][0])
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield rows_of(held[0])
                    held, size = [], 0
        if held:
            yield rows_of(_summed(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def whole() -> pa.RecordBatch:
            gram, raw, target = _summed(held)
            totals = [pa.array([int(raw.sum())]), pa.array([int(target.sum())])]
            keep = raw >= least
            gram, raw, target = gram[keep], raw[keep], target[keep]
            arrays = [pa.array([now], pa.int32()), pa.array([len(gram)], pa.int32()), *[pa.array([x], pa.binary()) for x in (_steps(gram), _pack(raw), _pack(target))], *totals]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "size", "grams", "raw", "target", "n_raw", "n_target"])

        for batch in batches:
            for part, n, *blobs in zip(*[batch.column(c).to_pylist() for c in ("part", "size", "grams", "raw", "target")], strict=True):
                if part != now and held:
                    yield whole()
                    held, size = [], 0
                now = part
                gram, raw, target = (_unpack(b, n) for b in blobs)
                held.append((np.cumsum(gram, dtype=np.uint64), raw.astype(np.int64), target.astype(np.int64)))
                size += n
                if size > HELD:
                    held = [_summed(held)]
                    size = len(held[0][0]) // 2  # what is distinct can't be added up further
        if held:
            yield whole()

    sent = flagged.select("text", "is_target").mapInArrow(count, _COUNTS)
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, f"{_COUNTS}, n_raw long, n_target long")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]


def _unpacked(table: DataFrame, least: int = 1) -> DataFrame:
    """(gram, raw, target) of a packed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, *blobs in zip(*[batch.column(c).to_pylist() for c in ("size", "grams", "raw", "target")], strict=True):
                gram, raw, target = (_unpack(b, n).view(np.int64) for b in blobs)
                keep = raw >= least
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.cumsum(gram), raw, target)], names=["gram", "raw", "target"])

    return table.select("size", "grams", "raw", "target").mapInArrow(run, "gram long, raw long, target long")


def gram_counts(docs: DataFrame, trusted: DataFrame, max_broadcast_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """(gram, raw, target): counts over all docs, and over all the trusted among them. ``trusted`` has doc_id."""
    return _unpacked(packed_counts(_with_trust(docs, trusted, max_broadcast_ids), Names(text_bytes(docs))))


class Multinomials:
    """Totals of both multinomials, and the counts of the most frequent grams as arrays."""

    def __init__(self, table: DataFrame, heavy: int = HEAVY, smoothing: float = 1.0):
        """``table`` holds packed counts and is read several times."""
        self.smoothing = smoothing
        sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_raw", "n_target")]).first()
        self.n_raw, self.n_target = sums["n_raw"], sums["n_target"]

        def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, raw in zip(batch.column("size").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                    value, k = np.unique(np.minimum(_unpack(raw, n), TOP).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(k)], names=["raw", "n"])

        found = table.select("size", "raw").mapInArrow(classes, "raw long, n long").groupBy("raw").agg(F.sum("n").alias("n")).collect()  # at most TOP rows
        # The least count such that not more than ``heavy`` grams reach it.
        self.least, n = TOP + 1, 0
        for raw, k in sorted(((r["raw"], r["n"]) for r in found), reverse=True):
            if n + k > heavy:
                break
            self.least, n = raw, n + k
        rows = _unpacked(table, self.least).toArrow() if n else None
        gram, raw, target = (rows.column(c).to_numpy() if n else np.zeros(0, np.int64) for c in ("gram", "raw", "target"))
        order = np.argsort(gram.view(np.uint64))
        self.gram, self.raw, self.target = gram.view(np.uint64)[order], raw[order], target[order]

    def ratio(self, raw: np.ndarray, target: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log(target / raw) of grams that occur ``own`` times in a text of ``size`` grams, whose own counts don't count
        as raw, so rare words of a text are neutral. Both multinomials get ``smoothing`` expected target counts a gram."""
        scale = self.n_target / np.maximum(1, self.n_raw - size)
        return np.log((target + self.smoothing) / ((raw - own) * scale + self.smoothing))

    def split(self, gram: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(grams, summed log ratios of the heavy ones) of each text, and (gram, text, own count) of the others, sorted.

        All ratios are 0 without trusted texts.
        """
        size = np.bincount(text, minlength=n_texts)
        own_salt = mix(np.arange(n_texts, dtype=np.uint64) + np.uint64(1))
        _, at, own = np.unique(mix(gram) ^ own_salt[text], return_index=True, return_counts=True)
        gram, text = gram[at], text[at]
        order = np.argsort(gram)
        gram, text, own = gram[order], text[order], own[order]
        k = np.minimum(np.searchsorted(self.gram, gram), max(0, len(self.gram) - 1))
        known = self.gram[k] == gram if len(self.gram) else np.zeros(len(gram), bool)
        b, t, n = k[known], text[known], own[known]
        if not self.n_target:
            return size, np.zeros(n_texts), (gram[:0], text[:0], own[:0])
        worth = n * self.ratio(self.raw[b], self.target[b], n, size[t])
        return size, np.bincount(t, weights=worth, minlength=n_texts).astype(np.float64), (gram[~known], text[~known], own[~known])


def rule_counts(block: TextBlock) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = block.words(NOT_SPACE)
    single = block.hashes(words.starts, words.ends)
    own = mix(np.arange(block.n, dtype=np.uint64) + np.uint64(1))
    # Windows of five words that a text has twice or more.
    five, at = windows(single, words, 5)
    key = five ^ own[words.text[at]]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = covered(len(words), at[twice], 5) if len(words) else np.zeros(0, bool)
    lines = block.lines()
    with_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line = block.hashes(lines.starts[with_word], lines.ends[with_word]) ^ own[lines.text[with_word]]
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    flags = np.zeros(len(lines), bool)
    flags[np.flatnonzero(with_word)] = again
    in_word = NOT_SPACE[block.data] & ((block.data & 0xC0) != 0x80)
    return {
        "n_words": words.counts(),
        "word_chars": block.sums(in_word),
        "n_symbols": block.sums(SYMBOLS[block.data]),
        "n_dup_lines": per_text(flags, lines),
        "n_repeat_words": per_text(repeated, words),
    }


#: Counts of a text that the rules name.
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in RULES) + ", base_failed boolean, score double"
#: Rows between texts and parts: counts (0), grams that ask (1), headers (2) and counts found (3).
_ASKED = "part int, kind int, chunk long, size int, grams binary, a binary, b binary"


def _ask(names: Names, shared, chunk_bytes: int):
    """The texts in chunks: for each a header (kind 2) and its grams that are not broadcast, by part (kind 1)."""

    def rows_of(chunk: int, headers: list[pa.RecordBatch], asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, headers[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for h in headers:
                writer.write_batch(h)
        gram, text, own = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, text, own = gram[order], text[order], own[order]
        rows = [(p, 1, s.stop - s.start, _steps(gram[s]), _pack(text[s]), _pack(own[s])) for p, s in _by_part(gram, names.shift)]
        # Headers are spread over the parts' tasks.
        rows.append((-1 - chunk % (1 << names.part_bits), 2, 0, sink.getvalue().to_pybytes(), b"", b""))
        part, kind, size, *blobs = zip(*rows, strict=True)
        ints = [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(size, pa.int32())]
        yield pa.RecordBatch.from_arrays([*ints, *[pa.array(b, pa.binary()) for b in blobs]], names=["part", "kind", "chunk", "size", "grams", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Deterministic names, so that a task that is run again names its chunks alike.
        chunk = TaskContext.get().partitionId() << 32
        headers, asked, n, held = [], [], 0, 0
        for batch in byte_slices(batches):
            block = TextBlock(batch.column("text"))
            counts = rule_counts(block)
            size, heavy, (gram, text, own) = shared.value.split(*names.grams(block), block.n)
            failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            trust = batch.column("is_target").fill_null(False)
            rare = np.bincount(text, weights=own, minlength=block.n).astype(np.int64)
            arrays = [batch.column("doc_id"), *[pa.array(counts[c].astype(np.int64)) for c in RULES], pa.array(failed), pa.array(size), pa.array(heavy), pa.array(rare), trust]
            headers.append(pa.RecordBatch.from_arrays(arrays, names=["doc_id", *RULES, "base_failed", "size", "heavy", "rare", "trust"]))
            asked.append((gram, text + n, own))
            n, held = n + block.n, held + len(block.data)
            if held >= chunk_bytes:
                yield from rows_of(chunk, headers, asked)
                chunk, headers, asked, n, held = chunk + 1, [], [], 0, 0
        if headers:
            yield from rows_of(chunk, headers, asked)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part and kind: the counts of the grams that are asked for and in the table; headers pass."""
    now, table = None, None
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            part, kind, chunk, size, grams, a, b = row
            if kind == 2:
                out.append((chunk, 2, 0, grams, b"", b"", b""))
                continue
            gram = np.cumsum(_unpack(grams, size), dtype=np.uint64)
            if kind == 0:
                now, table = part, (gram, _unpack(a, size), _unpack(b, size))
                continue
            if part != now or not len(table[0]):
                continue
            k = np.minimum(np.searchsorted(table[0], gram), len(table[0]) - 1)
            found = np.flatnonzero(table[0][k] == gram)
            if len(found):
                text, own = _unpack(a, size)[found], _unpack(b, size)[found]
                order = np.argsort(text, kind="stable")
                k = k[found][order]
                out.append((chunk, 3, len(found), *[_pack(x) for x in (np.diff(text[order], prepend=np.uint64(0)), own[order], table[1][k], table[2][k])]))
        if out:
            chunk, kind, size, *blobs = zip(*out, strict=True)
            ints = [pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays([*ints, *[pa.array(x, pa.binary()) for x in blobs]], names=["chunk", "kind", "size", "a", "own", "raw", "target"])


def _score(shared):
    """Sorted by chunk and kind: the texts of each chunk with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, ratios, seen = None, None, None

        def whole() -> pa.RecordBatch:
            model, h = shared.value, header
            size, trust = h.column("size").to_numpy(), h.column("trust").to_numpy().astype(np.float64)
            # A gram that no other text and no other place has: once in raw, and once in target if the text is trusted.
            alone = (h.column("rare").to_numpy() - seen) * np.log((trust + model.smoothing) / model.smoothing)
            score = (h.column("heavy").to_numpy() + ratios + (alone if model.n_target else 0)) / np.maximum(1, size)
            return pa.RecordBatch.from_arrays([*[h.column(c).combine_chunks() for c in ("doc_id", *RULES, "base_failed")], pa.array(score)], names=["doc_id", *RULES, "base_failed", "score"])

        for batch in batches:
            for _, kind, n, a, *blobs in zip(*[batch.column(c).to_pylist() for c in ("chunk", "kind", "size", "a", "own", "raw", "target")], strict=True):
                if kind == 2:
                    if header is not None:
                        yield whole()
                    header = pa.ipc.open_stream(a).read_all()
                    ratios, seen = np.zeros(header.num_rows), np.zeros(header.num_rows, np.int64)
                    continue
                text = np.cumsum(_unpack(a, n).view(np.int64))
                own, raw, target = (_unpack(b, n).view(np.int64) for b in blobs)
                worth = own * shared.value.ratio(raw, target, own, header.column("size").to_numpy()[text])
                ratios += np.bincount(text, weights=worth, minlength=len(ratios))
                seen += np.bincount(text, weights=own, minlength=len(seen)).astype(np.int64)
        if header is not None:
            yield whole()

    return run


def quality_rules(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, heavy: int = HEAVY, scratch: Scratch | None = None, part_bytes: int = PART_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept for every row of docs, fitted on docs with the documents of
    ``labels.quality`` = 1 as trusted.

    A text without words (null, empty or white space) fails the base rules and scores 0. Null ids and repeated rows
    are judged like others; a row with a null label counts for nothing; further columns are ignored; an empty table gives
    an empty result. A very long text is one slice: a task holds its words as numbers, about 30 bytes a byte of text.
    Docs should be read from files, so that a task that is run again sees its rows in the same order.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "grams")
    names = Names(text_bytes(docs), part_bytes)
    flagged = _with_trust(docs, labels.filter("quality = 1"), MAX_BROADCAST_IDS)
    table = scratch.written(packed_counts(flagged, names, least=2))
    model = Multinomials(table, heavy)
    shared = spark.sparkContext.broadcast(model)
    asked = flagged.mapInArrow(_ask(names, shared, chunk_bytes), _ASKED)
    known = table.select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "size", "grams", F.col("raw").alias("a"), F.col("target").alias("b"))
    met = known.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    found = met.mapInArrow(_answer, "chunk long, kind int, size int, a binary, own binary, raw binary, target binary")
    judged = found.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_score(shared), _RESULT)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
