"""A byte-level convolutional network in numpy that gives the probability that a text is of good quality.

A text's bytes are covered by overlapping chunks, the whole of it. In each chunk learned filters run over embedded
bytes, and each filter keeps its maximum; a hidden layer mixes the filters of a chunk; each hidden unit keeps its
maximum over all chunks; a logistic unit makes one probability of these. Chunks of a text are scored independently
and only their running maxima are kept, so a text may be as long as memory holds its bytes.

Learning uses at most ``MAX_TRAIN`` labelled documents (those with the smallest hashes of the id), every chunk of each:
all chunks are run forward, and only those that hold a maximum are run backward, as no other has a gradient. Scoring
uses every chunk of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import byte_slices, packed, text_or_empty
from lodemill.llm.textblock import TextBlock

CHUNK, STEP = 256, 224
#: Bytes of a filter, and the distance between its places.
WIDTH, STRIDE = 6, 2
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: Byte value of what lies beyond the end.
PAD = 256

MAX_TRAIN = 5000
EPOCHS = 14
PREDICT_AT = 0.7


def chunk_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": draw(257, EMBED, scale=0.7),
            "filter": draw(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "filter_0": np.zeros(FILTERS, np.float32),
            "hidden": draw(FILTERS + 1, HIDDEN, scale=FILTERS**-0.5),
            "hidden_0": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=HIDDEN**-0.5),
            "out_0": np.zeros(1, np.float32),
        }

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED) of chunks of byte values."""
        e = self.p["embed"][x]
        places = (CHUNK - WIDTH) // STRIDE + 1
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), places, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2]))
        return np.ascontiguousarray(view)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS + 1): each filter's maximum, and the share of the chunk that is text."""
        out = np.empty((len(x), FILTERS), np.float32)
        for k in range(0, len(x), 64):
            w = self._windows(x[k : k + 64])
            out[k : k + 64] = (w.reshape(-1, w.shape[2]) @ self.p["filter"]).reshape(w.shape[0], w.shape[1], FILTERS).max(1)
        return np.concatenate([np.maximum(out + self.p["filter_0"], 0), self._filled(x)], 1)

    @staticmethod
    def _filled(x: np.ndarray) -> np.ndarray:
        return (x != PAD).mean(1, dtype=np.float32)[:, None]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x) @ self.p["hidden"] + self.p["hidden_0"], 0)

    def probability(self, top: np.ndarray) -> np.ndarray:
        z = top.astype(np.float64) @ self.p["out"] + self.p["out_0"][0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """x: chunks of several texts; first: where each text's chunks begin; y: labels."""
        p = self.p
        every = self.hidden(x)
        top = np.maximum.reduceat(every, first)
        text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        dz = ((self.probability(top) - y) * weight / len(y)).astype(np.float32)
        g = {"out": top.T @ dz, "out_0": np.array([dz.sum()], np.float32)}
        # Only the chunk with the maximum of a unit learns; ties share.
        is_top = (every == top[text]) & (every > 0)
        share = np.add.reduceat(is_top.astype(np.float32), first)
        some = np.flatnonzero(is_top.any(1))
        x, text = x[some], text[some]
        dh = np.where(is_top[some], (dz[:, None] * p["out"])[text] / np.maximum(share[text], 1), 0)
        g |= {k: np.zeros_like(p[k]) for k in ("hidden", "hidden_0", "filter", "filter_0", "embed")}
        for k in range(0, len(x), 256):
            self._backward(g, x[k : k + 256], dh[k : k + 256])
        return g

    def _backward(self, g: dict[str, np.ndarray], x: np.ndarray, dh: np.ndarray) -> None:
        """Add what chunks give to the gradients, from those of their hidden units."""
        p, w = self.p, self._windows(x)
        conv = (w.reshape(-1, w.shape[2]) @ p["filter"]).reshape(w.shape[0], w.shape[1], FILTERS)
        at = conv.argmax(1)
        best = np.take_along_axis(conv, at[:, None], 1)[:, 0] + p["filter_0"]
        f = np.concatenate([np.maximum(best, 0), self._filled(x)], 1)
        g["hidden"] += f.T @ dh
        g["hidden_0"] += dh.sum(0)
        df = (dh @ p["hidden"][:FILTERS].T) * (best > 0)
        g["filter_0"] += df.sum(0)
        rows = w[np.arange(len(x))[:, None], at]  # (chunks, FILTERS, WIDTH * EMBED)
        g["filter"] += np.einsum("cf,cfk->kf", df, rows)
        de = (df[:, :, None] * p["filter"].T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
        bytes_at = x[np.arange(len(x))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        g["embed"] += np.stack([np.bincount(bytes_at.ravel(), de[..., k].ravel(), 257) for k in range(EMBED)], 1).astype(g["embed"].dtype)


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Net:
    """texts: the bytes of each. Adam on the logistic loss; both labels weigh the same in total."""
    net, r = Net(), np.random.default_rng(seed)
    if not len(texts):
        return net
    share = np.bincount(labels.astype(int), minlength=2) / len(labels)
    weight = np.where(labels == 1, 0.5 / max(share[1], 0.05), 0.5 / max(share[0], 0.05))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, steps = 0, epochs * -(-len(texts) // 32)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), 32):
            own = order[k : k + 32]
            chunks = [_chunks(texts[i], chunk_starts(len(texts[i])), len(texts[i])) for i in own]
            x = np.concatenate(chunks)
            first = np.concatenate([[0], np.cumsum([len(c) for c in chunks])[:-1]])
            g = net.gradients(x, first, labels[own], weight[own])
            step += 1
            rate = 0.008 * (1 - 0.95 * step / steps)
            for name, value in net.p.items():
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
                value -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
    return net


def _chunks(data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Byte values of the chunks that begin at starts; PAD from ``end`` on."""
    at = starts[:, None] + np.arange(CHUNK)
    return np.where(at < end, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.uint8(0), PAD).astype(np.int16)


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out. A null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Net:
    """Learn from labelled documents that are not held out, whole texts of at most ``max_train``, which the driver holds.

    Rows with a null id or a null label are not learned from. Of rows that share an id the least text counts, null as
    the empty text. Without any labelled document the network is untrained.
    """
    chosen = labels.filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 2)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).toArrow().sort_by("doc_id")
    block = TextBlock(found.column("text"))
    texts = [block.data[block.at[i] : block.at[i + 1]] for i in range(block.n)]
    return train(texts, found.column("quality").to_numpy().astype(np.float32))


def scores(docs: DataFrame, net: Net, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts are one chunk of padding. Null ids and repeated rows are scored like others; further columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            out = _tops(TextBlock(batch.column("text")), shared.value)
            score = shared.value.probability(out)
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= predict_at).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _tops(block: TextBlock, net: Net) -> np.ndarray:
    """(texts, HIDDEN): each hidden unit's maximum over all chunks of a text."""
    counts = np.maximum(1, -(-(np.diff(block.at) - (CHUNK - STEP)) // STEP))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((block.n, HIDDEN), np.float32)
    text = np.repeat(np.arange(block.n), counts)
    starts = block.at[text] + (np.arange(first[-1]) - first[text]) * STEP
    ends = block.at[text + 1]
    for k in range(0, len(text), 1024):
        at = starts[k : k + 1024, None] + np.arange(CHUNK)
        data = block.data[np.minimum(at, max(0, len(block.data) - 1))] if len(block.data) else np.zeros(at.shape, np.uint8)
        x = np.where(at < ends[k : k + 1024, None], data, np.int16(PAD))
        np.maximum.at(out, text[k : k + 1024], net.hidden(x))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, predict_at: float = PREDICT_AT) -> DataFrame:
    """docs without the rows that the network, fitted on them, rejects; all columns as they were.

    Null and empty texts are judged as one chunk of padding; null ids and repeated rows are judged like others; clashing
    names of further columns do no harm; an empty table gives an empty result.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            score = net.value.probability(_tops(TextBlock(batch.column("text")), net.value))
            yield batch.select(["d"]).filter(pa.array(score >= predict_at))

    both = packed(docs).select("d", F.col("d.text").cast("string").alias("text"))
    return both.mapInArrow(judge, f"d {packed(docs).schema['d'].dataType.simpleString()}").select("d.*")
