"""Quality by a byte-level convolutional network in numpy.

A filter looks at WIDTH bytes.  Filters slide over the whole text by STRIDE bytes, so that what they see overlaps, and
are max-pooled over chunks of SEGMENT positions, of which each overlaps half of the next.  A chunk's maxima give its
log-odds by a logistic layer, and the text's probability is that of the mean log-odds of all its chunks.
A filter is stored as a table of weights by place and byte, that is, with the byte embedding multiplied in, so a
position costs WIDTH table rows whatever the embedding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.llm.samples import held_out, pick, texts_of

WIDTH, STRIDE, FILTERS, SEGMENT = 8, 4, 24, 64
#: Bounds of the training sample: texts of each label, bytes of all; passes over it, texts in a step, step size and weight decay.
EACH_LABEL, SAMPLE_BYTES, PASSES, BATCH, RATE, DECAY = 800, 64 << 20, 14, 32, 0.01, 1e-4
#: Training also sees a crop of each text under the text's label, of about these lengths in bytes, so that a short text is
#: judged by what it says.  Called good on held-out rows of a table of 10,000 documents, good and poor texts: 93 and 36 per
#: cent of first 32 bytes, 97 and 30 of 64, all and 19 of 128, all and 7 of whole texts; the empty text scores 0.82.
CROPS = (32, 128, 512)
#: Half chunks convolved at once.
BLOCK = 1 << 10


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded and joined: bytes; half chunks of each text.

    Each text is padded with zero bytes to whole half chunks, two at least, so that at its last position there is padding alone."""
    half = SEGMENT // 2
    counts = np.array([max(2, -(-(len(t) + STRIDE) // (STRIDE * half))) for t in texts])
    flat = np.zeros(int(counts.sum()) * half * STRIDE + WIDTH, np.uint8)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * half * STRIDE
    return flat, counts


class Network:
    """tables[place, byte, filter]; the logistic layer's weights stand for the maxima of the filters."""

    def __init__(self, tables: np.ndarray, out: np.ndarray, bias: float):
        self.tables, self.out, self.bias = tables.astype(np.float32), out.astype(np.float64), float(bias)

    def halves(self, flat: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter, not below zero, in each half chunk, and its position there.

        At a text's last position, in its `last` half chunk, a filter would see the next text's bytes, so it counts for nothing."""
        size, k, count = SEGMENT // 2, self.tables.shape[2], len(last)
        top, best = np.empty((count, k), np.float32), np.empty((count, k), np.int16)
        for a in range(0, count, BLOCK):
            n = min(BLOCK, count - a) * size
            at = a * size * STRIDE
            part = self.tables[0][flat[at : at + n * STRIDE : STRIDE]]
            for place in range(1, WIDTH):
                part += self.tables[place][flat[at + place : at + (n - 1) * STRIDE + place + 1 : STRIDE]]
            part = part.reshape(-1, size, k)
            part[last[a : a + len(part)], -1] = -np.inf
            part.argmax(axis=1, out=(own := np.empty((len(part), k), np.intp)))
            best[a : a + len(part)] = own
            top[a : a + len(part)] = np.maximum(np.take_along_axis(part, own[:, None], axis=1)[:, 0], 0)
        return top, best

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, tuple]:
        """(texts, filters): the mean over a text's chunks of the maxima in each; and what the backward step needs."""
        flat, counts = _layout(texts)
        last = np.zeros(int(counts.sum()), bool)
        last[np.cumsum(counts) - 1] = True
        half, best = self.halves(flat, last)
        chunk = np.maximum(half[:-1], half[1:])[~last[:-1]]  # a text of n halves has n - 1 chunks
        starts = np.concatenate([[0], np.cumsum(counts - 1)[:-1]])
        out = np.add.reduceat(chunk, starts, axis=0, dtype=np.float64) / (counts - 1)[:, None]
        return out, (flat, half, best, counts, last)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = (self.pooled(texts)[0] * self.out).sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def slopes(self, dz: np.ndarray, feats: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients of the tables, the output weights and the bias, given that of each text's logit."""
        flat, half, best, counts, last = kept
        k = self.tables.shape[2]
        by_text = np.repeat(np.arange(len(counts)), counts - 1)
        up = (dz / (counts - 1))[by_text, None] * self.out
        index = np.flatnonzero(~last[:-1])
        to_half = np.zeros(half.shape)
        first = half[index] >= half[index + 1]
        np.add.at(to_half, index, np.where(first, up, 0))
        np.add.at(to_half, index + 1, np.where(first, 0, up))
        grad = np.zeros(WIDTH * 256 * k)
        r, f = np.nonzero((to_half != 0) & (half > 0))
        where, amount = (r * (SEGMENT // 2) + best[r, f]) * STRIDE, to_half[r, f]
        for place in range(WIDTH):
            grad += np.bincount((place * 256 + flat[where + place].astype(np.int64)) * k + f, amount, len(grad))
        return grad.reshape(self.tables.shape), feats.T @ dz, float(dz.sum())


def crop(text: bytes, length: int, r: np.random.Generator) -> bytes:
    """Some words of a text from a random place on, `length` bytes on average and 12 at least."""
    n = int(r.exponential(length)) + 12
    at = text.rfind(b" ", 0, int(r.integers(0, max(1, len(text) - n))) + 1) + 1
    return text[at : at + n].rsplit(b" ", 1)[0]


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Network:
    """Cross entropy by Adam, with the same weight for both labels."""
    r = np.random.default_rng(seed)
    net = Network(r.normal(0, 0.25, (WIDTH, 256, FILTERS)), r.normal(0, 0.1, FILTERS), 0.0)
    if not texts or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Network(net.tables * 0, net.out * 0, np.log((share + 1e-3) / (1 - share + 1e-3)))
    crops = [crop(t, CROPS[i % len(CROPS)], r) for i, t in enumerate(texts)]
    texts, labels = [*texts, *crops], np.append(labels, labels)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    moments = [[np.zeros(x.shape), np.zeros(x.shape)] for x in (net.tables, net.out, np.zeros(1))]
    step = 0
    for pass_ in range(PASSES):
        order = r.permutation(len(texts))
        rate = RATE * (1 - pass_ / PASSES)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            feats, kept = net.pooled([texts[i] for i in own])
            p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.bias, -60, 60)))
            dt, do, db = net.slopes((p - labels[own]) * weight[own] / len(own), feats, kept)
            step += 1
            moved = []
            for x, g, m in zip((net.tables, net.out, np.array([net.bias])), (dt + DECAY * net.tables, do + DECAY * net.out, np.array([db])), moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                moved.append(x - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8))
            net = Network(moved[0], moved[1], moved[2][0])
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, test_fold: int = 1) -> Network:
    """Fit on at most EACH_LABEL whole texts of each label, and SAMPLE_BYTES bytes of text, outside the held-out fold."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out("doc_id", folds, test_fold)).join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = [pick(known.filter(F.col("quality") == q).select("doc_id").distinct(), EACH_LABEL, 3).withColumn("quality", F.lit(q)) for q in (0, 1)]
    rows = texts_of(docs, picked[0].unionByName(picked[1]), 3, SAMPLE_BYTES)
    return fit([r.text.encode() for r in rows], np.array([r.quality for r in rows], np.float64))


def score(docs: DataFrame, net: Network, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Add the probability that the whole `text` is good, as column `name`.

    A null text counts as empty, and an empty text as padding alone.  An existing column `name` is replaced; equal
    texts get equal scores; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.tables, net.out, net.bias))

    def make():
        net = Network(*shared.value)

        def work(batch: pa.RecordBatch) -> list:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            out, part, size = [], [], 0
            for t in texts:  # some texts at a time: convolved values take many times the room of bytes
                part.append(t)
                size += len(t)
                if size > 1 << 19:
                    out.append(net.scores(part))
                    part, size = [], 0
            if part:
                out.append(net.scores(part))
            return [pa.array(np.concatenate(out))]

        return work

    return map_batches(docs, "text", make, [pa.field(name, pa.float64())], keep)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's quality; fold 1 of three is held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with all their columns."""
    scored = score(docs, train(docs, labels), name="__quality")
    return scored.filter("__quality >= 0.5").select([F.col(f"`{c}`") for c in docs.columns])
