"""Quality classifier: a byte-level convolutional network in numpy.

Bytes get a fixed random code, learned filters run over every byte position, their activations are averaged over overlapping chunks
that cover the whole text, a second learned layer looks at each chunk, and its outputs are max-pooled over all chunks and
combined into one probability. Long texts go through in pieces that end at chunk borders, with the running maximum carried
along, so memory is bounded and no byte is left out.

Training takes a bounded sample of labelled rows to the driver: at most ``max_rows`` rows (those whose hashed ids come
first, which is a fixed pseudo-random choice) with texts of at most ``max_bytes`` bytes each. Everything else is per row.

Cases: null text is scored as empty text, an empty text as one chunk of padding; repeated rows get equal scores; further
columns, and any lang, source or id, never reach the network; rows of ``labels`` without a document, without a label or
with a null id are no samples; without samples of both labels every score is the share of label 1 (1.0 with no labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.llm.common import id_and_bytes, slices

WIDTH, EMBED, FILTERS, HIDDEN = 6, 8, 24, 24
BLOCK, CHUNK_BLOCKS = 64, 4  # a chunk is 256 positions, and starts every 64
PRIOR = 64  # positions' worth of weight on the average
PIECE = 1 << 18  # positions that go through the filters at a time
MAX_ROWS, MAX_BYTES = 2500, 8192
ACCEPT = 0.7  # least score of an accepted text
Z64 = np.float32


@dataclass
class ByteNet:
    """Parameters: byte codes, filters, chunk layer (with the scale of its inputs) and output weights."""

    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def windows(self, data: np.ndarray) -> np.ndarray:
        """(positions, WIDTH * EMBED): the byte codes under each filter position."""
        x = self.embed[data]
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0).transpose(0, 2, 1).reshape(-1, WIDTH * EMBED)

    def chunk_means(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean filter activation of each overlapping chunk of a padded text, and the positions of each chunk."""
        n = len(data) - WIDTH + 1
        act = np.maximum(self.windows(data) @ self.filters + self.filter_bias, 0)
        sums = np.add.reduceat(act, np.arange(0, n, BLOCK), axis=0)
        size = np.full(len(sums), BLOCK, np.float32)
        size[-1] = n - BLOCK * (len(sums) - 1)
        if len(sums) <= CHUNK_BLOCKS:
            return sums.sum(axis=0, keepdims=True) / n, np.array([n], np.float32)
        total = np.concatenate([np.zeros((1, FILTERS), np.float64), np.cumsum(sums, axis=0, dtype=np.float64)])
        count = np.concatenate([[0], np.cumsum(size, dtype=np.float64)])
        # chunks start at every block from which a whole chunk is left; the last ends with the text
        size = count[CHUNK_BLOCKS:] - count[:-CHUNK_BLOCKS]
        return ((total[CHUNK_BLOCKS:] - total[:-CHUNK_BLOCKS]) / size[:, None]).astype(np.float32), size

    def normal(self, means: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Standardised chunk means, drawn to the average where a chunk has few positions (short texts say little)."""
        return (means - self.mean) / self.scale * (size / (size + PRIOR))[:, None].astype(np.float32)

    def pooled(self, body: bytes) -> np.ndarray:
        """Chunk layer, max-pooled over all chunks of the whole text."""
        data = padded(body)
        best = None
        step = PIECE - PIECE % BLOCK
        for at in range(0, max(1, len(data) - WIDTH + 1), step):
            # a piece reaches one chunk into the next one, so chunks over its end are seen
            piece = data[at:at + step + BLOCK * CHUNK_BLOCKS + WIDTH - 1]
            if at and len(piece) < BLOCK * CHUNK_BLOCKS + WIDTH - 1:
                break  # shorter than a chunk: wholly inside what the piece before has covered
            z = np.maximum(self.normal(*self.chunk_means(piece)) @ self.hidden + self.hidden_bias, 0).max(axis=0)
            best = z if best is None else np.maximum(best, z)
        return best

    def score(self, body: bytes | None) -> float:
        z = float(self.pooled(body or b"") @ self.out + self.out_bias)
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))


def padded(body: bytes) -> np.ndarray:
    """Bytes of a text with zero bytes behind it, so that every byte starts a filter position."""
    return np.frombuffer(body + bytes(WIDTH), np.uint8)


def train(texts: list[bytes], labels: list[int], epochs: int = 5, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> ByteNet:
    """Fit by Adam on the log loss, gradients by hand: max-pooling passes them to the winning chunk of each hidden unit."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    net = ByteNet(rng.normal(0, 1, (256, EMBED)).astype(Z64), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(Z64),
                  np.zeros(FILTERS, Z64), np.zeros(FILTERS, Z64), np.ones(FILTERS, Z64),
                  rng.normal(0, FILTERS ** -0.5, (FILTERS, HIDDEN)).astype(Z64), np.zeros(HIDDEN, Z64),
                  np.zeros(HIDDEN, Z64), 0.0)
    share = float(y.mean()) if len(y) else 1.0
    if not 0 < share < 1:
        net.out_bias = 60.0 if share else -60.0
        return net
    net.out_bias = float(np.log(share / (1 - share)))
    net.out[:] = rng.normal(0, 0.1, HIDDEN)
    first = np.concatenate([net.chunk_means(padded(t))[0] for t in texts[:400]])
    net.mean, net.scale = first.mean(axis=0), first.std(axis=0) + 1e-3
    names = ["filters", "filter_bias", "hidden", "hidden_bias", "out"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    v = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            grads = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
            ids = order[at:at + batch]
            for i in ids:
                back(net, texts[i], y[i], grads)
            step += 1
            lr = rate * (0.5 ** max(0, epoch - epochs // 2)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in grads.items():
                g = g / len(ids)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                new = getattr(net, k) - lr * m[k] / (np.sqrt(v[k]) + 1e-8)
                setattr(net, k, float(new) if k == "out_bias" else new.astype(Z64))
    return net


def back(net: ByteNet, body: bytes, y: float, grads: dict) -> None:
    """Add the gradient of one text's log loss."""
    data = padded(body)
    n = len(data) - WIDTH + 1
    win = net.windows(data)
    pre = win @ net.filters + net.filter_bias
    act = np.maximum(pre, 0)
    blocks = -(-n // BLOCK)
    starts = np.arange(max(1, blocks - CHUNK_BLOCKS + 1)) * BLOCK
    ends = np.minimum(starts + BLOCK * CHUNK_BLOCKS, n)
    total = np.concatenate([np.zeros((1, FILTERS), np.float64), np.cumsum(np.add.reduceat(act, np.arange(0, n, BLOCK), axis=0), axis=0, dtype=np.float64)])
    lo = starts // BLOCK
    hi = np.minimum(lo + CHUNK_BLOCKS, blocks)
    means = ((total[hi] - total[lo]) / (ends - starts)[:, None]).astype(Z64)
    normal = net.normal(means, ends - starts)
    z = np.maximum(normal @ net.hidden + net.hidden_bias, 0)
    win_chunk = z.argmax(axis=0)
    top = z[win_chunk, np.arange(HIDDEN)]
    logit = float(top @ net.out + net.out_bias)
    d = 1 / (1 + np.exp(-max(-60.0, min(60.0, logit)))) - y
    grads["out"] += d * top
    grads["out_bias"] += d
    dz = d * net.out * (top > 0)
    grads["hidden"] += normal[win_chunk].T * dz
    grads["hidden_bias"] += dz
    if abs(d) < 0.02:
        return
    dmean = np.zeros((len(starts), FILTERS), Z64)  # only winning chunks get any
    np.add.at(dmean, win_chunk, (net.hidden * dz).T)
    dmean /= net.scale * (ends - starts + PRIOR)[:, None].astype(Z64)
    for c in np.unique(win_chunk):
        a, b = int(starts[c]), int(ends[c])
        dpre = (pre[a:b] > 0) * dmean[c]
        grads["filters"] += win[a:b].T @ dpre
        grads["filter_bias"] += dpre.sum(axis=0)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that never train: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> ByteNet:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))))
    # twice the rows wanted, as long texts fall out; so few rows that the documents need not be shuffled to meet them
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(2 * max_rows)
    texts = id_and_bytes(docs).where(F.octet_length("body") <= max_bytes)
    sample = (texts.join(F.broadcast(first), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "body").limit(max_rows)
              .select("label", "body").collect())
    return train([bytes(r["body"]) for r in sample], [r["label"] for r in sample])


def score(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: the probability of label 1, over the whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([net.score(x) for x in b.column("body").to_pylist()], pa.float64())],
                names=["doc_id", "score"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: ByteNet, least: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores ``least`` or more; no shuffle."""

    @F.pandas_udf("double")
    def scores(bodies: pd.Series) -> pd.Series:
        return pd.Series([net.score(b) for b in bodies], dtype="float64")

    return docs.where(scores(F.col(text_col).cast("binary")) >= least)
