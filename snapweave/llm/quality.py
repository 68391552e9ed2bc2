"""Document quality by a byte-level convolutional network in numpy.

Filters over `width` bytes slide along overlapping chunks that cover the whole text; each is max-pooled in its
chunk, and the chunks' values, averaged and maximised over the text, give one probability. An embedding of the
bytes followed by a convolution is linear in the bytes, so each filter tap is one table of weights by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold, labelled_sample
from .textbits import text_buffers

SYMBOLS = 256


@dataclass(frozen=True)
class QualityConfig:
    """Network and chunk sizes, training passes, bounds of the labelled sample, and the fold that is never learned from."""

    filters: int = 16
    width: int = 8
    chunk: int = 256
    overlap: int = 32
    passes: int = 12
    batch: int = 32
    rate: float = 0.02
    sample_rows: int = 3000
    sample_bytes: int = 1 << 14
    modulus: int = 3
    held_out: int = 1
    seed: int = 11


class ByteNetwork:
    """Tables of filter taps, their biases, and the weights of the pooled values."""

    def __init__(self, config: QualityConfig) -> None:
        rng = np.random.default_rng(config.seed)
        self.config = config
        self.taps = rng.normal(0, 0.3, (config.width, SYMBOLS, config.filters)).astype(np.float32)
        self.bias = np.zeros(config.filters, np.float32)
        self.out = rng.normal(0, 0.3, 2 * config.filters).astype(np.float32)
        self.shift = np.float32(0)

    def chunks(self, n: int) -> np.ndarray:
        """Starts of the chunks that cover n symbols; neighbours share `overlap`."""
        step = self.config.chunk - self.config.overlap
        return np.arange(0, max(n - self.config.overlap, 1), step)

    def padded(self, text: np.ndarray) -> np.ndarray:
        """The bytes of one text, with spaces up to the end of its last chunk and filter."""
        c = self.config
        out = np.full(int(self.chunks(len(text))[-1]) + c.chunk + c.width - 1, 32, np.uint8)
        out[: len(text)] = text
        return out

    def responses(self, text: np.ndarray) -> np.ndarray:
        """Filter values at every byte of a padded text at which a filter begins."""
        n = len(text) - self.config.width + 1
        values = self.taps[0].take(text[:n], axis=0)
        for k in range(1, self.config.width):
            values += self.taps[k].take(text[k : n + k], axis=0)
        return values

    def windows(self, values: np.ndarray) -> np.ndarray:
        """Chunk by place by filter, over the values of one padded text."""
        c = self.config
        step = c.chunk - c.overlap
        return np.lib.stride_tricks.as_strided(values, ((len(values) - c.chunk) // step + 1, c.chunk, c.filters), (step * values.strides[0], *values.strides))

    def pooled(self, best: np.ndarray) -> np.ndarray:
        active = np.maximum(best + self.bias, 0)
        return np.concatenate([active.mean(0), active.max(0)])

    def score(self, text: np.ndarray) -> float:
        parts = []
        piece = 1 << 20
        c = self.config
        step = (c.chunk - c.overlap) * (piece // (c.chunk - c.overlap))
        for at in range(0, max(len(text), 1), step):  # long texts a megabyte at a time
            if at and len(text) - at <= c.overlap:
                break
            end = at + step + c.overlap
            piece, after = self.padded(text[at:end]), text[end : end + c.width - 1]
            piece[end - at : end - at + len(after)] = after  # the last filters of a piece read on
            parts.append(self.windows(self.responses(piece)).max(1))
        return float(1 / (1 + np.exp(-np.clip(self.pooled(np.concatenate(parts)) @ self.out + self.shift, -30, 30))))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of padded texts; a maximum passes its gradient to its own place only."""
        c = self.config
        joined = np.concatenate(texts)
        begins = np.cumsum([0, *(len(t) for t in texts)])
        values = self.responses(joined)
        grads = {n: np.zeros_like(getattr(self, n)) for n in ("taps", "bias", "out", "shift")}
        places, flows = [], []
        for begin, text, label in zip(begins.tolist(), texts, labels, strict=False):
            windows = self.windows(values[begin : begin + len(text) - c.width + 1])
            place = windows.argmax(1)
            best = np.take_along_axis(windows, place[:, None, :], 1)[:, 0]
            active = np.maximum(best + self.bias, 0)
            pooled = np.concatenate([active.mean(0), active.max(0)])
            error = np.float32(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30))) - label)
            grads["out"] += error * pooled
            grads["shift"] += error
            flow = np.repeat(error * self.out[None, : c.filters] / np.float32(len(best)), len(best), axis=0)
            flow[active.argmax(0), np.arange(c.filters)] += error * self.out[c.filters :]
            flow *= active > 0
            places.append(place + begin + (np.arange(len(best)) * (c.chunk - c.overlap))[:, None])
            flows.append(flow)
        place, flow = np.concatenate(places), np.concatenate(flows)
        grads["bias"] += flow.sum(0)
        for k in range(c.width):
            at = joined[place + k].astype(np.int64) * c.filters + np.arange(c.filters)
            grads["taps"][k] = np.bincount(at.ravel(), flow.ravel(), SYMBOLS * c.filters).reshape(SYMBOLS, c.filters)
        return {n: g / np.float32(len(texts)) for n, g in grads.items()}

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Adam on the log loss."""
        c, rng = self.config, np.random.default_rng(self.config.seed)
        names = ("taps", "bias", "out", "shift")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        texts, turn = [self.padded(t) for t in texts], 0
        for epoch in range(c.passes):
            rate = c.rate * (1 - epoch / c.passes)
            order = rng.permutation(len(texts))
            for at in range(0, len(order), c.batch):
                some = order[at : at + c.batch]
                grads = self.gradients([texts[i] for i in some], labels[some])
                turn += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.99 * second[n] + 0.01 * grads[n] * grads[n]
                    setattr(self, n, (getattr(self, n) - rate * (first[n] / (1 - 0.9**turn)) / (np.sqrt(second[n] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32))


def fit_quality(sample: list[tuple[str, int]], config: QualityConfig) -> ByteNetwork:
    """A network trained on (text, label) pairs; with no pairs, all scores are 0.5."""
    network = ByteNetwork(config)
    if sample:
        network.train([np.frombuffer(text.encode(), np.uint8) for text, _ in sample], np.array([label for _, label in sample], np.float32))
    else:
        network.out[:] = 0
    return network


def _score(network: ByteNetwork):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            scores = [network.score(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Whole texts are scored; training takes `sample_rows` labelled documents, in excerpts of about `sample_bytes` where they are longer. Null
    and empty texts are one chunk of padding. A null doc_id is not held out. Rows that repeat a doc_id are
    scored each. Labels other than 0 and 1 are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    network = fit_quality(labelled_sample(source, labels, "quality", config.modulus, config.held_out, config.sample_rows, config.sample_bytes), config)
    scored = source.mapInArrow(_score(network), "doc_id long, score double")
    held = F.coalesce(fold(config.modulus) == config.held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
