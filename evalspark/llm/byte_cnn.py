"""A byte-level convolutional text classifier in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a block; a chunk is two neighbouring blocks, so chunks overlap by half and cover the whole text.
BLOCK = 256
#: Bytes a filter sees.
WIDTH = 5
#: A short chunk's length is an input of the chunk's score, divided by this.
LENGTH_SCALE = 8.0
#: Share of the texts of a step, of either label, that are cut to a random span of less than SHORT bytes.
CROPPED, SHORT = 0.08, 256
#: Small samples are passed over more often, up to so many steps.
LEAST_STEPS = 300


@dataclass
class ByteCnn:
    """Filters as one table per place of the window (byte value to filter inputs), and a small layer over chunks."""

    filters: np.ndarray  # (WIDTH, 256, F)
    bias: np.ndarray  # (F,)
    hidden: np.ndarray  # (F + 1, H)
    hidden_bias: np.ndarray  # (H,)
    out: np.ndarray  # (H,)
    out_bias: np.ndarray  # (1,)

    def params(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    @classmethod
    def start(cls, n_filters: int, n_hidden: int, seed: int) -> ByteCnn:
        r = np.random.default_rng(seed)
        f32 = lambda x: np.ascontiguousarray(x, dtype=np.float32)
        return cls(
            f32(r.normal(0, 0.25, (WIDTH, 256, n_filters))),
            f32(np.zeros(n_filters)),
            f32(r.normal(0, 1 / np.sqrt(n_filters), (n_filters + 1, n_hidden))),
            f32(np.zeros(n_hidden)),
            f32(r.normal(0, 1 / np.sqrt(n_hidden), n_hidden)),
            f32(np.zeros(1)),
        )

    def convolve(self, padded: np.ndarray) -> np.ndarray:
        """Filter inputs at every window of ``padded`` (all axes but the last stay)."""
        n = padded.shape[-1] - WIDTH + 1
        total = np.take(self.filters[0], padded[..., :n], axis=0)
        part = np.empty_like(total)
        for j in range(1, WIDTH):
            np.take(self.filters[j], padded[..., j : j + n], axis=0, out=part, mode="clip")
            total += part
        return total

    def chunk_scores(self, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of chunks from their pooled filters (n, F) and lengths in bytes."""
        x = np.concatenate([chunks, (np.log1p(sizes) / LENGTH_SCALE)[:, None].astype(np.float32)], axis=1)
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each value of a flat byte array; every byte is read. Empty texts have a score."""
        lengths = np.diff(offsets)
        spans = np.maximum(lengths, 1) + WIDTH - 1
        at = np.concatenate([[0], np.cumsum(spans)])
        padded = np.zeros(at[-1], np.uint8)
        for i in np.flatnonzero(lengths):
            padded[at[i] : at[i] + lengths[i]] = data[offsets[i] : offsets[i + 1]]
        n_blocks = np.maximum(1, -(-lengths // BLOCK))
        first = np.concatenate([[0], np.cumsum(n_blocks)])
        within = np.arange(first[-1]) - np.repeat(first[:-1], n_blocks)
        start = np.repeat(at[:-1], n_blocks) + within * BLOCK
        size = np.minimum(BLOCK, np.maximum(1, np.repeat(lengths, n_blocks)) - within * BLOCK)
        pooled = np.empty((first[-1], len(self.bias)), np.float32)
        step = 256  # blocks at a time: the activations stay in the processor's cache
        for a in range(0, first[-1], step):
            b = min(a + step, first[-1])
            lo, hi = start[a], start[b - 1] + size[b - 1]
            act = self.convolve(padded[lo : hi + WIDTH - 1])
            edges = np.empty(2 * (b - a), np.int64)
            edges[0::2], edges[1::2] = start[a:b] - lo, start[a:b] + size[a:b] - lo
            pooled[a:b] = np.maximum.reduceat(act, edges[:-1], axis=0)[0::2]
        pooled = np.maximum(pooled + self.bias, 0)
        left = np.delete(np.arange(first[-1]), (first[1:] - 1)[n_blocks > 1])
        right = np.where(np.repeat(n_blocks, n_blocks)[left] > 1, left + 1, left)
        z = self.chunk_scores(np.maximum(pooled[left], pooled[right]), size[left] + np.where(right > left, size[right], 0))
        n_chunks = np.maximum(1, n_blocks - 1)
        mean = np.add.reduceat(z.astype(np.float64), np.concatenate([[0], np.cumsum(n_chunks)])[:-1]) / n_chunks
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def fit(texts: list[bytes], labels: list[int], *, n_filters: int = 32, n_hidden: int = 16, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Train by Adam on the logistic loss, both classes weighted alike; a step takes ``batch`` whole texts.

    A share of the texts, whatever their label, is cut to a short span, so that shortness itself says nothing. With one
    class only, the model answers that class.
    """
    model = ByteCnn.start(n_filters, n_hidden, seed)
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model.out[:] = 0
        model.out_bias[:] = 0 if len(y) == 0 else (8 if y[0] else -8)
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    r = np.random.default_rng(seed)
    first_moment, second = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()]
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(y)))
    steps_all, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(order), batch):
            step += 1
            part = order[a : a + batch]
            grads = _gradients(model, [_spanned(texts[i], r) for i in part], y[part], weight[part])
            lr = rate * (1 - step / (steps_all + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(model.params(), grads, first_moment, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * m / (np.sqrt(v) + 1e-8)
    return model


def _spanned(text: bytes, r: np.random.Generator) -> bytes:
    """The text, or with probability CROPPED a random span of it of less than SHORT bytes."""
    if r.random() >= CROPPED:
        return text
    span = int(r.integers(0, SHORT))
    at = int(r.integers(0, max(1, len(text) - span)))
    return text[at : at + span]


def _pooled(model: ByteCnn, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all blocks of the texts: bytes, size, where each filter is largest and its value there; and blocks per text.

    A few blocks at a time are convolved, so long texts need no more memory for it than short ones.
    """
    count = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    block = np.zeros((count.sum(), BLOCK + WIDTH - 1), np.uint8)
    size = np.empty(len(block), np.int64)
    at = 0
    for t, n in zip(texts, count, strict=True):
        flat = np.zeros(n * BLOCK + WIDTH - 1, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        block[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, BLOCK + WIDTH - 1)[::BLOCK]
        size[at : at + n] = np.clip(len(t) - np.arange(n) * BLOCK, 1, BLOCK)
        at += n
    where, raw = np.empty((len(block), len(model.bias)), np.int64), np.empty((len(block), len(model.bias)), np.float32)
    for a in range(0, len(block), 64):
        act = model.convolve(block[a : a + 64])
        act[np.arange(BLOCK)[None, :] >= size[a : a + 64, None]] = -np.inf
        where[a : a + 64] = act.argmax(axis=1)
        raw[a : a + 64] = np.take_along_axis(act, where[a : a + 64, None, :], 1)[:, 0, :] + model.bias
    return block, size, where, raw, count


def _gradients(model: ByteCnn, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    block, size, where, raw, count = _pooled(model, texts)
    pooled = np.maximum(raw, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    left = np.delete(np.arange(first[-1]), (first[1:] - 1)[count > 1])
    right = np.where(np.repeat(count, count)[left] > 1, left + 1, left)
    take_right = pooled[right] > pooled[left]
    chunks = np.where(take_right, pooled[right], pooled[left])
    length = (np.log1p(size[left] + np.where(right > left, size[right], 0)) / LENGTH_SCALE).astype(np.float32)
    x = np.concatenate([chunks, length[:, None]], axis=1)
    pre = x @ model.hidden + model.hidden_bias
    h = np.maximum(pre, 0)
    n_chunks = np.maximum(1, count - 1)
    text_of = np.repeat(np.arange(len(count)), n_chunks)
    z = np.bincount(text_of, h @ model.out + model.out_bias, len(count)) / n_chunks
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    dz = (((p - y) * weight / len(y)) / n_chunks)[text_of].astype(np.float32)
    d_out, d_out_bias = h.T @ dz, np.array([dz.sum()], np.float32)
    dh = np.where(pre > 0, dz[:, None] * model.out, 0)
    d_hidden, d_hidden_bias = x.T @ dh, dh.sum(0)
    dc = (dh @ model.hidden.T)[:, :-1]
    d_pooled = np.zeros_like(pooled)
    np.add.at(d_pooled, left, np.where(take_right, 0, dc))
    np.add.at(d_pooled, right, np.where(take_right, dc, 0))
    d_pooled[raw <= 0] = 0
    b, f = np.nonzero(d_pooled)
    g, at = d_pooled[b, f], where[b, f]
    n_f = len(model.bias)
    d_filters = np.stack([np.bincount(block[b, at + j].astype(np.int64) * n_f + f, g, 256 * n_f).reshape(256, n_f) for j in range(WIDTH)]).astype(np.float32)
    return [d_filters + 1e-5 * model.filters, d_pooled.sum(0), d_hidden, d_hidden_bias, d_out, d_out_bias]
