"""Additive quantisation of vectors: residual codebooks over all dimensions, beam-search encoding, stored norms, lookup tables."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of x; a centroid that loses all its vectors takes one of the worst placed."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(c) < k:
        c = np.concatenate([c, rng.normal(scale=1e-3, size=(k - len(c), x.shape[1])).astype(x.dtype)])
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        order = near.argsort(kind="stable")
        counts = np.bincount(near, minlength=k)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        full = counts > 0
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / counts[full, None]
        if not full.all():
            empty = np.flatnonzero(~full)
            worst = ((x - c[near]) ** 2).sum(axis=1).argsort()[::-1][: len(empty)]
            c[empty[: len(worst)]] = x[worst]
    return c


class AdditiveQuantizer:
    """Codebooks over all dimensions; a vector is the sum of one word of each."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = [np.ascontiguousarray(b, dtype=np.float32) for b in books]
        self.start = np.concatenate([[0], np.cumsum([len(b) for b in books])]).astype(np.int64)
        self.words = np.concatenate(self.books)

    @classmethod
    def fit(cls, x: np.ndarray, sizes: tuple[int, ...], rounds: int = 8, seed: int = 7) -> AdditiveQuantizer:
        """Fit each book on what the books before it leave over."""
        left, books = x.astype(np.float32), []
        for i, k in enumerate(sizes):
            c = kmeans(left, k, rounds, seed + i)
            books.append(c)
            left = left - c[(left @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)]
        return cls(books)

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) of the best of `beam` partial sums kept at each book, and the squared norms of the sums."""
        n = len(x)
        dots = x.astype(np.float32) @ self.words.T
        cross = self.words @ self.words.T
        norms = np.einsum("ij,ij->i", self.words, self.words)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        cost = np.zeros((n, 1), dtype=np.float32)
        for m, book in enumerate(self.books):
            a, b = self.start[m], self.start[m + 1]
            step = (norms[a:b] - 2 * dots[:, a:b])[:, None, :] + cost[:, :, None]
            for i in range(m):
                step += 2 * cross[self.start[i] + codes[:, :, i], a:b]
            flat = step.reshape(n, -1)
            keep = min(beam if m + 1 < len(self.books) else 1, flat.shape[1])
            top = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, word = top // len(book), top % len(book)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
            cost = np.take_along_axis(flat, top, axis=1)
        codes = codes[:, 0, :]
        return codes, np.einsum("ij,ij->i", s := self.decode(codes), s)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, m]] for m, b in enumerate(self.books))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Lookup table (words of all books, queries) of inner products."""
        return self.words @ queries.astype(np.float32).T

    def scores(self, table: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(items, queries): the cosine to each query by lookups alone, from the items' codes and stored norms."""
        total = table[self.start[0] + codes[:, 0]]
        for m in range(1, len(self.books)):
            total = total + table[self.start[m] + codes[:, m]]
        return total / np.sqrt(np.maximum(norms, 1e-12))[:, None]
