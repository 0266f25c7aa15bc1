"""Compressed presence bitmaps over unsigned ordinals, after the published two-level container design.

Ordinals are split into chunks of 2**16.  A chunk is kept as a sorted array of positions while it is
sparse, as runs while it is made of few intervals, and as a plain bitmap otherwise, whichever is smallest.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16


def _runs(bits: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], bits.astype(np.int8), [0]))))
    return edges.reshape(-1, 2).astype(np.uint32)


class PresenceBitmap:
    def __init__(self, chunks: dict[int, tuple[str, np.ndarray]]):
        self.chunks = chunks

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "PresenceBitmap":
        ordinals = np.unique(np.asarray(ordinals, dtype=np.int64))
        out: dict[int, tuple[str, np.ndarray]] = {}
        for c in np.unique(ordinals // CHUNK):
            bits = np.zeros(CHUNK, dtype=bool)
            bits[ordinals[ordinals // CHUNK == c] % CHUNK] = True
            out[int(c)] = cls._pack(bits)
        return cls(out)

    @staticmethod
    def _pack(bits: np.ndarray) -> tuple[str, np.ndarray]:
        n, runs = int(bits.sum()), _runs(bits)
        sizes = {"array": 2 * n, "runs": 8 * len(runs), "bits": CHUNK // 8}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == "array":
            return kind, np.flatnonzero(bits).astype(np.uint16)
        return (kind, runs) if kind == "runs" else (kind, np.packbits(bits))

    @staticmethod
    def _open(kind: str, data: np.ndarray) -> np.ndarray:
        if kind == "bits":
            return np.unpackbits(data).astype(bool)
        bits = np.zeros(CHUNK + 1, dtype=np.int32)
        if kind == "array":
            bits[data] = 1
            return bits[:CHUNK].astype(bool)
        np.add.at(bits, data[:, 0], 1)
        np.add.at(bits, data[:, 1], -1)
        return np.cumsum(bits)[:CHUNK].astype(bool)

    def _combine(self, other: "PresenceBitmap", op, chunks) -> "PresenceBitmap":
        none = ("array", np.array([], dtype=np.uint16))
        out = {}
        for c in chunks:
            bits = op(self._open(*self.chunks.get(c, none)), self._open(*other.chunks.get(c, none)))
            if bits.any():
                out[c] = self._pack(bits)
        return PresenceBitmap(out)

    def and_not(self, other: "PresenceBitmap") -> "PresenceBitmap":
        return self._combine(other, lambda a, b: a & ~b, self.chunks)

    def intersect(self, other: "PresenceBitmap") -> "PresenceBitmap":
        return self._combine(other, lambda a, b: a & b, self.chunks.keys() & other.chunks.keys())

    def union(self, other: "PresenceBitmap") -> "PresenceBitmap":
        return self._combine(other, lambda a, b: a | b, self.chunks.keys() | other.chunks.keys())

    def ordinals(self) -> np.ndarray:
        parts = [c * CHUNK + np.flatnonzero(self._open(*self.chunks[c])) for c in sorted(self.chunks)]
        return np.concatenate(parts).astype(np.int64) if parts else np.array([], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.ordinals())
