"""Arithmetic in GF(2^8) and a Cauchy erasure code on numpy."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x11D  # fixed value


def _product_table() -> np.ndarray:
    """a * b for all bytes by shift and add."""
    a = np.arange(256, dtype=np.int32)[:, None]
    b = np.arange(256, dtype=np.int32)[None, :]
    out = np.zeros((256, 256), np.int32)
    for bit in range(8):
        out ^= np.where(b >> bit & 1, a, 0)
        a = a << 1
        a = np.where(a & 0x100, a ^ POLYNOMIAL, a)
    return out.astype(np.uint8)


TIMES = _product_table()
INVERSE = np.array([0, *(int(np.flatnonzero(TIMES[a] == 1)[0]) for a in range(1, 256))], dtype=np.uint8)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product."""
    return np.bitwise_xor.reduce(TIMES[a[:, :, None], b[None, :, :]], axis=1)


def invert(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan; ValueError if singular."""
    n = len(m)
    work = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        rows = np.flatnonzero(work[c:, c])
        if not len(rows):
            raise ValueError("singular matrix")
        work[[c, c + rows[0]]] = work[[c + rows[0], c]]
        work[c] = TIMES[INVERSE[work[c, c]], work[c]]
        for r in range(n):
            if r != c and work[r, c]:
                work[r] ^= TIMES[work[r, c], work[c]]
    return work[:, n:]


def cauchy(rows: int, cols: int) -> np.ndarray:
    """1 / (x + y) with x from 0 and y from rows on."""
    return INVERSE[np.arange(rows)[:, None] ^ (rows + np.arange(cols))[None, :]]


class Code:
    """k data and m parity shards; any k of them give the payload back."""

    def __init__(self, k: int = 10, m: int = 4):
        if k < 1 or m < 1 or k + m > 256:
            raise ValueError("k and m must be positive and at most 256 together")
        self.k, self.m, self.parity = k, m, cauchy(m, k)
        self.inverses: dict[tuple[int, ...], np.ndarray] = {}

    def encode(self, payload: bytes, length: int | None = None) -> list[bytes]:
        if not payload:
            raise ValueError("empty payload")
        length = -(-len(payload) // self.k) if length is None else length
        if length < 1 or length * self.k < len(payload):
            raise ValueError("shards too short")
        data = np.zeros(self.k * length, np.uint8)
        data[: len(payload)] = np.frombuffer(payload, np.uint8)
        data = data.reshape(self.k, length)
        parity = np.stack([self._sum(row, data) for row in self.parity])
        return [x.tobytes() for x in (*data, *parity)]

    @staticmethod
    def _sum(coefficients: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.zeros(data.shape[1], np.uint8)
        for c, row in zip(coefficients, data, strict=True):
            out ^= TIMES[c][row]
        return out

    def decode(self, shards: list[tuple[int, bytes]], length: int) -> bytes:
        index = [i for i, _ in shards]
        if len(set(index)) != len(index):
            raise ValueError("duplicate shard")
        if any(not 0 <= i < self.k + self.m for i in index):
            raise ValueError("no such shard")
        if len(index) < self.k:
            raise ValueError("too few shards")
        if len({len(x) for _, x in shards}) != 1:
            raise ValueError("shards of different length")
        chosen = sorted(shards)[: self.k]
        data = np.stack([np.frombuffer(x, np.uint8) for _, x in chosen])
        if length > data.size:
            raise ValueError("payload longer than its shards")
        have = {i: row for (i, _), row in zip(chosen, data, strict=True)}
        lost = [i for i in range(self.k) if i not in have]  # shards of data that are there need no solving
        solve = self.solved(tuple(have))
        rows = {i: self._sum(solve[i], data) for i in lost}
        return b"".join([(have[i] if i in have else rows[i]).tobytes() for i in range(self.k)])[:length]

    def solved(self, index: tuple[int, ...]) -> np.ndarray:
        """The inverse for the shards of index, which are k; kept, as the same ones tend to be lost together."""
        found = self.inverses.get(index)
        if found is None:
            full = np.concatenate([np.eye(self.k, dtype=np.uint8), self.parity])
            found = invert(full[list(index)])
            if len(self.inverses) < 4096:
                self.inverses[index] = found
        return found
