"""The hashing trick over lists of tokens: every distinct token of a batch is hashed once, all at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def token_bytes(token) -> bytes:
    """Bytes of a token; characters that UTF-8 refuses (lone surrogates of JSON escapes) are kept."""
    return token if isinstance(token, bytes) else str(token).encode("utf-8", "surrogatepass")


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_many(tokens: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86 32-bit of each byte string, as signed integers.

    Strings lie in the rows of one matrix of little-endian words; a word is mixed into all rows that are long enough
    at once."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    words = int(sizes.max(initial=0)) // 4 + 1
    padded = np.frombuffer(b"".join(t.ljust(4 * words, b"\0") for t in tokens), "<u4").reshape(len(tokens), words)
    h = np.full(len(tokens), seed, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(words):
            k = _rotate(padded[:, i] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            whole, part = sizes >= 4 * (i + 1), (sizes > 4 * i) & (sizes < 4 * (i + 1))
            h = np.where(whole, _rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(part, h ^ k, h))
        h ^= sizes.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def hash_bucket(token, width: int) -> tuple[int, int]:
    """(bucket, sign) that a token counts in."""
    h = int(murmur3_many([token_bytes(token)])[0])
    return abs(h) % width, 1 if h >= 0 else -1


class HashedBlocks:
    """Token lists of many rows and blocks, to be hashed together and summed into a matrix."""

    def __init__(self):
        self.number: dict = {}
        self.parts: list[tuple[int, int, int, bool, list[int], list[float] | None]] = []

    def add(self, row: int, at: int, width: int, tokens: Iterable, weights: list[float] | None = None, signed: bool = True) -> None:
        """Tokens of a row for the columns from `at`."""
        ids = [self.number.setdefault(t, len(self.number)) for t in tokens]
        if ids:
            self.parts.append((row, at, width, signed, ids, weights))

    def pour(self, out: np.ndarray) -> None:
        """Add the sums to out, in double precision before its own."""
        if not self.parts:
            return
        h = murmur3_many([token_bytes(t) for t in self.number]).astype(np.int64)
        sizes = [len(p[4]) for p in self.parts]
        spread = lambda i, kind=np.int64: np.repeat(np.array([p[i] for p in self.parts], kind), sizes)
        own = h[np.fromiter((i for p in self.parts for i in p[4]), np.int64, sum(sizes))]
        weight = np.fromiter((w for p in self.parts for w in (p[5] if p[5] is not None else [1.0] * len(p[4]))), np.float64, sum(sizes))
        weight = np.where(spread(3, bool) & (own < 0), -weight, weight)
        flat = spread(0) * out.shape[1] + spread(1) + np.abs(own) % spread(2)
        cells, own = np.unique(flat, return_inverse=True)  # few of the matrix's
        out.ravel()[cells] += np.bincount(own, weight).astype(out.dtype)


def hash_matrix(token_lists: list[list], width: int, signed: bool = True) -> np.ndarray:
    """A row of bucket sums for each list."""
    out, blocks = np.zeros((len(token_lists), width)), HashedBlocks()
    for row, tokens in enumerate(token_lists):
        blocks.add(row, 0, width, tokens, signed=signed)
    blocks.pour(out)
    return out


def hash_rows(samples: list[list], width: int, pairs: bool = False, signed: bool = True) -> np.ndarray:
    """The same for lists of strings or (string, value) pairs."""
    out, blocks = np.zeros((len(samples), width)), HashedBlocks()
    for row, sample in enumerate(samples):
        blocks.add(row, 0, width, [s[0] for s in sample] if pairs else sample, [float(s[1]) for s in sample] if pairs else None, signed)
    blocks.pour(out)
    return out
