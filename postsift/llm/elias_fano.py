"""Elias-Fano sequences and a two-level n-gram trie over one byte buffer, which may be memory-mapped."""

from __future__ import annotations

import numpy as np

_U = np.uint64
HEADER = 4  # numbers of 64 bits in front of a sequence: length, low bits, low bytes, high bytes


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if not width or not len(values):
        return np.empty(0, np.uint8)
    shifts = np.arange(width, dtype=_U)
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of eight values ends on a whole byte
        bits = (values[at : at + (1 << 16), None] >> shifts) & _U(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(out)


def _unpack(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Values of `width` bits at the given indices."""
    if not width:
        return np.zeros(len(at), _U)
    bit = at.astype(np.int64) * width
    byte, shift = bit >> 3, (bit & 7).astype(_U)
    out = np.zeros(len(at), _U)
    with np.errstate(over="ignore"):
        for i in range((width + 14) // 8):
            move = 8 * i - shift.astype(np.int64)
            part = data[np.minimum(byte + i, len(data) - 1)].astype(_U)
            up = np.where(move >= 0, part << np.clip(move, 0, 63).astype(_U), part >> np.clip(-move, 0, 63).astype(_U))
            out |= np.where(move < 64, up, _U(0))
    return out & _U((1 << width) - 1)


class EliasFano:
    """A non-decreasing sequence of numbers below 2^63: low bits as they are, high bits in unary."""

    def __init__(self, buffer: np.ndarray):
        n, width, low, high = buffer[: 8 * HEADER].view(np.uint64)
        self.n, self.width = int(n), int(width)
        at = 8 * HEADER
        self.low = buffer[at : at + int(low)]
        self.high = buffer[at + int(low) : at + int(low) + int(high)]
        self.size = at + int(low) + int(high)
        self._ones: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(values & _U((1 << width) - 1), width)
        ones = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) if n else 0) + 2, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        pad = -(len(low) + len(high)) % 8  # the next sequence starts on a whole number
        head = np.array([n, width, len(low), len(high) + pad], np.uint64).tobytes()
        return head + low.tobytes() + high.tobytes() + b"\0" * pad

    def _places(self) -> np.ndarray:
        if self._ones is None:
            self._ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return self._ones

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        high = (self._places()[at] - at).astype(_U)
        return (high << _U(self.width)) | _unpack(self.low, self.width, at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number that is not smaller, for each value (n: none)."""
        values = values.astype(_U)
        high = (values >> _U(self.width)).astype(np.int64)
        rank = self._places() - np.arange(self.n)  # high parts, non-decreasing
        lo, hi = np.searchsorted(rank, high, "left"), np.searchsorted(rank, high, "right")
        while True:  # halve the runs of one high part by their low bits
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.get(mid) < values[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)


class BigramTrie:
    """Contexts, pointers to their followers, and followers with one quantised probability each.

    Level 1 holds the contexts, level 2 the followers: within a context ascending, and made monotone
    over contexts by the context's rank. The difference of two pointers is the number of followers.
    """

    def __init__(self, buffer: np.ndarray):
        self.contexts = EliasFano(buffer)
        at = self.contexts.size
        self.pointers = EliasFano(buffer[at:])
        at += self.pointers.size
        self.followers = EliasFano(buffer[at:])
        at += self.followers.size
        self.codes = buffer[at : at + self.followers.n]

    @staticmethod
    def build(contexts: np.ndarray, sizes: np.ndarray, followers: np.ndarray, codes: np.ndarray, follower_bits: int) -> bytes:
        """From sorted contexts (below 2^63), followers per context, sorted followers and their codes."""
        rank = np.repeat(np.arange(len(contexts), dtype=_U), sizes)
        pointers = np.concatenate(([0], np.cumsum(sizes)))
        return (
            EliasFano.encode(contexts) + EliasFano.encode(pointers)
            + EliasFano.encode((rank << _U(follower_bits)) | followers.astype(_U)) + codes.astype(np.uint8).tobytes()
        )

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each context (-1: absent) and its number of followers."""
        at = self.contexts.successor(contexts)
        inside = np.minimum(at, max(self.contexts.n - 1, 0))
        hit = (at < self.contexts.n)
        if self.contexts.n:
            hit &= self.contexts.get(inside) == contexts.astype(_U)
        size = np.zeros(len(at), np.int64)
        if hit.any():
            size[hit] = (self.pointers.get(at[hit] + 1) - self.pointers.get(at[hit])).astype(np.int64)
        return np.where(hit, at, -1), size

    def lookup(self, rank: np.ndarray, followers: np.ndarray, follower_bits: int) -> np.ndarray:
        """Code of each follower of a context rank; 0 where the trie has no such pair."""
        out = np.zeros(len(rank), np.uint8)
        known = np.flatnonzero(rank >= 0)
        if not len(known) or not self.followers.n:
            return out
        wanted = (rank[known].astype(_U) << _U(follower_bits)) | followers[known].astype(_U)
        at = self.followers.successor(wanted)
        inside = np.minimum(at, self.followers.n - 1)
        hit = (at < self.followers.n) & (self.followers.get(inside) == wanted)
        out[known[hit]] = self.codes[inside[hit]]
        return out
