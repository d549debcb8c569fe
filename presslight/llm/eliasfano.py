"""Elias-Fano sequences and an n-gram trie built of them, as numpy arrays over one mapped buffer."""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts as a bit vector in unary, with a directory of its zeros.

    Access and search are vectorised; ranges narrow a search to a part of the sequence.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.ascontiguousarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        parts = (v >> np.uint64(bits)).astype(np.int64)
        size = n + (int(parts[-1]) if n else 0) + 1
        ones = np.zeros(-(-size // 64) * 64, bool)
        ones[parts + np.arange(n)] = True
        high = np.packbits(ones, bitorder="little").view(np.uint64)
        # Where each high part begins: the number of values below it, at every part.
        zeros = np.searchsorted(parts, np.arange((int(parts[-1]) if n else 0) + 2)).astype(np.uint32)
        low = np.zeros(-(-n * bits // 64) + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift, rest = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), v & ((_ONE << np.uint64(bits)) - _ONE)
            np.bitwise_or.at(low, word, rest << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        two = self.low[word] >> shift
        two |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return two & ((_ONE << np.uint64(self.low_bits)) - _ONE)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        part = np.searchsorted(self.zeros, i, side="right").astype(np.int64) - 1
        return (part.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each x the first place in [first, last) whose value is x or more, or last."""
        part = (x >> np.uint64(self.low_bits)).astype(np.int64)
        known = part < len(self.zeros) - 1
        part = np.minimum(part, len(self.zeros) - 2)
        lo = np.where(known, self.zeros[part].astype(np.int64), self.n)
        hi = np.where(known, self.zeros[part + 1].astype(np.int64), self.n)
        lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        want = x & ((_ONE << np.uint64(self.low_bits)) - _ONE)
        while (live := np.flatnonzero(lo < hi)).size:  # a binary search among equal high parts
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        return lo


class Trie:
    """Contexts -> successors, in levels: context ids, pointers and successors as Elias-Fano sequences, a code for each successor.

    Successors ascend within a context only; each context's stand on the last value of the one before,
    which makes the level monotone, and a search is relative to that.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<i8", 16)
        self.contexts, self.pointers, self.successors = (self._open(buffer, head[1 + 5 * k : 6 + 5 * k]) for k in range(3))
        self.codes = np.frombuffer(buffer, "<u2", self.successors.n, int(head[0]))

    @staticmethod
    def _open(buffer, head) -> EliasFano:
        n, bits, low, high, at = (int(x) for x in head)
        parts = (int(np.frombuffer(buffer, "<i8", 1, at)[0]), at + 8)
        return EliasFano(n, bits, np.frombuffer(buffer, "<u8", low, parts[1]), np.frombuffer(buffer, "<u8", high, parts[1] + 8 * low), np.frombuffer(buffer, "<u4", parts[0], parts[1] + 8 * (low + high)))

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> Trie:
        """From distinct pairs in ascending order, into anonymous mapped memory."""
        context, successor = context.astype(np.uint64), successor.astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(context)) if len(starts) else starts
        lasts = successor[ends - 1] if len(starts) else np.zeros(0, np.uint64)
        base = np.concatenate([[0], np.cumsum(lasts)]).astype(np.uint64)[: len(starts)] if len(starts) else np.zeros(0, np.uint64)
        relative = successor + np.repeat(base, ends - starts)
        levels = [EliasFano.of(context[starts]), EliasFano.of(np.append(starts, len(context))), EliasFano.of(relative)]
        blobs, head, at = [], [0], 128
        for e in levels:
            blob = np.array([len(e.zeros)], "<i8").tobytes() + e.low.tobytes() + e.high.tobytes() + e.zeros.astype("<u4").tobytes()
            blob += bytes(-len(blob) % 8)
            head += [e.n, e.low_bits, len(e.low), len(e.high), at]
            blobs.append(blob)
            at += len(blob)
        head[0] = at
        data = np.array(head, "<i8").tobytes() + b"".join(blobs) + codes.astype("<u2").tobytes()
        mapped = mmap.mmap(-1, max(1, len(data)))
        mapped[: len(data)] = data
        return cls(mapped)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The place of each pair, or -1."""
        context, successor = context.astype(np.uint64), successor.astype(np.uint64)
        n = self.contexts.n
        if not n or not len(context):
            return np.full(len(context), -1, np.int64)
        whole = np.zeros(len(context), np.int64)
        c = self.contexts.successor(context, whole, whole + n)
        known = c < n
        c = np.minimum(c, n - 1)
        known &= self.contexts.access(c) == context
        first, last = (self.pointers.access(c + k).astype(np.int64) for k in (0, 1))
        # What the context stands on: the value before its first.
        base = np.where(first > 0, self.successors.access(np.maximum(first - 1, 0)), np.uint64(0))
        at = self.successors.successor(successor + base, first, last)
        known &= at < last
        at = np.minimum(at, self.successors.n - 1)
        known &= self.successors.access(at) == successor + base
        return np.where(known, at, -1)
