"""A counting quotient filter: fingerprints as quotient and remainder, remainders sorted in runs, exact counts."""

from __future__ import annotations

import struct

import numpy as np


class CountingQuotientFilter:
    """Holds `values` (sorted, distinct, of `bits` bits) and `counts`.

    Stored form: the quotient is the upper q bits (q grows with the number of fingerprints), the remainder the rest.
    A bit for each quotient says whether it occurs, a bit for each slot whether its run ends there, then come the
    remainders in as few whole bytes as they need, then slot and count of each fingerprint that occurs more than once.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray, bits: int):
        self.values, self.counts, self.bits = values, counts, bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(values, counts.astype(np.int64), bits)

    def to_bytes(self) -> bytes:
        n = len(self.values)
        q = min(self.bits, max(0, int(n - 1).bit_length())) if n else 0
        r = self.bits - q
        quotient = (self.values >> np.uint64(r)) if r < 64 else np.zeros(n, np.uint64)
        remainder = self.values & np.uint64((1 << r) - 1)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True)[:n]
        width = (r + 7) // 8
        packed = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        more = np.flatnonzero(self.counts > 1)
        head = struct.pack("<BBIQ", self.bits, q, len(more), n)
        return b"".join((head, np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), packed.tobytes(), more.astype("<u4").tobytes(), self.counts[more].astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, n_more, n = struct.unpack_from("<BBIQ", raw)
        at = struct.calcsize("<BBIQ")

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        r = bits - q
        width = (r + 7) // 8
        occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
        run_end = np.unpackbits(take((n + 7) // 8), count=n).astype(np.int64)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(n * width).reshape(n, width)
        run = np.cumsum(run_end) - run_end  # which run each slot is in
        values = wide.view("<u8").reshape(n).astype(np.uint64)
        if r < 64:
            values = values | (occupied[run].astype(np.uint64) << np.uint64(r))
        counts = np.ones(n, np.int64)
        slot = take(4 * n_more).view("<u4")
        counts[slot] = take(8 * n_more).view("<i8")
        return cls(values, counts, bits)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sorted fingerprints merge by a stable sort of sorted runs; counts of equal ones add up. Nothing is lost."""
        values = np.concatenate([f.values for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
        return cls(values[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)
