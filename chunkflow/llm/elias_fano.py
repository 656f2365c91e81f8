"""Elias-Fano sequences over memory-mapped arrays: access, successor search and predecessors for many arguments at a time."""

from __future__ import annotations

import numpy as np

#: Every so many set (or clear) bits the directory names the word of the next one.
HINT = 64
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: A word's bytes, bits and the like all at once: every byte 0x01, 0x80, and masks of every second bit, pair and nibble.
_BYTES, _HIGH, _M1, _M2, _M4 = (np.uint64(x * 0x0101010101010101) for x in (0x01, 0x80, 0x55, 0x33, 0x0F))
#: By rank * 256 + byte: the place of the byte's set bit of that rank.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits, one after another, and 8 bytes more, so that 8 can be read from any place."""
    out = np.zeros(-(-(len(values) * width) // 8) + 8, np.uint8)
    for i in range(0, len(values), 1 << 16):  # a multiple of 8 values: whole bytes
        part = values[i : i + (1 << 16), None].astype(np.uint64) >> np.arange(width, dtype=np.uint64) & _ONE
        packed = np.packbits(part.astype(np.uint8), bitorder="little")
        out[i * width // 8 : i * width // 8 + len(packed)] = packed
    return out


class Packed:
    """Random access to pack_bits(); width at most 56."""

    def __init__(self, raw: np.ndarray, width: int):
        self.width, self.mask = width, np.uint64((1 << width) - 1)
        self.eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        out = self.eight[at >> 3]
        at &= 7
        out >>= at.view(np.uint64)
        out &= self.mask
        return out.view(np.int64)


def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of values below the universe (at most 2**63): low bits packed, high in unary."""
    n = len(values)
    low = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
    v = values.astype(np.uint64)
    high = (v >> np.uint64(low)).astype(np.int64)
    size = -(-(n + (universe >> low) + 1) // 64) * 64
    bits = np.zeros(size, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    hints = {}
    for side, found in (("zeros", np.arange(len(ones)) * 64 - ones), ("hints", ones)):
        hints[f"{name}.{side}"] = (np.searchsorted(found, np.arange(0, found[-1] + 1, HINT), "right") - 1).astype(np.uint32)
    small = np.uint32 if size < 2**32 else np.int64
    return {f"{name}.head": np.array([n, low, universe], np.uint64), f"{name}.bits": words, f"{name}.ones": ones.astype(small), f"{name}.lows": pack_bits(v & np.uint64((1 << low) - 1), low), **hints}


def _in_word(w: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of each word's set bit of that rank (from 0, less than its set bits)."""
    x = w - (w >> _ONE & _M1)
    x = (x & _M2) + (x >> np.uint64(2) & _M2)
    upto = (x + (x >> np.uint64(4)) & _M4) * _BYTES  # set bits up to each byte's end
    at = np.bitwise_count((rank * _BYTES | _HIGH) - upto & _HIGH).astype(np.uint64) << np.uint64(3)  # of the byte that holds the bit
    rank = rank - ((upto << np.uint64(8)) >> at & np.uint64(255))
    return at.view(np.int64) + _IN_BYTE[(rank << np.uint64(8) | w >> at & np.uint64(255)).view(np.int64)]


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low, self.universe = (int(x) for x in arrays[f"{name}.head"])
        self.bits, self.ones = arrays[f"{name}.bits"], arrays[f"{name}.ones"]
        self.hints = (arrays[f"{name}.zeros"], arrays[f"{name}.hints"])
        self.lows = Packed(arrays[f"{name}.lows"], self.low)

    def _before(self, word: np.ndarray, bit: int) -> np.ndarray:
        """Set (or clear) bits before each word."""
        ones = self.ones[word].astype(np.int64)
        return ones if bit else word * 64 - ones

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) such bit."""
        word = self.hints[bit][k // HINT].astype(np.int64)
        todo, steps = np.arange(len(k)), 0
        while len(todo):
            todo = todo[self._before(word[todo] + 1, bit) <= k[todo]]
            word[todo] += 1
            steps += 1
            if steps == 16 and len(todo):  # a long run of the other bit: bisect the words
                lo, hi = word[todo], np.full(len(todo), len(self.bits) - 1)
                while (lo < hi).any():
                    middle = (lo + hi) >> 1
                    more = self._before(middle + 1, bit) <= k[todo]
                    lo, hi = np.where(more, middle + 1, lo), np.where(more, hi, middle)
                word[todo] = lo
                break
        return word * 64 + _in_word(self.bits[word] if bit else self.bits[word] ^ _ALL, (k - self._before(word, bit)).view(np.uint64))

    def _next(self, position: np.ndarray, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th such bit, which is the next one behind the position."""
        word, at = position >> 6, (position & 63).astype(np.uint64)
        w = self.bits[word] if bit else self.bits[word] ^ _ALL
        w = w >> at >> _ONE
        out = position + 1 + np.bitwise_count((w & (~w + _ONE)) - _ONE).astype(np.int64)
        far = np.flatnonzero(w == 0)
        out[far] = self._select(k[far], bit)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i) << self.low) | self.lows[i]

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1."""
        at = self._select(i, 1)
        after = self._next(at, 1, i + 1)
        return ((at - i) << self.low) | self.lows[i], ((after - i - 1) << self.low) | self.lows[i + 1]

    def _bisect(self, values: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number of elements below each value (or not above it), and the end of its bucket; 0 <= values < universe."""
        high, low = values >> self.low, values & ((1 << self.low) - 1)
        start = np.full(len(values), -1, np.int64)
        later = np.flatnonzero(high > 0)
        start[later] = self._select(high[later] - 1, 0)
        first = start + 1 - high
        last = np.empty(len(values), np.int64)
        last[later] = self._next(start[later], 0, high[later]) - high[later]
        zero = np.flatnonzero(high == 0)
        if len(zero):
            last[zero] = self._select(np.zeros(1, np.int64), 0)[0]
        end, todo = last.copy(), np.flatnonzero(first < last)
        while len(todo):
            middle = (first[todo] + last[todo]) >> 1
            found = self.lows[middle]
            less = found <= low[todo] if right else found < low[todo]
            first[todo[less]] = middle[less] + 1
            last[todo[~less]] = middle[~less]
            todo = todo[first[todo] < last[todo]]
        return first, end

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each value, -1 where there is none."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        ok = np.flatnonzero((values >= 0) & (values < self.universe))
        first, end = self._bisect(values[ok], False)
        some = np.flatnonzero(first < end)
        ok, first = ok[some], first[some]
        same = self.lows[first] == values[ok] & ((1 << self.low) - 1)
        out[ok[same]] = first[same]
        return out

    def rank(self, values: np.ndarray) -> np.ndarray:
        """Number of elements that are not above each value (0 <= value < universe)."""
        return self._bisect(values, True)[0]
