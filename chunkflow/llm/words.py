"""Words of whole texts as 64-bit hashes, many texts at a time.

A word is a run of bytes other than space and 0x09-0x0D after A-Z have been lower-cased. UTF-8 never uses those bytes
inside a longer character, so working on bytes and on characters gives the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: By k: the first k bytes of a little-endian number of 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed 8 at a time; a longer word is hashed whole by the library.
LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of texts; null is empty; lone surrogates (not valid in UTF-8) become '?'."""
    return [t.encode("utf-8", "replace") if t else b"" for t in texts]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes."""
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = _IS_WORD[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(w[1:] != w[:-1])
    return edge[::2], edge[1::2]


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and len(raws)+1 offsets that say which words are whose."""
    data = b"\n".join(raws)
    starts, ends = word_spans(data)
    at = np.cumsum([0] + [len(r) + 1 for r in raws])
    return hash_spans(data.translate(_LOWER), starts, ends), np.searchsorted(starts, at)


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the bytes, 8 bytes at a time."""
    data += bytes(8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the 8 bytes from each place on
    left = ends - starts
    h = left.astype(np.uint64) * _STEP
    h ^= eight[starts] & _FIRST[np.minimum(left, 8)]
    more, k = np.flatnonzero((left > 8) & (left <= LONG)), 8
    while len(more):
        part = h[more] * _M1
        part ^= part >> np.uint64(32)
        h[more] = part ^ (eight[starts[more] + k] & _FIRST[np.minimum(left[more] - k, 8)])
        k += 8
        more = more[left[more] > k]
    for i in np.flatnonzero(left > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mix(h)


class Table:
    """Rows of 64-bit keys, by linear probing; key 0 is not allowed."""

    def __init__(self, places: int):
        self.keys, self.rows, self.n = np.zeros(places, np.uint64), np.zeros(places, np.int32), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for each key begins."""
        return ((mix(keys) >> np.uint64(32)) * np.uint64(len(self.keys)) >> np.uint64(32)).view(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is new."""
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            found = self.keys[at]
            same = found == keys
            hit, on = np.flatnonzero(same), np.flatnonzero(~same & (found != 0))
            out[todo[hit]] = self.rows[at[hit]]
            todo, keys, at = todo[on], keys[on], (at[on] + 1) % len(self.keys)
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Different keys that are new."""
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]  # of several for one place one stays
            done = free & (self.keys[at] == keys[todo])
            self.rows[at[done]] = rows[todo[done]]
            todo, at = todo[~done], (at[~done] + 1) % len(self.keys)
        self.n += len(keys)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of `width` words; a shorter text is one shingle, an empty one none."""
    k = np.uint64(0xA24BAED4963EE407)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * k + hashes[i : i + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * k + x
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches(texts, limit: int = 500_000):
    """(first, last) row ranges whose texts together have about `limit` characters; a longer text is alone."""
    return ranges([len(t) if t is not None else 0 for t in texts], limit)


def ranges(sizes, limit: int):
    """(first, last) ranges of about `limit` in sum; a larger size is alone."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
