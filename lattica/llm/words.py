"""Words and word shingles of a batch of texts, as numpy arrays without a Python object for each word.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text. A shingle is five
words in a row; a text of one to four words has one shingle, of all its words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
_U = np.uint64
_BASE, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> _U(32))) * _U(_ODD)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    doc: np.ndarray  # index of its text in the batch
    first: np.ndarray  # of each text: its first word
    count: np.ndarray  # of each text: its words


def words_of(texts: pa.Array) -> Words:
    """The words of all texts, in order; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    inside = _IS_WORD[data]
    before, after = np.empty(n + 1, bool), np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    before[offsets] = False
    after[:n], after[n] = inside, False
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(_BASE, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(_BASE_INVERSE, n)[starts] + (ends - starts).astype(_U))
    edges = np.searchsorted(starts, offsets)
    count = np.diff(edges)
    return Words(hashes, np.repeat(np.arange(len(count)), count), edges[:-1], count)


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, 128 bits of its words in order, as two arrays of signed longs; 0, 0 without words."""
    place = np.arange(len(w.hashes)) - np.repeat(w.first, w.count)
    out = []
    for base, salt in ((_BASE, 0x632BE59BD9B4E019), (_ODD, 0x8CB92BA72F3D8DD7)):
        total = np.zeros(len(w.hashes) + 1, _U)
        np.cumsum(mix(w.hashes ^ _U(salt)) * powers(base, int(w.count.max(initial=0)))[place], out=total[1:])
        out.append(mix(total[w.first + w.count] - total[w.first] + w.count.astype(_U)).view(np.int64) * (w.count > 0))
    return out[0], out[1]


class Shingles(NamedTuple):
    hashes: np.ndarray  # distinct in each text, ascending
    times: np.ndarray  # how often
    edges: np.ndarray  # text i has edges[i] : edges[i + 1]


def shingles_of(w: Words) -> Shingles:
    n, docs = len(w.hashes), len(w.count)
    total = np.zeros(n, _U)
    room = np.repeat(w.first + w.count, w.count) - np.arange(n)  # words from here to the text's end
    for j in range(min(SIZE, n)):
        part = mix(w.hashes[j:] + _U(j * 2 + 1)) * powers(_ODD, SIZE)[j]
        total[: n - j] += np.where(room[: n - j] > j, part, _U(0))
    keep = room >= SIZE
    short = np.flatnonzero((w.count > 0) & (w.count < SIZE))
    keep[w.first[short]] = True
    h, doc = mix(total[keep]), w.doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return Shingles(h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(docs + 1)))
