"""Words and 64-bit word hashes of many texts at once, straight from Arrow's UTF-8 buffers.

The separator classes of the operators are ASCII only, so a byte table decides, and a byte >= 0x80 is always part of a
word. A batch of texts is one byte array; words never run over a text's end. Nothing here depends on the batch cut.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: `[\x20\x09-\x0D]`
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: `[\x00-\x2F\x3A-\x60\x7B-\x7F]`, after lower-casing
NOT_ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NOT_ALNUM[_lo:_hi + 1] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words up to this many bytes are hashed in 8-byte steps for all words at once, longer ones one by one.
_LONG = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words(NamedTuple):
    """Words of a batch of texts: text number, first byte, end byte, hash; all in text order."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray      # all bytes, lower-cased if asked for
    offsets: np.ndarray   # of the texts in data


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of Arrow strings; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; eight bytes of all words at a time."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))      # unaligned loads
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        live = np.arange(len(start))
        at, left, step = start, size, 0
        while len(live):
            x = eight[at]
            x &= _MASK[np.minimum(left, 8)]
            if step == 0:
                h ^= x
                h = mix(h)
            else:
                h[live] = mix((h[live] + np.uint64(step)) ^ x)
            step += 1
            more = (left > 8) & (size[live] <= _LONG)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG):
            digest = hashlib.blake2b(data[start[i]: end[i]].tobytes(), digest_size=8).digest()
            h[i] = np.frombuffer(digest, "<u8")[0]
    return h


def ordered(h: np.ndarray) -> np.ndarray:
    """Places of hashes by their high bits, equal ones in their own order: the place goes along, so that plain numbers are sorted. Hashes
    that differ in the low bits only (as many as places need) may be mixed up, so who compares neighbours compares whole hashes."""
    low = (np.uint64(1) << np.uint64(max(len(h) - 1, 1).bit_length())) - np.uint64(1)
    order = h & ~low
    order |= np.arange(len(h), dtype=np.uint64)
    order.sort()
    order &= low
    return order.view(np.int64)


def words(texts, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    outside = separators[data]
    first, last = ~outside, ~outside
    first[1:] &= outside[:-1]
    last[:-1] &= outside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):                               # a word neither begins before nor ends after its text
        first[cuts] = ~outside[cuts]
        last[cuts - 1] = ~outside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(text, start, end, _hashes(data, start, end), data, offsets)


def counts_per_text(w: Words) -> np.ndarray:
    return np.bincount(w.text, minlength=len(w.offsets) - 1).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte (length + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all runs of k words that stay inside a text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
            h += w.hash[j: n + j]
        h = mix(h)
    first = np.flatnonzero(w.text[:n] == w.text[k - 1:])
    return first, h[first]


class Lines(NamedTuple):
    """Lines of a batch of texts, split at newline; an empty text has one empty line."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    breaks = np.flatnonzero(data == 0x0A)
    of = np.searchsorted(offsets, breaks, side="right") - 1
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a break at the very end of a text makes an empty line that begins where the next text begins
    text = np.sort(np.concatenate([np.arange(len(offsets) - 1), of]), kind="stable")
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[last] = offsets[1:][text[last]]
    return Lines(text, start, end)


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the white space at both ends; an all-white span gets start == end."""
    solid = np.flatnonzero(~SPACE[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = i < j
    a, b = start.copy(), start.copy()
    a[some], b[some] = solid[i[some]], solid[j[some] - 1] + 1
    return a, b


def sums_per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeats(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that puts equal hashes of one text together, earlier ones first; True where an entry equals the one before)."""
    with np.errstate(over="ignore"):
        key = mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    return order, same
