"""Language-model score of texts by logistic mixing of hashed-context bit predictors.

A text is its lower-cased bytes (A-Z only) and an end symbol. Huffman codes of the training bytes, one for each common byte before within
the word, turn symbols into binary decisions. A text belongs to one of a few sorts, by the bytes it has, and naming the sort is part of its cost.

Contexts predict a decision from the counts of their hashed slots, and predictions meet in the logistic domain in two layers. The
first has the contexts within a word and the sort: the last two to four bytes and all bytes since the last white space; a
gate chooses its weights by how well two of them are known. What it says of a word and the white space after it is the same wherever
they stand, so each is worked out once for several batches, in training with its number of occurrences. Words that begin alike share
the symbols of that beginning: a symbol after equal contexts is a step that is worked out once for all words of a slice.

The second layer has the contexts that reach over white space, for every decision of every text: the last bytes, whatever they
are, and the word before with all bytes since the last white space. They meet the first layer's prediction with weights that
a gate chooses by how well the two are known. Every text has a set of these weights for each gate of its own, from those that training found on:
after each block of decisions they move against the errors that the block was coded with. Besides, there are a few variants of every set,
from bold to cautious, and the trust in them follows, block by block, what they would have cost so far. The sum of the costs
is the text's length in bits.

All training texts are counted, and all fit the sorts and both layers' weights: centres are means over them, and every slice of words, or of
text, moves the weights of its task by a Newton step whose sums are added up over the tasks, with logits of the texts of the other fold, so
that the weights see the tables as a new text does. Each task counts into tables, and ranges of slots are added up in
parallel. The first layer's tables have TOTAL two-byte entries, the second's a number that follows the root of the training bytes; they, two
folds' and all, are all that is broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.llm import store, unigram
from bagframe.llm.words import LOWER, SPACE, _hashes, buffers, mix, ordered, sums_per_text

#: log2 of the slots of each predictor: orders 2 to 4, all since the last white space
ORDERS = (2, 3, 4)
#: Sorts of texts, by their bytes; naming the sort costs log2(SORTS) bits a text.
SORTS = 8
SLOTS = (18, 20, 21, 22)
K = len(SLOTS)
_STARTS = np.concatenate([[0], np.cumsum([1 << b for b in SLOTS])])
TOTAL = int(_STARTS[-1])
_SCALE = 16.0              # steps of a stored logit per unit
_FINE = 1024.0             # and of one that the first layer gives
_DELTA = 0.4
#: Gate: how often the longest context was seen, in 8 steps, and the order-4 context, in 4.
GATES = 32
_STEP = np.array([0, 1, 1, 2, 2, 3, 3, 3])
#: Variants of the weights: factors of boldness, the first the weights themselves, and the trust in them before a text begins.
FACTORS = np.array([1.0, 0.8, 1.2, 0.5], np.float32)
TRUST = np.array([0.7, 0.1, 0.1, 0.1])
#: Second layer: bytes of its first context, which may reach over white space; the other is the word before and all since the last white space.
REACH = 5
L = 3                      # its inputs: the first layer and the two
FIRST = np.array([1.0, 0.0, 0.0])       # its weights before anything is learned
BLOCK, GROWTH = 8, 256     # words between two changes of a text's weights and trust; in a long text a part of those before
LARGEST = 1 << 12          # words of a block at most
RATE = 0.005               # step of the weights for a decision; a longer block moves them as far as one of BLOCK words
SHARE, SPAN = 0.05, 32     # part of the trust that returns to TRUST with so many words
LANES = 256                # texts that are scored side by side
_RUN = 1 << 12             # words whose decisions are worked out at a time
_PART = 1 << 16
_SLICE = 4096              # distinct words of a step of the weights; their decisions stay in cache
_NEAR = 8192               # distinct words that begin alike worked on at a time, where their order does not matter
END = 256
_NEWEST = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(8)], np.uint64)   # the newest k of eight bytes
_MIXED = mix(np.arange(1, 257, dtype=np.uint64))
FOLDS = 2                  # parts of the training texts, by content: the weights see a text with the counts of the other part
RIDGE, START = 1e-3, 0.3   # pull of the weights, per decision, and where to
ROUNDS = 2                 # passes that move the sorts' centres
PIECE = 8 << 20         # bytes of text worked on at a time: the larger, the fewer distinct units
GATHERED = 4 << 20      # bytes of distinct units that training gathers, from pieces of SMALL bytes of text, before it works them out
SMALL = 2 << 20


@dataclass
class Code:
    """Prefix codes of the 256 bytes and the end symbol, as decisions (inner node, bit) from the root, by the byte before in the word."""

    count: np.ndarray      # decisions of each symbol, a code after the other
    begin: np.ndarray      # first of them in the flat arrays
    salt: np.ndarray       # hash of the node
    bit: np.ndarray
    row: np.ndarray        # first symbol of the code behind each byte, and where the word begins

    @classmethod
    def huffman(cls, counts: np.ndarray) -> Code:
        """From the counts of the symbols, or of the symbols behind each byte and where a word begins: bytes behind which there is less than a
        part in a thousand share a code of all symbols."""
        own, of = counts.reshape(-1, 257).sum(1), [counts.reshape(-1, 257).sum(0)]
        row = np.zeros(257, np.int32)
        for before in np.flatnonzero(own * 1000 > own.sum()) if counts.ndim > 1 else ():
            row[before] = 257 * len(of)
            of.append(counts[before])
        flat, count = [], []
        for tree, one in enumerate(of):
            heap = [(int(c) + 1, s, s) for s, c in enumerate(one)]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            number = len(one)
            while len(heap) > 1:
                (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
                parent[x], parent[y] = (number, 0), (number, 1)
                heapq.heappush(heap, (a + b, number, number))
                number += 1
            for s in range(len(one)):
                path, x = [], s
                while x in parent:
                    path.append((512 * tree + parent[x][0] - len(one) + 1, parent[x][1]))
                    x = parent[x][0]
                count.append(len(path))
                flat += path[::-1]
        count = np.array(count)
        return cls(count, np.cumsum(count) - count, (np.array([n for n, _ in flat], np.uint32) * np.uint32(0x9E3779B1)), np.array([b for _, b in flat], np.int8), row)


@dataclass
class Units:
    """Words with the white space character or the end of text after them: of which text, which distinct one, and these."""

    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray      # of each distinct one
    size: np.ndarray       # bytes
    ends: np.ndarray       # whether the end symbol follows
    sort: np.ndarray       # of the text
    data: np.ndarray       # lower-cased, 8 bytes of padding in front and behind
    offsets: np.ndarray
    hash: np.ndarray | None = None      # of each distinct one, with its sort and end
    begin: np.ndarray | None = None     # of each, in text order
    back: np.ndarray | None = None      # bytes of the text before each
    before: np.ndarray | None = None    # hash of the word before each, if there is one

    def alone(self) -> Units:
        """The distinct ones without the texts."""
        first = np.cumsum(self.size) - self.size
        data = np.zeros(int(self.size.sum()) + 16, np.uint8)
        for a in range(0, len(first), 1 << 16):
            some = slice(a, a + (1 << 16))
            at = np.repeat(self.start[some] - first[some], self.size[some])
            at += np.arange(first[a], first[a] + len(at))
            data[first[a] + 8: first[a] + 8 + len(at)] = self.data[at]
        none = np.zeros(0, np.int64)
        return Units(none, none, (first + 8).astype(np.int32), self.size.astype(np.int32), self.ends, self.sort, data, none, self.hash)


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text has each of the 256 bytes."""
    n, a = len(offsets) - 1, 0
    counts = np.empty((n, 256), np.uint32)
    while a < n:                                                   # about a megabyte at a time
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1)
        text = np.repeat(np.arange(b - a, dtype=np.int64) * 256, np.diff(offsets[a: b + 1]))
        text += data[offsets[a]: offsets[b]]
        counts[a: b] = np.bincount(text, minlength=256 * (b - a)).reshape(b - a, 256)
        a = b
    return counts


def _shares(counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the 256 bytes in each text."""
    return _shares(byte_counts(data, offsets))


def cluster(x: np.ndarray, k: int, rounds: int = 25, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """k centres of the rows of x, which stand for `often` texts each, and the texts of each centre: farthest points first, then means."""
    often = np.ones(len(x)) if often is None else often
    chosen = [0]
    for _ in range(1, min(k, len(x))):
        chosen.append(int(np.argmin(np.max(x @ x[chosen].T, 1))))
    centres = x[chosen]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T - 0.5 * (centres ** 2).sum(1), 1)
        size = np.bincount(of, weights=often, minlength=len(centres))
        moved = np.stack([often[of == c] @ x[of == c] / size[c] if size[c] else centres[c] for c in range(len(centres))]).astype(np.float32)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres, size


def units(texts, centres: np.ndarray) -> Units:
    data, offsets = buffers(texts)
    data = LOWER[data]
    n = len(offsets) - 1
    sort = np.zeros(n, np.uint64)
    if n and len(centres) > 1:
        sort = np.argmax(profiles(data, offsets) @ centres.T - 0.5 * (centres ** 2).sum(1), 1).astype(np.uint64)
    stops = np.flatnonzero(SPACE[data]) + 1                       # a unit ends behind every white space, and with its text
    per = np.diff(np.searchsorted(stops, offsets, side="right")) + 1
    last = np.zeros(len(stops) + n, bool)
    last[np.cumsum(per) - 1] = True
    end = np.empty(len(last), np.int64)
    end[last], end[~last] = offsets[1:], stops
    start = np.zeros_like(end)
    start[1:] = end[:-1]                                          # texts lie one behind the other
    h = _hashes(data, start, end - ~last)                         # of the word
    full = np.where(end - ~last > start, np.arange(len(end)), -1)
    back = np.append(-1, np.maximum.accumulate(full))[:-1]        # the last word before, if it is of the same text
    before = mix(np.where(back >= np.repeat(np.cumsum(per) - per, per), h[back], np.uint64(0)) + np.uint64(1))
    h[last] ^= np.uint64(0xE7D0E7D0E7D0E7D1)
    h[~last] += data[end[~last] - 1].astype(np.uint64) + np.uint64(1)
    h = mix(h)
    h ^= np.repeat(mix(sort + np.uint64(1)), per)
    at, kind = grouped(h)
    text = np.repeat(np.arange(n), per)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8: len(data) + 8] = data
    return Units(text, kind, start[at] + 8, end[at] - start[at], last[at], sort[text[at]], padded, offsets, h[at],
                 (start + 8).astype(np.int32), start - np.repeat(offsets[:-1], per), before)


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each group, group of each entry) of equal hashes, by their high bits; whole hashes decide who is equal."""
    order = ordered(h)
    h = h.take(order)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def alike(u: Units, only: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct units, or those in `only`, those of a sort that begin alike together, _NEAR at a time."""
    only = np.arange(len(u.start)) if only is None else only
    start, size, sort = u.start[only], u.size[only], u.sort[only]
    eight = np.ndarray((len(u.data) - 7,), "<u8", buffer=u.data, strides=(1,))
    begin = eight[start].byteswap()
    missing = np.minimum(8 * np.maximum(8 - size, 0), 63).astype(np.uint64)
    begin = np.where(size > 0, begin >> missing << missing, np.uint64(0))
    order = only[np.argsort(begin >> np.uint64(4) | sort << np.uint64(60))]
    for a in range(0, len(order), _NEAR):
        yield order[a: a + _NEAR]


@dataclass
class Steps:
    """Distinct steps (a symbol after equal contexts) of some units: their decisions and where the units have them."""

    bounds: np.ndarray     # first decision of each step, and the number of decisions
    of: np.ndarray         # step of each symbol of the units
    first: np.ndarray      # first symbol of each unit

    def times(self, often: np.ndarray) -> np.ndarray:
        """Occurrences of each decision from those of each unit."""
        size = np.diff(self.first, append=len(self.of))
        return np.repeat(np.bincount(self.of, weights=np.repeat(often, size), minlength=len(self.bounds) - 1), np.diff(self.bounds))

    def sums(self, cost: np.ndarray) -> np.ndarray:
        """Sum over each unit of the costs of its decisions."""
        return np.add.reduceat(np.add.reduceat(cost, self.bounds[:-1], dtype=np.float64).take(self.of), self.first)


def _since(byte: np.ndarray, inside: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of all bytes of its word that stand before each symbol, and of their number."""
    with np.errstate(over="ignore"):
        term = _MIXED.take(byte)
        term *= np.cumprod(np.full(int(count.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)).take(inside)
        since = np.cumsum(term)
        since -= term
        since -= np.repeat(since[first], count)
        since += inside.astype(np.uint64)
    return since


def decisions(u: Units, some: slice | np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, Steps]:
    """(slots of each predictor [K, n], bit, steps) of some distinct units."""
    start, size, ends, sort = u.start[some], u.size[some].astype(np.int32), u.ends[some], u.sort[some] + np.uint64(1)
    count = size + ends
    total = int(count.sum())
    first = np.cumsum(count, dtype=np.int32) - count
    inside = np.arange(total, dtype=np.int32) - np.repeat(first, count)
    at = np.repeat(start, count) + inside
    byte = u.data.take(at)
    symbol = byte.astype(np.int16)
    symbol[first[ends] + size[ends]] = END
    since = _since(byte, inside, first, count)
    eight = np.ndarray((len(u.data) - 7,), "<u8", buffer=u.data, strides=(1,))
    past = eight[at - 8]                                           # the newest byte is the highest
    short = np.flatnonzero(inside < 8)
    past[short] &= _NEWEST[inside[short]]                          # nothing before the unit
    # the bytes since the white space, sort and symbol are all that a step depends on
    with np.errstate(over="ignore"):
        key = np.repeat(sort << np.uint64(9), count)
        key |= symbol.view(np.uint16)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key += since
    one, of = grouped(mix(key))
    past, inside, symbol, since = past.take(one), inside.take(one), symbol.take(one), since.take(one)
    known = np.minimum(inside, 8).astype(np.uint64)
    symbol = symbol + code.row.take(np.where(inside > 0, (past >> np.uint64(56)).astype(np.int16), np.int16(256)))
    decided = code.count[symbol]
    where = np.cumsum(decided, dtype=np.int32) - decided
    m = int(decided.sum())
    flat = np.repeat((code.begin[symbol] - where).astype(np.int32), decided)
    flat += np.arange(m, dtype=np.int32)
    salt = code.salt.take(flat)
    slots = np.empty((K, m), np.int32)
    eight8 = np.uint64(8)
    own = np.repeat(sort, count)[one]
    with np.errstate(over="ignore"):
        own *= np.uint64(0xD6E8FEB86659FD93)
        for k, bits in enumerate(SLOTS):
            if k < len(ORDERS):
                reach = np.minimum(known, np.uint64(ORDERS[k]))
                context = np.where(reach > 0, past >> ((eight8 - reach) * eight8 & np.uint64(63)), np.uint64(0))
                context += reach << np.uint64(57)
            else:
                context = since
            context += own
            c = ((context + np.uint64(k + 1)) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(32)).astype(np.uint32)
            h = np.repeat(c, decided)
            h ^= salt
            h *= np.uint32(0x85EBCA6B)
            h >>= np.uint32(32 - bits)
            h += np.uint32(_STARTS[k])
            slots[k] = h.view(np.int32)
    return slots, code.bit.take(flat), Steps(np.append(where, m), of, first)


@dataclass
class Known:
    """Distinct units spelled out: the numbers of the symbols and the decisions of each, and where it has them."""

    symbols: np.ndarray
    symbol: np.ndarray     # first of each
    taken: np.ndarray      # decisions
    decision: np.ndarray   # first of each
    since: np.ndarray      # of every symbol: hash of the unit's bytes before it
    decided: np.ndarray    # decisions of every symbol
    cells: np.ndarray      # [n, 2] of every decision: twice the part of its slot that its node gives, and the bit; the first layer's logit
                           # for what was decided, in steps of 1 / _FINE


def _spelled(u: Units, some: np.ndarray, code: Code, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbols, taken, since, decided, node) of distinct units."""
    size, ends = u.size[some].astype(np.int32), u.ends[some]
    count = size + ends
    first = np.cumsum(count, dtype=np.int32) - count
    inside = np.arange(int(count.sum()), dtype=np.int32) - np.repeat(first, count)
    byte = u.data.take(np.repeat(u.start[some], count) + inside)
    symbol = byte.astype(np.int16)
    symbol[first[ends] + size[ends]] = END
    before = np.zeros_like(symbol)
    before[1:] = byte[:-1]
    before[first] = 256
    symbol = symbol + code.row.take(before)
    since = _since(byte, inside, first, count)
    decided = code.count[symbol].astype(np.int32)
    return count, np.add.reduceat(decided, first), since, decided.astype(np.uint8), node.take(_flat(code.begin[symbol].astype(np.int32), decided))


def places(u: Units, some: np.ndarray, known: Known, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots [n, 2] that the contexts over white space, hashed to `bits` bits, give to every symbol, decisions of every symbol) of the units
    numbered `some`, in text order."""
    kind = u.kind[some]
    count = known.symbols[kind]
    flat = _flat(known.symbol[kind], count)
    eight = np.ndarray((len(u.data) - 7,), "<u8", buffer=u.data, strides=(1,))
    past = eight[_flat(u.begin[some] - 8, count)]                                         # the newest byte is the highest
    past &= _NEWEST[REACH]
    past += np.uint64(REACH)
    back = u.back[some]
    few = np.flatnonzero(back < REACH)
    if len(few):                                                                           # less than that of the text is before them
        first = np.cumsum(count, dtype=np.int32) - count
        at = _flat(first[few], count[few])
        reach = np.minimum(np.repeat(back[few] - first[few], count[few]) + at, REACH)
        past[at] = (past[at] & _NEWEST[reach]) + reach.astype(np.uint64)
    with np.errstate(over="ignore"):
        since = known.since.take(flat)
        since += np.repeat(u.before[some], count)
        past *= np.uint64(0x9FB21C651E98DF25)
    slots = np.empty((len(flat), 2), np.int32)
    slots[:, 0] = past >> np.uint64(64 - bits)
    slots[:, 1] = since >> np.uint64(64 - bits)
    slots[:, 1] += np.int32(1 << bits)
    return slots, known.decided.take(flat)


def _repeated(pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The rows of an array [n, 2] of int32, so often each."""
    return np.repeat(pairs.view(np.int64)[:, 0], times).view(np.int32).reshape(-1, 2)


def _taken(pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return pairs.view(np.int64)[:, 0].take(at).view(np.int32).reshape(-1, 2)


def _salts(code: Code, bits: int) -> np.ndarray:
    """Of every decision of the code: the part of its slot that its node gives. Four levels of the code below a node lie within 16 slots,
    so that a symbol's decisions are read together."""
    out, top, below = np.empty(len(code.bit), np.int32), np.zeros(len(code.count), np.int32), np.ones(len(code.count), np.int32)
    for j in range(int(code.count.max())):
        live = np.flatnonzero(code.count > j)
        at = code.begin[live] + j
        if j % 4 == 0:
            top[live] = (code.salt[at] * np.uint32(0x85EBCA6B) >> np.uint32(36 - bits) << np.uint32(4)).astype(np.int32)
            below[live] = 1
        out[at] = top[live] | below[live]
        below[live] = 2 * below[live] + code.bit[at]
    return out


def _flat(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, so many."""
    ends = np.cumsum(count, dtype=np.int32)
    out = np.repeat(start - (ends - count), count)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """_PART counts: a bit for each that is not 0, then those, in a byte each, and in four bytes again if the byte is full."""
    some = counts[counts > 0]
    return np.packbits(counts > 0).tobytes() + np.minimum(some, 255).astype(np.uint8).tobytes() + some[some >= 255].astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.unpackbits(np.frombuffer(data, np.uint8, _PART // 8)).astype(np.int64)
    at = np.flatnonzero(out)
    small = np.frombuffer(data, np.uint8, len(at), _PART // 8)
    out[at] = small
    full = at[small == 255]
    out[full] = np.frombuffer(data, "<u4", len(full), _PART // 8 + len(at))
    return out


def _training(rows: DataFrame) -> DataFrame:
    """(text, fold) of all training rows. Equal texts share a fold, and the rows of a fold come together."""
    texts = rows.where("train").select(F.coalesce("text", F.lit("")).alias("text"))
    fold = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS)).cast("int")
    parts = [texts.where(fold == f).withColumn("fold", F.lit(f)) for f in range(FOLDS)]
    return reduce(DataFrame.unionAll, parts)


def _of_folds(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    for piece in store.pieces(batches, most=most or SMALL):
        folds = piece.column("fold").to_numpy()
        for f in np.unique(folds):
            yield int(f), piece.column("text").filter(pa.array(folds == f))


def _joined(found: list[tuple[Units, np.ndarray]]) -> tuple[Units, np.ndarray]:
    """The distinct units of several pieces as those of one, their occurrences added up."""
    size, ends, sort, h, data = (np.concatenate([getattr(u, c) for u, _ in found]) for c in ("size", "ends", "sort", "hash", "data"))
    shift = np.cumsum([0, *[len(u.data) for u, _ in found[:-1]]])
    start = np.concatenate([u.start + s for (u, _), s in zip(found, shift)])
    at, kind = grouped(h)
    times = np.bincount(kind, weights=np.concatenate([t for _, t in found]), minlength=len(at)).astype(np.uint32)
    none = np.zeros(0, np.int64)
    return Units(none, none, start[at], size[at], ends[at], sort[at], data, none, h[at]).alone(), times


def _gathered(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[int, Units, np.ndarray]]:
    """(fold, distinct units of several pieces, their occurrences)."""
    own, found, size = -1, [], 0
    for fold, texts in _of_folds(batches):
        if fold != own and found:
            yield own, *_joined(found)
            found, size = [], 0
        own = fold
        u = units(texts, centres)
        found.append((u.alone(), np.bincount(u.kind, minlength=len(u.start)).astype(np.uint32)))
        size += int(u.size.sum())
        del u
        if size > 2 * GATHERED:
            found = [_joined(found)]
            size = int(found[0][0].size.sum())
            if size > GATHERED:
                yield own, *found.pop()
                size = 0
    if found:
        yield own, *_joined(found)


def _byte_table(rows: DataFrame) -> DataFrame:
    """The bytes' counts of every training text, and in rows of their own (pair, number) how often a symbol stands behind a byte of its word, 257
    to a byte, the beginning of a word and the end of a text last."""
    texts = rows.where("train").select(F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(257 * 257, np.int64)
        for piece in store.pieces(batches, most=PIECE):
            data, offsets = buffers(piece.column("text"))
            data = LOWER[data]
            counts = byte_counts(data, offsets)
            ends, none = np.arange(len(counts) + 1, dtype=np.int32) * 1024, pa.nulls(len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(counts)]), none, none], ["counts", "pair", "number"])
            before = np.append(256, np.where(SPACE[data], np.int32(256), data))          # what the next symbol stands behind
            last = np.where(np.diff(offsets) > 0, before[offsets[1:]], 256)
            before[offsets] = 256
            pairs += np.bincount(before[:-1] * 257 + data, minlength=257 * 257)
            pairs += np.bincount(last * 257 + END, minlength=257 * 257)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(pairs[some])], ["counts", "pair", "number"])

    return store.written(texts.mapInArrow(count, "counts binary, pair long, number long"), "mixing-bytes")


def _pairs(table: DataFrame) -> np.ndarray:
    """Counts [257, 257] of the symbols behind each byte and where a word begins."""
    out = np.zeros(257 * 257, np.int64)
    for row in table.where("pair is not null").groupBy("pair").agg(F.sum("number").alias("number")).collect():
        out[row["pair"]] = row["number"]
    return out.reshape(257, 257)


def _centres(rows: DataFrame, table: DataFrame | None = None) -> np.ndarray:
    """Centres of the sorts, from all training texts: every task's own centres with their numbers of texts are grouped, then the centres
    found move to the means of their texts. The texts are read once, into a table of their bytes' counts."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, often = np.zeros((0, 256), np.float32), np.zeros(0)
        for x in _profiled(batches):
            found, often = np.concatenate([found, x]), np.concatenate([often, np.ones(len(x))])
            found, often = cluster(found, SORTS, often=often)
        if len(found):
            yield pa.RecordBatch.from_pydict({"centre": pa.array([c.astype("<f4").tobytes() for c in found], pa.binary()), "often": pa.array(often)})

    counts = (_byte_table(rows) if table is None else table).where("counts is not null").select("counts")
    made = counts.mapInArrow(first, "centre binary, often double").collect()          # SORTS rows a task
    if not made:
        return np.zeros((1, 256), np.float32)
    made = sorted((bytes(r["centre"]), r["often"]) for r in made)
    centres, _ = cluster(np.stack([np.frombuffer(c, "<f4") for c, _ in made]), SORTS, often=np.array([n for _, n in made]))
    for _ in range(ROUNDS):
        centres = _moved(counts, centres)
    return centres


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4000):
            yield _shares(np.frombuffer(b"".join(batch.column("counts").slice(a, 4000).to_pylist()), np.uint32).reshape(-1, 256))


def _moved(counts: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of the texts nearest to each centre; a centre without any stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), 257))
        for x in _profiled(batches):
            of = np.argmax(x @ centres.T - 0.5 * (centres ** 2).sum(1), 1)
            for c in range(len(centres)):
                total[c, :256] += x[of == c].sum(0, dtype=np.float64)
                total[c, 256] += (of == c).sum()
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    total = sum(np.frombuffer(r["sums"]).reshape(len(centres), 257) for r in counts.mapInArrow(sums, "sums binary").collect())
    return np.where(total[:, 256:] > 0, total[:, :256] / np.maximum(total[:, 256:], 1), centres).astype(np.float32)


def _stored(n: np.ndarray) -> bytes:
    logit = np.log((n[1::2] + _DELTA) / (n[0::2] + _DELTA))
    seen = np.minimum(np.log2(n[1::2] + n[0::2] + 1).astype(np.int16), 7)
    return ((np.rint(np.clip(logit, -15, 15) * _SCALE).astype(np.int16) << 3) | seen).tobytes()


def _train_tables(training: DataFrame, code: Code, centres: np.ndarray) -> np.ndarray:
    """Logits of all slots [1 + FOLDS, TOTAL], from the counts of all training texts, then of all but each fold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = np.zeros(2 * TOTAL, np.uint32), -1

        for fold, u, times in _gathered(batches, centres):
            if fold != own and own >= 0:
                yield from _counted(counts, own)
                counts[:] = 0
            own = fold
            for some in alike(u):
                slots, bit, steps = decisions(u, some, code)
                weight = steps.times(times[some]).astype(np.uint32)
                for k in range(K):
                    np.add.at(counts, 2 * slots[k].astype(np.int64) + bit, weight)
        yield from _counted(counts, own)

    return _summed(training.mapInArrow(scan, "part int, fold int, count binary"), TOTAL, "mixing-tables")


def _counted(counts: np.ndarray, fold: int) -> Iterator[pa.RecordBatch]:
    for part in range(0, -(-len(counts) // _PART)):
        some = counts[part * _PART: (part + 1) * _PART]
        if some.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "fold": pa.array([fold], pa.int32()), "count": pa.array([_packed(some)], pa.binary())})


def _summed(counted: DataFrame, total: int, name: str) -> np.ndarray:
    """Logits of all slots [1 + FOLDS, total], from all counts, then from those of all folds but each."""

    def add(found: pa.Table) -> pa.Table:
        n = np.zeros((FOLDS, _PART), np.int64)
        for fold, packed in zip(found.column("fold").to_pylist(), found.column("count").to_pylist()):
            n[fold] += _unpacked(packed)
        total = n.sum(0)
        return pa.table({"part": found.column("part").slice(0, 1), "logits": pa.array([_stored(total) + b"".join(_stored(total - n[f]) for f in range(FOLDS))], pa.binary())})

    made = store.written(counted.groupBy("part").applyInArrow(add, "part int, logits binary"), name, files=16)
    tables = np.zeros((1 + FOLDS, total), np.int16)
    for row in made.toLocalIterator():                          # total entries each
        a = row["part"] * (_PART // 2)
        tables[:, a: a + _PART // 2] = np.frombuffer(row["logits"], np.int16).reshape(1 + FOLDS, -1)
    return tables


def _bits(learned: int) -> int:
    """Bits of the slots of each context over white space: their number follows the root of the training bytes."""
    return max(16, 8 + int(np.log2(max(learned, 1)) / 2))


def _across_tables(training: DataFrame, code: Code, bits: int, learned: int) -> np.ndarray:
    """Logits of the slots of the contexts over white space [1 + FOLDS, 2 << bits], from every decision of all training texts. A task
    counts several times as many bytes as the tables have slots, so that tables are few."""
    tasks = 1 + learned // (FOLDS * (8 << bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own, seen = np.zeros(4 << bits, np.uint32), -1, Seen()
        ones = np.ones(1 << 16, np.uint32)
        for fold, texts in _of_folds(batches, PIECE // 2):
            if fold != own and own >= 0:
                yield from _counted(counts, own)
                counts[:] = 0
            own = fold
            u = units(texts, np.zeros((1, 256), np.float32))
            known = seen.known(u, code, bits)
            for a in range(0, len(u.kind), _RUN):
                some = np.arange(a, min(a + _RUN, len(u.kind)))
                slots, decided = places(u, some, known, bits)
                kind = u.kind[some]
                node = _taken(known.cells, _flat(known.decision[kind], known.taken[kind]))[:, 0].astype(np.int64)
                slots = _repeated(slots, decided)
                if len(node) > len(ones):
                    ones = np.ones(len(node), np.uint32)
                for k in range(2):
                    slot = 2 * slots[:, k].astype(np.int64)
                    slot ^= node
                    np.add.at(counts, slot, ones[: len(slot)])
        yield from _counted(counts, own)

    counted = reduce(DataFrame.unionAll, [training.where(F.col("fold") == f).coalesce(tasks).mapInArrow(scan, "part int, fold int, count binary") for f in range(FOLDS)])
    return _summed(counted, 2 << bits, "mixing-across")


def solved(bend: np.ndarray, aim: np.ndarray, start: float | np.ndarray = START) -> np.ndarray:
    """Weights [GATES, inputs] at the least cost by Newton's sums; gates that were never seen stay at `start`."""
    return np.linalg.solve(bend + np.eye(bend.shape[1]), (aim + start)[:, :, None])[:, :, 0]


def stepped(x: np.ndarray, gate: np.ndarray, often: np.ndarray | None, weights: np.ndarray, start: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bend, aim) of a Newton step from the weights on the cost of decisions with the inputs x [inputs, n]: per gate, bend @ w = aim at its end."""
    inputs, gate = len(x), gate.astype(np.uint8)
    order = np.argsort(gate, kind="stable")
    x = [own.take(order) for own in x]
    often = np.ones(len(gate), np.float32) if often is None else often.take(order)
    cuts = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
    bend, aim = np.zeros((GATES, inputs, inputs)), np.zeros((GATES, inputs))
    for g in np.flatnonzero(np.diff(cuts)):
        own, weight = [one[cuts[g]: cuts[g + 1]] for one in x], often[cuts[g]: cuts[g + 1]]
        w = weights[g].astype(np.float32)
        z = own[0] * w[0]
        for k in range(1, inputs):
            z += own[k] * w[k]
        p = np.exp(np.clip(z, -30, 30, out=z), out=z)
        p += 1
        np.divide(1, p, out=p)
        miss = weight * p
        curve = miss * (1 - p)
        pull = RIDGE * float(weight.sum(dtype=np.float64))
        for j in range(inputs):
            bent = curve * own[j]
            for k in range(j, inputs):
                bend[g, j, k] = bend[g, k, j] = np.dot(bent, own[k])
            aim[g, j] = np.dot(miss, own[j])
        bend[g] += pull * np.eye(inputs)
        aim[g] += bend[g] @ weights[g] - pull * (weights[g] - start)
    return bend, aim


def _weights(training: DataFrame, code: Code, centres: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Weights from all training texts, each by the logits of the other folds."""
    shared = training.sparkSession.sparkContext.broadcast(tables[1:])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bend, aim = np.zeros((GATES, K, K)), np.zeros((GATES, K))
        weights = None
        for fold, u, times in _gathered(batches, centres):
            model = Model(code, shared.value[fold], np.zeros((GATES, K)), centres)
            weights = model.learn(u, times, bend, aim, weights)
        yield pa.RecordBatch.from_pydict({"bend": pa.array([bend.tobytes()], pa.binary()), "aim": pa.array([aim.tobytes()], pa.binary())})

    made = training.mapInArrow(scan, "bend binary, aim binary").collect()              # 5 KB a task
    shared.unpersist()
    bend = sum((np.frombuffer(r["bend"]).reshape(GATES, K, K) for r in made), np.zeros((GATES, K, K)))
    return solved(bend, sum((np.frombuffer(r["aim"]).reshape(GATES, K) for r in made), np.zeros((GATES, K)))).astype(np.float32)


def _across_weights(training: DataFrame, model: Model, tables: np.ndarray, across: np.ndarray, bits: int) -> np.ndarray:
    """Weights of the second layer from every decision of all training texts, each by the logits of the other folds; as for the first
    layer, a run of text after the other from the weights that those before it gave."""
    shared = training.sparkSession.sparkContext.broadcast((tables[1:], across[1:]))
    code, weights, centres = model.code, model.weights, model.centres

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bend, aim, at = np.zeros((GATES, L, L)), np.zeros((GATES, L)), -1
        reached = None
        for fold, texts in _of_folds(batches, PIECE // 2):
            if fold != at:
                first, second = shared.value
                at, own, seen = fold, Model(code, first[fold], weights, centres, Across(bits, second[fold])), Seen()
            u = units(texts, centres)
            known = seen.known(u, code, bits, own)
            for a in range(0, len(u.kind), _RUN):
                x, gate, _ = own.inputs(u, np.arange(a, min(a + _RUN, len(u.kind))), known)
                if reached is None:
                    reached = np.tile(FIRST, (GATES, 1))
                    for _ in range(6):
                        reached = reached + np.clip(solved(*stepped(x, gate, None, reached, FIRST), FIRST) - reached, -0.5, 0.5)
                more, further = stepped(x, gate, None, reached, FIRST)
                bend += more
                aim += further
                reached = reached + np.clip(solved(bend, aim, FIRST) - reached, -0.5, 0.5)
        yield pa.RecordBatch.from_pydict({"bend": pa.array([bend.tobytes()], pa.binary()), "aim": pa.array([aim.tobytes()], pa.binary())})

    made = training.mapInArrow(scan, "bend binary, aim binary").collect()              # 3 KB a task
    shared.unpersist()
    bend = sum((np.frombuffer(r["bend"]).reshape(GATES, L, L) for r in made), np.zeros((GATES, L, L)))
    return solved(bend, sum((np.frombuffer(r["aim"]).reshape(GATES, L) for r in made), np.zeros((GATES, L))), FIRST).astype(np.float32)


def _nothing() -> np.ndarray:
    return np.zeros(2 << 16, np.int16)


@dataclass
class Across:
    """Second layer: bits of its slots, their logits, and its weights per gate before a text begins."""

    bits: int = 16
    table: np.ndarray = field(default_factory=_nothing)
    weights: np.ndarray = field(default_factory=lambda: np.tile(FIRST, (GATES, 1)).astype(np.float32))


@dataclass
class Model:
    code: Code
    table: np.ndarray
    weights: np.ndarray        # gate, predictor
    centres: np.ndarray        # of the sorts of texts
    across: Across = field(default_factory=Across)

    def _signed(self, u: Units, some: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray, Steps]:
        """(logits for the decision that was taken [n, K], gate, steps)."""
        slots, bit, steps = decisions(u, some, self.code)
        x = np.empty((slots.shape[1], K), np.float32)
        sign = (bit.astype(np.float32) * 2 - 1) * np.float32(1 / _SCALE)
        seen = []
        for k in range(K):
            entry = self.table.take(slots[k])
            if k >= K - 2:
                seen.append(entry & 7)
            np.multiply(entry >> 3, sign, out=x[:, k])
        return x, _STEP[seen[0]] * 8 + seen[1], steps

    def newton(self, u: Units, some: slice | np.ndarray, times: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bend, aim) of a Newton step from the weights on the cost of some distinct units' decisions: per gate, bend @ w = aim at its end."""
        x, gate, steps = self._signed(u, some)
        return stepped(x.T, gate, steps.times(times[some]).astype(np.float32), weights, START)

    def learn(self, u: Units, times: np.ndarray, bend: np.ndarray, aim: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        """Adds the units to the sums, a slice of distinct words after the other, each from the weights that those before it gave; a task's first
        slice is tried a few times before it counts. Returns the weights reached."""
        for a in range(0, len(u.start), _SLICE):
            some = slice(a, a + _SLICE)
            if weights is None:
                weights = np.full((GATES, K), START)
                for _ in range(6):
                    weights = weights + np.clip(solved(*self.newton(u, some, times, weights)) - weights, -0.5, 0.5)
            more, further = self.newton(u, some, times, weights)
            bend += more
            aim += further
            weights = weights + np.clip(solved(bend, aim) - weights, -0.5, 0.5)
        return weights

    def mixed(self, u: Units, some: slice | np.ndarray) -> tuple[np.ndarray, Steps]:
        """(logits of the first layer for the decision that was taken, steps)."""
        x, gate, steps = self._signed(u, some)
        return np.einsum("nk,nk->n", x, self.weights.take(gate, axis=0)), steps

    def costs(self, u: Units, only: np.ndarray | None = None) -> np.ndarray:
        """Cost in nats of every distinct unit, or of those in `only`, by the first layer alone, under every variant of the weights."""
        out = np.empty((len(u.start), len(FACTORS)))
        for some in alike(u, only):
            z, steps = self.mixed(u, some)
            for v, factor in enumerate(FACTORS):
                y = z * factor
                out[some, v] = steps.sums(np.log1p(np.exp(-np.abs(y))) + np.maximum(-y, 0))
        return out

    def inputs(self, u: Units, some: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs of the second layer [L, n] for the decisions taken, gate, decisions of each unit) of the units numbered `some`, in text order."""
        slots, decided = places(u, some, known, self.across.bits)
        kind = u.kind[some]
        taken = known.taken[kind]
        flat = _flat(known.decision[kind], taken)
        cells, slots = _taken(known.cells, flat), _repeated(slots, decided)
        node = cells[:, 0]
        sign = (node & 1).astype(np.float32)
        sign *= np.float32(2 / _SCALE)
        sign -= np.float32(1 / _SCALE)
        node = node >> 1
        x = np.empty((L, len(flat)), np.float32)
        x[0] = cells[:, 1]
        x[0] *= np.float32(1 / _FINE)
        seen = []
        for k in range(2):
            slot = slots[:, k] ^ node
            entry = self.across.table.take(slot)
            seen.append((entry & 7).astype(np.uint8))
            entry >>= 3
            np.multiply(entry, sign, out=x[1 + k])
        return x, (_STEP.astype(np.uint8) * 8).take(seen[0]) + seen[1], taken

    def bits(self, texts, seen: Seen | None = None) -> np.ndarray:
        """Length of each text in bits, the naming of its sort included. Of words that `seen` has from other texts the first layer is not
        worked out again."""
        if not len(texts):
            return np.zeros(0)
        u = units(texts, self.centres)
        known = (Seen() if seen is None else seen).known(u, self.code, self.across.bits, self)
        n = len(u.offsets) - 1
        per = np.bincount(u.text, minlength=n)                   # a text has one unit or more
        begin, total = np.cumsum(per) - per, np.zeros(n)
        order = np.argsort(-per, kind="stable")                   # texts of like size side by side
        for a in range(0, n, LANES):
            own = order[a: a + LANES]
            total[own] = self._lanes(u, begin[own], per[own], known)
        return total / np.log(2) + np.log2(SORTS)

    def _lanes(self, u: Units, begin: np.ndarray, per: np.ndarray, known: Known) -> np.ndarray:
        """Length in nats of texts side by side, those with most units first: a block of units after the other, each with the weights per
        gate and the trust in variants that the text's blocks before it left."""
        n, done = len(per), 0
        weights = np.repeat(self.across.weights.T.astype(np.float64)[:, None, :], n, axis=1).reshape(L, n * GATES)
        trust, total = np.tile(TRUST, (n, 1)), np.zeros(n)
        while done < per[0]:
            step = min(max(BLOCK, done // GROWTH), LARGEST)
            live = int(np.count_nonzero(per > done))
            size = np.minimum(per[:live] - done, step)
            ends = np.cumsum(size)
            x, gate, taken = self.inputs(u, _flat((begin[:live] + done).astype(np.int32), size.astype(np.int32)), known)
            first = np.append(0, np.cumsum(taken)[ends[:-1] - 1])                        # first decision of each text
            which = np.repeat(np.arange(0, live * GATES, GATES), np.diff(first, append=len(gate)))
            which += gate
            now = weights[:, : live * GATES].astype(np.float32)
            z = now[0].take(which)
            z *= x[0]
            for k in range(1, L):
                part = now[k].take(which)
                part *= x[k]
                z += part
            cost = np.empty((live, len(FACTORS)))
            far, least = np.abs(z), np.add.reduceat(np.minimum(z, 0), first)
            for v, factor in enumerate(FACTORS):
                part = np.exp(np.multiply(far, -factor, out=part), out=part)
                cost[:, v] = np.add.reduceat(np.log1p(part, out=part), first) - factor * least
            least = cost.min(1, keepdims=True)
            joint = trust[:live] * np.exp(least - cost)
            mass = joint.sum(1, keepdims=True)
            total[:live] += (least - np.log(mass))[:, 0]
            share = SHARE * min(step / SPAN, 1)
            trust[:live] = (1 - share) * joint / mass + share * TRUST
            miss = np.exp(np.minimum(z, 80, out=z), out=z)         # the error: what was left for the decision that was not taken
            miss += 1
            np.divide(1, miss, out=miss)
            for k in range(L):
                x[k] *= miss
                weights[k, : live * GATES] += RATE * min(BLOCK / step, 1) * np.bincount(which, weights=x[k], minlength=live * GATES)
            done += step
        return total


class Seen:
    """What is known of the units of a task's pieces so far; beyond MOST units it begins anew."""

    MOST = 1 << 18

    def __init__(self) -> None:
        self.node, self.hash = None, np.zeros(0, np.uint64)
        self.units, self.all = np.zeros((4, 0), np.int32), [np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros((0, 2), np.int32)]

    def known(self, u: Units, code: Code, bits: int, model: Model | None = None) -> Known:
        """Of the distinct units of u; without a model the first layer's logits are left out."""
        if self.node is None:
            self.node = 2 * _salts(code, bits) + code.bit
        if len(self.hash) + len(u.hash) > self.MOST:
            node = self.node
            self.__init__()
            self.node = node
        at = np.minimum(np.searchsorted(self.hash, u.hash), max(len(self.hash) - 1, 0))
        old = self.hash[at] == u.hash if len(self.hash) else np.zeros(len(u.hash), bool)
        new = np.flatnonzero(~old)
        found = np.empty((4, len(u.hash)), np.int32)
        found[:, old] = self.units[:, at[old]]
        if len(new):
            symbols, taken, since, decided, node = _spelled(u, new, code, self.node)
            inside = np.cumsum(taken, dtype=np.int32) - taken
            found[:, new] = symbols, np.cumsum(symbols) - symbols + len(self.all[0]), taken, inside + len(self.all[2])
            cells = np.zeros((len(node), 2), np.int32)
            cells[:, 0] = node
            if model:
                logit = cells[:, 1]
                place = np.zeros(len(u.hash), np.int32)
                place[new] = inside
                for some in alike(u, new):
                    z, steps = model.mixed(u, some)
                    fine = np.rint(np.clip(z, -30, 30) * _FINE).astype(np.int32)
                    logit[_flat(place[some], found[2, some])] = fine.take(_flat(steps.bounds[:-1].take(steps.of), np.diff(steps.bounds).take(steps.of)))
            self.all = [np.concatenate(both) for both in zip(self.all, (since, decided, cells))]
            joined = np.concatenate([self.hash, u.hash[new]])
            order = np.argsort(joined)
            self.hash, self.units = joined[order], np.concatenate([self.units, found[:, new]], axis=1)[:, order]
        return Known(*found, *self.all)


def fit(docs: DataFrame, training: Column, byte_counts: np.ndarray) -> Model:
    """Centres, tables and weights, each from all training rows."""
    rows = unigram.rows_of(docs, training)
    table, learned = _byte_table(rows), _training(rows)
    code, centres = Code.huffman(_pairs(table)), _centres(rows, table)
    tables = _train_tables(learned, code, centres)
    model = Model(code, tables[0].copy(), _weights(learned, code, centres, tables), centres)
    size = int(byte_counts.sum())
    bits = _bits(size)
    across = _across_tables(learned, code, bits, size)
    model.across = Across(bits, across[0].copy(), _across_weights(learned, model, tables, across, bits))
    return model


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    Learns from the rows of docs (doc_id, text) where `training` holds. A null text is empty: it has the end token only. Rows equal in
    id and text have equal scores; a null id is an id. Extra columns are not read; an empty table gives no rows.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    base = unigram.count(docs, training, int(total))
    model = fit(docs, training, base.byte_counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for piece in store.pieces(batches, most=PIECE // 2):
            texts = piece.column("text").fill_null("")
            data, offsets = buffers(texts)
            begin = ~SPACE[data]
            inside = begin.copy()
            begin[1:] &= ~inside[:-1]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            begin[cuts] = inside[cuts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "digest": pa.array(unigram.digests(data, offsets)), "train": piece.column("train"),
                "n_tokens": pa.array(sums_per_text(begin, offsets) + 1), "n_bytes": pa.array(np.diff(offsets)), "bits": pa.array(shared.value.bits(texts, seen))})

    scored = unigram.rows_of(docs, training).mapInArrow(scan, "doc_id long, digest long, train boolean, n_tokens long, n_bytes long, bits double")
    # rows equal in id and text have equal sums
    sums = base.sums.groupBy("doc_id", "digest").agg(F.max("partial").alias("partial"), F.max("known").alias("known"))
    found = scored.join(sums.withColumnRenamed("doc_id", "id"), (scored.digest == sums.digest) & scored.doc_id.eqNullSafe(F.col("id"))).drop(sums.digest)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
                        F.lit(base.tokens).cast("long").alias("train_tokens"), base.score(F.col("partial"), F.col("n_tokens")).alias("base_score"),
                        (-F.col("bits") * float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
