"""Language identification of words and texts by a linear-chain conditional random field.

A word's emission is the sum of the weights of its hashed features: prefixes and suffixes, inner n-grams, and the word
itself (the lexicon). Labels of neighbouring words are tied by learned transitions. Forward-backward over a line gives every
word a distribution over languages, also where languages alternate; a text's distribution is the mean over its words.

Training texts carry one label each. Training sequences are spans of several texts after each other, so the transitions
learn that languages change, and how rarely. Only the labelled sample, which is bounded by parameters, meets in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.words import NOT_ALNUM, Words, lines, mix, words

UNDETERMINED = "und"
BITS = 16
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3)
#: Bytes of text labelled at once; features and distributions of their words take some dozens of times as much.
PIECE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _with_letters(w: Words) -> Words:
    """Only words with a letter or a byte beyond ASCII; the others say nothing about the language."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[w.data], dtype=np.int64)])
    keep = seen[w.end] > seen[w.start]
    return w._replace(text=w.text[keep], start=w.start[keep], end=w.end[keep], hash=w.hash[keep])


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word + total), grouped by word."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    word, value = [np.arange(len(start))], [mix(hashes ^ np.uint64(0x51))]
    for k in AFFIXES:
        fits = np.flatnonzero(size >= k)
        for kind, at in ((1, start[fits]), (2, end[fits] - k)):
            word.append(fits)
            value.append(mix((eight[at] & masks[k]) ^ np.uint64((kind << 60) + (k << 56))))
    for k in GRAMS:
        n = np.maximum(size - k + 1, 0)
        of = np.repeat(np.arange(len(start)), n)
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        word.append(of)
        value.append(mix((eight[at] & masks[k]) ^ np.uint64((3 << 60) + (k << 56))))
    word, value = np.concatenate(word), (np.concatenate(value) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return value[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(start)))])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1], axis=0) if len(bounds) > 1 else np.zeros((0, values.shape[1]), values.dtype)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray       # feature, label
    transitions: np.ndarray   # from, to
    start: np.ndarray         # label

    @classmethod
    def empty(cls, labels: list[str]) -> Crf:
        n = len(labels)
        return cls(labels, np.zeros((1 << BITS, n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))

    def emissions(self, data, start, end, hashes) -> np.ndarray:
        value, bounds = features(data, start, end, hashes)
        return _sums(self.weights[value], bounds)

    def marginals(self, emission: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False):
        """Label distribution of every word by forward-backward; sequences are emission[first:first+size]. With `pairs`
        also the expected number of each transition. All sequences advance one word per step."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        e = np.exp(emission - emission.max(1, keepdims=True))
        move = np.exp(self.transitions - self.transitions.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, n in enumerate(active):
            at = first[:n] + t
            a = e[at] * (np.exp(self.start - self.start.max()) if t == 0 else alpha[at - 1] @ move)
            alpha[at] = a / a.sum(1, keepdims=True)
        expected = np.zeros_like(move)
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            b = e[at] * beta[at]
            if pairs:
                joint = alpha[at - 1][:, :, None] * move[None] * b[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = b @ move.T
            beta[at - 1] = b / b.sum(1, keepdims=True)
        m = alpha * beta
        m /= m.sum(1, keepdims=True)
        return (m, expected) if pairs else m


def train(texts: list[str], labels: list[str], spans: int = 12, span_words: tuple[int, int] = (8, 30), joined: int = 4, epochs: int = 6,
          batch: int = 256, rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> Crf:
    """Fit by the gradient of the conditional likelihood (AdaGrad). `spans` spans of each text, `joined` of them per sequence."""
    names = sorted(set(labels))
    crf = Crf.empty(names)
    w = _with_letters(words(pa.array(texts, pa.large_string()), NOT_ALNUM, lower=True))
    if not len(w.hash) or len(names) < 2:
        return crf
    rng = np.random.default_rng(seed)
    label_of = np.searchsorted(names, labels)
    u, at, kind = np.unique(w.hash, return_index=True, return_inverse=True)
    value, bounds = features(w.data, w.start[at], w.end[at], u)
    owner = np.repeat(np.arange(len(u)), np.diff(bounds))
    begin = np.searchsorted(w.text, np.arange(len(texts) + 1))
    pool = []
    for i in range(len(texts)):
        n = begin[i + 1] - begin[i]
        for _ in range(spans if n else 0):
            length = min(n, int(rng.integers(*span_words)))
            s = begin[i] + int(rng.integers(0, n - length + 1))
            pool.append((s, length, label_of[i]))
    # each sequence keeps to one language or changes it with every span, half and half
    order = rng.permutation(len(pool))
    by_label = sorted(order[: len(order) // 2], key=lambda i: pool[i][2])
    order = np.concatenate([np.array(by_label, np.int64), order[len(order) // 2:]])
    sequences = [order[i: i + joined] for i in range(0, len(order), joined)]
    squares = [np.full_like(x, 1e-8) for x in (crf.weights, crf.transitions, crf.start)]
    for _ in range(epochs):
        for b in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // batch)):
            index, truth, size = [], [], []
            for s in b:
                parts = [pool[i] for i in sequences[s]]
                index += [np.arange(p, p + n) for p, n, _ in parts]
                truth += [np.full(n, y) for _, n, y in parts]
                size.append(sum(n for _, n, _ in parts))
            index, truth, size = np.concatenate(index), np.concatenate(truth), np.array(size)
            first = np.cumsum(size) - size
            types = kind[index]
            emission = _sums(crf.weights[value], bounds)[types]
            m, expected = crf.marginals(emission, first, size, pairs=True)
            seen = np.zeros_like(expected)
            inner = np.ones(len(index), bool)
            inner[first] = False
            np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            miss = -m
            miss[np.arange(len(truth)), truth] += 1
            per_type = np.zeros((len(u), len(names)), np.float32)
            np.add.at(per_type, types, miss)
            touched = np.abs(per_type).sum(1) > 0
            rows = touched[owner]
            grad = np.zeros_like(crf.weights)
            np.add.at(grad, value[rows], per_type[owner[rows]])
            begins = np.bincount(truth[first], minlength=len(names)) - m[first].sum(0)
            for x, g, q in zip((crf.weights, crf.transitions, crf.start), (grad, seen - expected, begins), squares):
                g = (g / len(b)).astype(np.float32) - decay * x
                q += g * g
                x += rate * g / np.sqrt(q)
    return crf


def labelled_sample(docs: DataFrame, per_label: int = 300, most: int | None = None) -> list[tuple[str, str]]:
    """(text, lang) of about `per_label` documents of every label, fewer if a label has fewer: at most `per_label` times the number of
    labels, which is the bound of what the driver holds. Chosen by a hash of id and text, so a rerun takes the same ones and a null id
    is an id; rows equal in id, text and label are one example. `most` is a bound of the rows of docs, if the caller knows one: each
    file of a task costs the executor a process of its own, so the keys go into as few as they fill."""
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("key"), "lang", "text")
    place = store.written(keyed.select("key", "lang").distinct(), "labelled", most)
    counts = place.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    picked = place.join(counts, "lang").withColumn("place", unit * F.col("n"))
    picked = picked.orderBy("place", "key", "lang").limit(per_label * counts.count()).select("key", "lang")
    rows = keyed.join(F.broadcast(picked), ["key", "lang"], "left_semi").groupBy("key", "lang").agg(F.min("text").alias("text"))
    return [(r["text"], r["lang"]) for r in rows.orderBy("key", "lang").collect()]


def fit(docs: DataFrame, per_label: int = 300, **settings) -> Crf:
    """Train on labelled documents (doc_id, text, lang); rows without a text or a label are no examples."""
    rows = labelled_sample(docs.where("text is not null and lang is not null"), per_label, docs.count())
    return train([t for t, _ in rows], [y for _, y in rows], **settings)


def _has_letter(w: Words, texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    n = len(w.offsets) - 1
    ascii_letter = (w.data >= 97) & (w.data <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter, dtype=np.int64)])
    out = sums[w.offsets[1:]] > sums[w.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(w.offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out if n else np.zeros(0, bool)


def label_texts(texts: pa.Array, crf: Crf) -> tuple[list[str], np.ndarray, np.ndarray, Words]:
    """(label, score) of every text, and the distributions of its words with the words themselves."""
    w = _with_letters(words(texts, NOT_ALNUM, lower=True))
    n, k = len(texts), len(crf.labels)
    u, at, kind = np.unique(w.hash, return_index=True, return_inverse=True)
    emission = crf.emissions(w.data, w.start[at], w.end[at], u)[kind] if len(u) else np.zeros((0, k), np.float32)
    line = np.searchsorted(lines(w.data, w.offsets).start, w.start, side="right")
    breaks = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    m = crf.marginals(emission, breaks, np.diff(np.append(breaks, len(line)))) if len(line) else emission
    total = np.zeros((n, k))
    for j in range(k):
        total[:, j] = np.bincount(w.text, weights=m[:, j], minlength=n)
    count = np.maximum(np.bincount(w.text, minlength=n), 1)
    mean = total / count[:, None]
    best = mean.argmax(1)
    known = _has_letter(w, texts) & (total.sum(1) > 0)
    label = [crf.labels[b] if ok else UNDETERMINED for b, ok in zip(best, known)]
    return label, np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0), m, w


def labelled(batches: Iterator[pa.RecordBatch], crf: Crf, column: str = "text") -> Iterator[tuple]:
    """(piece, labels, scores, distributions of the words, words): `label_texts` of the batches, a piece of bounded size at a time."""
    for piece in store.pieces(batches, column, PIECE):
        yield piece, *label_texts(piece.column(column).fill_null(""), crf)


def predict(docs: DataFrame, crf: Crf, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row: the label with the largest mean probability over the words (ties: the first by name).
    A null text, a text without a letter, and a model without labels give `und` and 0. Only key and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, label, score, _, _ in labelled(batches, crf):
            yield pa.RecordBatch.from_pydict({"key": piece.column("key"), "lang_pred": pa.array(label, pa.string()), "score": pa.array(score)})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    if not crf.labels:
        return rows.select(F.col("key").alias(key), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def recognised(docs: DataFrame, crf: Crf, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose words are recognised: the mean over the words of their best language's
    probability is `least` or more, whatever the languages are, so a text that changes its language stays. A text that is null or has
    no letter goes. Repeated rows stay or go alike; an empty table, and a model without labels, give no rows."""

    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])       # any name will do
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, label, _, m, w in labelled(batches, crf, text):
            n = piece.num_rows
            sure = np.bincount(w.text, weights=m.max(1), minlength=n) / np.maximum(np.bincount(w.text, minlength=n), 1)
            yield piece.filter(pa.array([y != UNDETERMINED and s >= least for y, s in zip(label, sure)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*names) if crf.labels else docs.limit(0)
