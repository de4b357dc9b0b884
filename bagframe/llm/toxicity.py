"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is, and only documents have labels.

A sentence's evidence z is the sum over its distinct words of the weights of a word's features, itself and its beginnings; it is toxic with probability 1 - exp(-rate), where the rate
softplus(z + OFFSET) - softplus(OFFSET) is zero for z <= 0. A document is toxic if any sentence is (noisy-or), so rates add up:
P = 1 - exp(-sum). As a sentence without evidence has rate zero, a text does not become suspect by its length. The weights maximise the
likelihood of the document labels with an L1 penalty, so few features have one, and those are kept by their full hashes. During training
a document has a rate of its own besides, the share of toxic ones, so that words need not explain what they cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.words import NOT_ALNUM, Words, code_points, mix, words

#: Where the rate of a sentence bends; softplus(OFFSET) is small, so weights are about log odds.
OFFSET = -2.0
#: A sentence ends at one of these.
ENDS = np.zeros(256, bool)
ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
#: Bytes of a word's beginnings that are features beside the word.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def _softplus(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def rate(z: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, _softplus(z + OFFSET) - _softplus(OFFSET))


@dataclass(frozen=True)
class Toxicity:
    """Hashes of features in order and their weights; all others weigh nothing."""

    hashes: np.ndarray
    weights: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)


def sentences(texts) -> tuple[Words, np.ndarray]:
    """(words of the texts, sentence number of each word). Sentences are numbered through all texts; one without words has no number."""
    w = words(texts, NOT_ALNUM, lower=True)
    seen = np.concatenate([[0], np.cumsum(ENDS[w.data], dtype=np.int64)])
    fresh = np.ones(len(w.text), bool)
    fresh[1:] = (w.text[1:] != w.text[:-1]) | (seen[w.start[1:]] != seen[w.start[:-1]])
    return w, np.cumsum(fresh) - 1


def features(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, place in `at` of its word) of the words number `at`."""
    padded = np.zeros(len(w.data) + 8, np.uint8)
    padded[: len(w.data)] = w.data
    eight = np.ndarray((len(w.data) + 1,), "<u8", buffer=padded, strides=(1,))
    start, size = w.start[at], (w.end - w.start)[at]
    value, of = [mix(w.hash[at] ^ np.uint64(0x70))], [np.arange(len(at))]
    for k in BEGINNINGS:
        fits = np.flatnonzero(size >= k)
        value.append(mix(mix(eight[start[fits]] & np.uint64((1 << (8 * k)) - 1)) ^ np.uint64(k)))
        of.append(fits)
    return np.concatenate(value), np.concatenate(of)


def _distinct(sentence: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each word of a sentence comes first."""
    order = np.lexsort((h, sentence))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (sentence[order][1:] == sentence[order][:-1])
    return np.flatnonzero(~again)


def train(texts: list[str], toxic: list[int], share: float | None = None, penalty: float = 1.0, least_texts: int = 2, rounds: int = 150,
          step: float = 0.5) -> Toxicity:
    """Weights from labelled texts. `share` is the share of toxic ones where the texts come from, if they are not a fair sample.
    Features in fewer than `least_texts` texts get no weight; without texts of both labels none does."""
    y = np.array(toxic, bool)
    none = Toxicity(np.zeros(0, np.uint64), np.zeros(0))
    if not y.any() or y.all():
        return none
    share = min(max(y.mean() if share is None else share, 1e-6), 1 - 1e-6)
    w, sentence = sentences(pa.array(texts, pa.large_string()))
    if not len(sentence):
        return none
    first = _distinct(sentence, w.hash)
    of, text = sentence[first], w.text[first]
    _, at, kind = np.unique(w.hash[first], return_index=True, return_inverse=True)      # words, and which word stands where
    value, word = features(w, first[at])
    in_texts = np.bincount(np.unique(kind * np.int64(len(texts)) + text) // len(texts), minlength=len(at))
    u, feature = np.unique(value, return_inverse=True)
    keep = np.bincount(feature, weights=in_texts[word], minlength=len(u)) >= least_texts
    if not keep.any():
        return none
    number = np.cumsum(keep) - 1
    used = keep[feature]
    u, feature, word = u[keep], number[feature[used]], word[used]
    n_sentences = int(sentence[-1]) + 1
    owner = np.zeros(n_sentences, np.int64)
    owner[sentence] = w.text
    # each label counts as much as it does where the texts come from
    importance = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    leak = -np.log1p(-share)
    v, squares = np.zeros(len(u)), np.full(len(u), 1e-8)
    for _ in range(rounds):
        z = np.bincount(of, weights=np.bincount(word, weights=v[feature], minlength=len(at))[kind], minlength=n_sentences)
        total = np.bincount(owner, weights=rate(z), minlength=len(y)) + leak
        slope = np.where(y, 1 / np.expm1(np.minimum(total, 700)), -1.0) * importance
        # a clean text has nothing to gain from a sentence that has no rate; a toxic one has
        pull = slope[owner] * _sigmoid(z + OFFSET) * ((z >= 0) | y[owner])
        g = np.bincount(feature, weights=np.bincount(kind, weights=pull[of], minlength=len(at))[word], minlength=len(u))
        squares += g * g
        pace = step / np.sqrt(squares)
        v = v + pace * g
        v = np.sign(v) * np.maximum(np.abs(v) - pace * penalty, 0.0)
    kept = np.flatnonzero(v)
    return Toxicity(u[kept], v[kept])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, longest: int) -> tuple[list[str], list[int], float]:
    """(texts, labels, share of toxic ones among all labelled documents) of about `per_label` documents of each label, whose texts
    have at most `longest` bytes: per_label * 2 * longest bounds what comes to the driver. Picked by a hash of id and text, so a rerun
    picks the same; rows equal in both are one example. A document with contradicting labels is toxic; null ids have no label."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    keyed = keyed.withColumn("key", F.xxhash64("id", "text"))
    place = keyed.select("id", "key", (F.octet_length("text") <= longest).alias("short")).join(marks, "id").groupBy("key").agg(F.max("toxic").alias("toxic"), F.first("short").alias("short"))
    place = store.written(place, "toxic-labels")
    counts = {r["toxic"]: r for r in place.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short")).collect()}
    if not counts:
        return [], [], 0.0
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    limit = F.when(F.col("toxic") == 1, F.lit(per_label / max(1, counts[1]["short"] if 1 in counts else 1))).otherwise(
        F.lit(per_label / max(1, counts[0]["short"] if 0 in counts else 1)))
    picked = place.where(F.col("short") & (unit < limit)).orderBy(unit, "key").limit(3 * per_label).select("key", "toxic")
    rows = keyed.join(F.broadcast(picked), "key").groupBy("key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("key").collect()
    share = (counts[1]["n"] if 1 in counts else 0) / sum(c["n"] for c in counts.values())
    return [r["text"] for r in rows], [r["toxic"] for r in rows], share


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1000, longest: int = 1 << 15, **settings) -> Toxicity:
    """Train on the labelled ones of docs. `per_label` and `longest` bound the sample."""
    texts, toxic, share = labelled_sample(docs, labels, per_label, longest)
    return train(texts, toxic, share, **settings)


def sentence_scores(texts, model: Toxicity) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each sentence, text of each sentence, rate of each sentence)."""
    w, sentence = sentences(texts)
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    begin = np.searchsorted(sentence, np.arange(n))
    _, at, kind = np.unique(w.hash, return_index=True, return_inverse=True)
    found, word = features(w, at)
    value = np.bincount(word, weights=model.of(found), minlength=len(at))[kind]
    some = np.flatnonzero(value)
    some = some[_distinct(sentence[some], w.hash[some])]
    return w, begin, w.text[begin], rate(np.bincount(sentence[some], weights=value[some], minlength=n))


def score_texts(docs: DataFrame, model: Toxicity, least: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, n_sentences, n_offending, worst) of every row: the noisy-or of the sentences, whether it is `least` or more,
    how many sentences have a word, how many of them are toxic with probability `least` or more, and the number of the worst one among
    those with a word (the first of equals; null where no sentence has any evidence). A null, empty or wordless text scores 0. Repeated
    rows get a row each; only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches):
            _, _, text, r = sentence_scores(piece.column("text"), model)
            n = piece.num_rows
            score = -np.expm1(-np.bincount(text, weights=r, minlength=n))
            count = np.bincount(text, minlength=n).astype(np.int64)
            offending = np.bincount(text[-np.expm1(-r) >= least], minlength=n).astype(np.int64)
            first = np.cumsum(count) - count
            worst, has = np.zeros(n, np.int64), np.zeros(n, bool)
            some = np.flatnonzero(r > 0)
            some = some[np.lexsort((some, -r[some], text[some]))]
            lead = np.ones(len(some), bool)
            lead[1:] = text[some][1:] != text[some][:-1]
            worst[text[some[lead]]] = some[lead] - first[text[some[lead]]]
            has[text[some[lead]]] = True
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "score": pa.array(np.clip(score, 0, 1)), "predicted": pa.array((score >= least).astype(np.int32)),
                "n_sentences": pa.array(count), "n_offending": pa.array(offending), "worst": pa.array(worst, mask=~has)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, n_offending long, worst long")


def offending_sentences(docs: DataFrame, model: Toxicity, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, start, end, score, text) of all sentences that are toxic with probability `least` or more: number among the sentences
    with a word, code points from its first word to the end of its last, and the words between as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches):
            w, begin, text, r = sentence_scores(piece.column("text"), model)
            found = np.flatnonzero(-np.expm1(-r) >= least)
            if not len(found):
                continue
            count = np.bincount(text, minlength=piece.num_rows)
            points = code_points(w.data)
            last = np.append(begin[1:], len(w.text))[found] - 1
            a, b, base = w.start[begin[found]], w.end[last], w.offsets[text[found]]
            raw = piece.column("text")
            start, end = points[a] - points[base], points[b] - points[base]
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id").take(pa.array(text[found])), "sentence": pa.array(found - (np.cumsum(count) - count)[text[found]]),
                "start": pa.array(start), "end": pa.array(end), "score": pa.array(-np.expm1(-r[found])),
                "text": pa.array([raw[int(t)].as_buffer().to_pybytes()[int(p - o): int(q - o)].decode() for t, p, q, o in zip(text[found], a, b, base)], pa.string())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sentence long, start long, end long, score double, text string")


def toxic_scores(docs: DataFrame, labels: DataFrame, training: Column, **settings) -> DataFrame:
    """:func:`score_texts` of all docs by a model that learned the labels of the `training` ones. Without labels of both kinds all score 0."""
    return score_texts(docs, fit(docs.where(training), labels, **settings))
