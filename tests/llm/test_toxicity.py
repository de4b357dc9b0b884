"""Sentence scores against brute force, training on planted words, held-out accuracy, and odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from brute import low
from llm_tables import bench_rows, benchmark, empty, messy, rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from bagframe.llm.toxicity import BEGINNINGS, OFFSET, Toxicity, fit, offending_sentences, score_texts, sentence_scores, toxic_scores, train
from bagframe.llm.words import NOT_ALNUM, mix, words

LABELS = "doc_id long, quality int, toxic int, text string, id string, key int"


def _feature(word: str, k: int | None) -> int:
    w = words(pa.array([word]), NOT_ALNUM, lower=True)
    if k is None:
        return int(mix(w.hash ^ np.uint64(0x70))[0])
    head = word.encode()[:k].ljust(8, b"\0")
    return int(mix(mix(np.frombuffer(head, "<u8").copy()) ^ np.uint64(k))[0])


def _model(weights: dict) -> Toxicity:
    """Weights by (word or beginning, number of bytes or None)."""
    pairs = sorted((_feature(word, k), x) for (word, k), x in weights.items())
    return Toxicity(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))


def _brute(text, weights):
    """Per sentence with a word: (start, end, rate)."""
    t, out = low(text), []
    for m in re.finditer(r"[^.!?\n]+", t):
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", m.group()))
        if not found:
            continue
        z = 0.0
        for w in {f.group() for f in found}:
            z += weights.get((w, None), 0)
            z += sum(weights.get((w.encode()[:k].decode(errors="replace"), k), 0) for k in BEGINNINGS if len(w.encode()) >= k)
        soft = lambda x: math.log1p(math.exp(x))
        out.append((m.start() + found[0].start(), m.start() + found[-1].end(), max(0.0, soft(z + OFFSET) - soft(OFFSET))))
    return out


WEIGHTS = {("again", None): 2.0, ("and", None): 1.5, ("lic", 3): 3.0, ("password", 8): -4.0, ("token", 5): 6.0, ("e", None): 0.5, ("one", None): 9.0}


def test_scores_against_brute_force(messy, rows):
    got = Counter((r.doc_id, round(r.score, 9), r.predicted, r.n_sentences, r.n_offending, r.worst) for r in score_texts(messy, _model(WEIGHTS)).collect())
    want, spans = Counter(), Counter()
    for i, text, *_ in rows:
        found = _brute(text, WEIGHTS)
        rates = [r for *_, r in found]
        p = 1 - math.exp(-sum(rates))
        worst = rates.index(max(rates)) if rates and max(rates) > 0 else None
        offending = [(k, a, b, r) for k, (a, b, r) in enumerate(found) if 1 - math.exp(-r) >= 0.5]
        want[(i, round(p, 9), int(p >= 0.5), len(found), len(offending), worst)] += 1
        spans.update((i, k, a, b, text[a:b]) for k, a, b, _ in offending)
    assert got == want
    assert Counter((r.doc_id, r.sentence, r.start, r.end, r.text) for r in offending_sentences(messy, _model(WEIGHTS)).collect()) == spans
    assert any(w[5] is not None for w in want)


def test_planted_words_are_learned_from_document_labels():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    sentence = lambda *extra: " ".join(rng.sample(vocabulary, 9) + list(extra)).capitalize() + "."
    texts, y, where = [], [], []
    for i in range(300):
        toxic, n = i % 5 == 0, rng.randint(2, 30)
        parts = [sentence() for _ in range(n)]
        at = rng.randrange(n)
        if toxic:
            parts[at] = sentence(rng.choice(["zounds", "drat", "fie"]))
        texts.append(" ".join(parts))
        y.append(int(toxic))
        where.append(at if toxic else None)
    model = train(texts[:200], y[:200])
    w, begin, text, rate = sentence_scores(pa.array(texts[200:] + [" ".join(sentence() for _ in range(20_000))]), model)
    p = -np.expm1(-np.bincount(text, weights=rate, minlength=101))
    assert [int(x >= 0.5) for x in p[:100]] == y[200:] and p[100] < 0.5      # a very long clean text is not suspect
    for i, at in enumerate(where[200:]):
        if at is not None:
            mine = np.flatnonzero(text == i)
            assert rate[mine].argmax() == at


def test_training_without_both_labels_or_words():
    for texts, y in (([], []), (["a b"], [1]), (["a b", "c"], [0, 0]), (["", "."], [1, 0]), (["a", "b"], [1, 0])):
        assert len(train(texts, y).hashes) == 0


def test_labels_of_every_kind(spark, messy, rows, empty):
    label = lambda *ls: spark.createDataFrame([(i, None, t, "x", "y", 1) for i, t in ls], LABELS)
    none = label()
    assert {r.score for r in toxic_scores(messy, none, F.lit(True)).collect()} == {0.0}
    assert toxic_scores(messy, none, F.lit(True)).count() == len(rows)
    some = label((8, 1), (8, 0), (8, 0), (None, 1), (20, 0), (21, 0), (22, None), (33, 0), (9, 1), (7, 0), (999, 1))
    from bagframe.llm.toxicity import labelled_sample

    texts, y, share = labelled_sample(messy, some, 100, 1 << 16)
    known = {8: 1, 20: 0, 21: 0, 33: 0, 9: 1, 7: 0}
    kept = {(r[0], r[1]) for r in rows if r[0] in known}
    assert sorted(zip(texts, y)) == sorted((t, known[i]) for i, t in kept if len(t.encode()) <= 1 << 16)
    assert share == sum(known[i] for i, _ in kept) / len(kept)
    model = fit(messy, some, least_texts=1)
    again = fit(messy.repartition(5), some, least_texts=1)
    assert (model.hashes == again.hashes).all() and (model.weights == again.weights).all()
    assert toxic_scores(empty, some, F.lit(True)).count() == 0 and offending_sentences(empty, model).count() == 0


def test_toxic_query(spark):
    from bagframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_toxic_sentences"](spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p for t, p in held if t) > 0.85 * sum(t for t, _ in held) and sum(p for t, p in held if not t) < 0.02 * len(held)
