"""Every operator on a messy table against brute force, on an empty table, and its parts on their own."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
from llm_tables import bench_rows, benchmark, empty, messy, rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F


def bag(rows):
    return Counter(tuple(r) for r in rows)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# --- words and lines -----------------------------------------------------------------------------------------------------

def test_words_against_regex(rows):
    from bagframe.llm.words import NOT_ALNUM, SPACE, windows, words

    texts = [r[1] for r in rows]
    for table, pattern, lower in ((SPACE, brute.SPACED, False), (NOT_ALNUM, brute.WORDS, True)):
        w = words(pa.array(texts), table, lower)
        want = [x for t in texts for x in pattern.findall(brute.low(t) if lower else t or "")]
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == want
        seen = {}
        for h, x in zip(w.hash.tolist(), want):
            assert seen.setdefault(h, x) == x
        assert len(set(seen.values())) == len(seen)
        first, h = windows(w, 3)
        assert len(first) == sum(max(0, len(pattern.findall(brute.low(t) if lower else t or "")) - 2) for t in texts)


def test_lines_against_split(rows):
    from bagframe.llm.words import buffers, lines

    texts = [r[1] for r in rows]
    data, offsets = buffers(pa.array(texts))
    found = lines(data, offsets)
    got = defaultdict(list)
    for t, a, b in zip(found.text, found.start, found.end):
        got[t].append(data[a:b].tobytes().decode())
    assert [got[i] for i in range(len(texts))] == [(t or "").split("\n") for t in texts]


# --- 1 -------------------------------------------------------------------------------------------------------------------

def test_mixing_base_and_score(messy, rows):
    from bagframe.llm.context_mixing import score_texts
    from bagframe.llm.queries import _remainder

    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    tokens = [brute.SPACED.findall(brute.low(t)) + [None] for _, t in pairs(rows)]
    c = Counter(x for (i, _), t in zip(pairs(rows), tokens) if train(i) for x in t)
    n, v = sum(c.values()), len(c)
    want = [(i, not train(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6))
            for (i, _), t in zip(pairs(rows), tokens)]
    got = score_texts(messy, _remainder(10) != 0).collect()
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == bag(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_mixing_symbol_probabilities_sum_to_one():
    from bagframe.llm import context_mixing as cm

    rng = np.random.default_rng(4)
    code = cm.Code.huffman(rng.integers(0, 50, 257))
    table = ((rng.integers(-60, 60, cm.TOTAL) << 3) | rng.integers(0, 8, cm.TOTAL)).astype(np.int16)
    model = cm.Model(code, table, rng.uniform(0, 0.5, (cm.GATES, cm.K)).astype(np.float32), np.zeros((1, 256), np.float32))
    prefix = np.frombuffer(b"pre", np.uint8)
    total = 0.0
    for symbol in range(257):
        own = prefix if symbol == cm.END else np.append(prefix, np.uint8(symbol))
        data = np.concatenate([np.zeros(8, np.uint8), own, np.zeros(8, np.uint8)])
        u = cm.Units(np.array([0]), np.array([0]), np.array([8]), np.array([len(own)]), np.array([symbol == cm.END]), np.zeros(1, np.uint64), data, np.array([0, len(own)]))
        before = cm.Units(np.array([0]), np.array([0]), np.array([8]), np.array([3]), np.array([False]), np.zeros(1, np.uint64), data, np.array([0, 3]))
        total += math.exp(-(model.costs(u)[0, 1] - model.costs(before)[0, 1]))
    assert abs(total - 1) < 1e-4
    whole = model.bits(pa.array(["", "abc", "abc abc", None]))
    assert whole[0] == whole[3] and np.isfinite(whole).all()


def test_mixing_learns_from_all_training_texts(spark):
    """Every training text is in the centres, in the tables and in the weights, and its weights come from the other fold's counts."""
    from bagframe.llm import context_mixing as cm
    from bagframe.llm import unigram

    texts = [f"word{i} alpha beta {i * 7919 % 101} gamma\nline {i}" for i in range(900)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = unigram.rows_of(docs, F.lit(True))
    training = cm._training(rows)
    assert bag(r.text for r in training.collect()) == bag(t or "" for t in texts)
    centres = cm._centres(rows)
    x = cm.profiles(*(lambda d, o: (cm.LOWER[d], o))(*cm.buffers(pa.array([t or "" for t in texts]))))
    of = np.argmax(x @ centres.T - 0.5 * (centres ** 2).sum(1), 1)
    assert centres.shape == (cm.SORTS, 256) and (np.bincount(of, minlength=cm.SORTS) > 0).sum() > 1
    code = cm.Code.huffman(np.arange(257))
    tables = cm._train_tables(training, code, centres)
    folds = {r.text: r.fold for r in training.collect()}
    assert set(folds.values()) == set(range(cm.FOLDS))
    for t in (texts[3], texts[401], texts[899]):
        slots, _, _ = cm.decisions(cm.units(pa.array([t]), centres), slice(0, 99), code)
        assert (tables[0][slots] & 7).min() > 0                                   # each text was counted
        assert (tables[1 + folds[t]][slots[cm.K - 1]] & 7).min() == 0             # and not in the tables its weights are fitted by
    w = cm._weights(training, code, centres, tables)
    model = [cm.Model(code, tables[1 + f], w, centres) for f in range(cm.FOLDS)]
    # least cost over all texts: no step is left for the gates with most decisions
    bend, aim = np.zeros((cm.GATES, cm.K, cm.K)), np.zeros((cm.GATES, cm.K))
    for f in range(cm.FOLDS):
        u = cm.units(pa.array([t or "" for t in texts if folds[t or ""] == f]), centres)
        times = np.bincount(u.kind, minlength=len(u.start)).astype(np.float32)
        more, further = model[f].newton(u, slice(0, len(u.start)), times, w)
        bend, aim = bend + more, aim + further
    often = np.trace(bend, axis1=1, axis2=2)
    assert np.abs(cm.solved(bend, aim) - w)[often > often.max() / 20].max() < 0.1


def test_mixing_works_shared_beginnings_out_once(monkeypatch):
    """Words that begin alike share steps, with the same slots, sums and counts as one word at a time; pieces gathered are as one piece."""
    from bagframe.llm import context_mixing as cm

    texts = pa.array(["Walking walked walker-walkers\n", "walk walking abcdefghijkl abcdefghijkm", "", None, "walk"] * 3)
    centres = np.zeros((1, 256), np.float32)
    rng = np.random.default_rng(5)
    code, price = cm.Code.huffman(rng.integers(0, 50, 257)), rng.uniform(0, 1, cm.TOTAL)
    u = cm.units(texts, centres)
    slots, bit, steps = cm.decisions(u, slice(0, len(u.start)), code)
    assert len(steps.bounds) - 1 < (u.size + u.ends).sum() * 0.8
    alone = [cm.decisions(u, slice(i, i + 1), code) for i in range(len(u.start))]
    cost = lambda s, b: price[s].sum(0) * (1 + b)
    assert np.allclose(steps.sums(cost(slots, bit)), [cost(s, b).sum() for s, b, _ in alone])
    often = np.bincount(u.kind)
    want = np.bincount(np.concatenate([2 * s[0].astype(int) + b for s, b, _ in alone]), weights=np.concatenate([np.full(len(b), often[i]) for i, (_, b, _) in enumerate(alone)]))
    assert np.array_equal(np.bincount(2 * slots[0].astype(int) + bit, weights=steps.times(often)), want)
    assert sorted(np.concatenate(list(cm.alike(u)))) == list(range(len(u.start)))
    monkeypatch.setattr(cm, "SMALL", 40)
    batch = pa.RecordBatch.from_pydict({"text": texts.fill_null(""), "fold": pa.array(np.zeros(len(texts), np.int32))})
    for most in (4 << 20, 10):
        monkeypatch.setattr(cm, "GATHERED", most)
        found = {}
        for fold, g, times in cm._gathered(iter([batch]), centres):
            for h, t, a, n in zip(g.hash.tolist(), times.tolist(), g.start, g.size):
                word, before = g.data[a: a + n].tobytes(), found.get(h, (None, 0))
                assert fold == 0 and before[0] in (None, word)
                found[h] = (word, before[1] + t)
        assert found == {h: (u.data[a: a + n].tobytes(), t) for h, a, n, t in zip(u.hash.tolist(), u.start, u.size, often.tolist())}


def _mixing_model(rng, cm, bits=16):
    code = cm.Code.huffman(rng.integers(0, 50, (257, 257)))
    stored = lambda n: ((rng.integers(-60, 60, n) << 3) | rng.integers(0, 8, n)).astype(np.int16)
    across = cm.Across(bits, stored(2 << bits), rng.uniform(0, 0.6, (cm.GATES, cm.L)).astype(np.float32))
    return cm.Model(code, stored(cm.TOTAL), rng.uniform(0, 0.5, (cm.GATES, cm.K)).astype(np.float32), np.zeros((1, 256), np.float32), across)


def test_mixing_contexts_reach_over_white_space():
    """Two symbols share a slot if and only if the last bytes, or the word before and the bytes since the white space, are the same."""
    from bagframe.llm import context_mixing as cm

    texts = ["The cat sat.\n The  cat sat on the cat", "", "a cat sat", "the cat\tsat", " ", "abcdefghij abcdefghij abcdefghix"]
    u = cm.units(pa.array(texts), np.zeros((1, 256), np.float32))
    code = cm.Code.huffman(np.arange(257))
    got, decided = cm.places(u, np.arange(len(u.kind)), cm.Seen().known(u, code, 29), 29)
    assert decided.tolist() == [code.count[b] for t in texts for b in (*brute.low(t).encode(), cm.END)]
    near, word = [], []
    for t in texts:
        t = brute.low(t)
        for i in range(len(t) + 1):
            near.append((t[max(0, i - cm.REACH): i], min(i, cm.REACH)))
            cut = max((j + 1 for j in range(i) if t[j] in " \t\n"), default=0)
            word.append((next(iter(brute.SPACED.findall(t[:cut])[::-1]), None), t[cut:i]))
    for slots, want in zip(got.T, (near, word)):
        assert len(slots) == len(want) and len(set(slots.tolist())) == len(set(want)) == len(set(zip(slots.tolist(), want)))


def test_mixing_first_layer_knows_all_bytes_since_the_white_space():
    """Words that differ only more than eight bytes back are told apart by the longest context, and share the others."""
    from bagframe.llm import context_mixing as cm

    code = cm.Code.huffman(np.arange(257))
    u = cm.units(pa.array(["abcdefghijkl", "zbcdefghijkl"]), np.zeros((1, 256), np.float32))
    found = [cm.decisions(u, np.array(some), code) for some in ([0], [1], [0, 1])]
    ends = [slots[:, steps.bounds[steps.of[-1]]: steps.bounds[steps.of[-1] + 1]] for slots, _, steps in found]
    assert cm.K == 4 and ends[0].shape == (4, code.count[cm.END])
    assert (ends[0][:3] == ends[1][:3]).all() and (ends[0][3] != ends[1][3]).all() and len(found[2][2].bounds) - 1 == 2 * 13


def test_mixing_codes_by_the_byte_before(spark):
    from bagframe.llm import context_mixing as cm
    from bagframe.llm import unigram

    texts = ["Ab ab\nb", "", None, " a", "abc abd é"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string").repartition(3)
    pairs = cm._pairs(cm._byte_table(unigram.rows_of(docs, F.lit(True))))
    want = Counter()
    for t in texts * 3:
        b = brute.low(t).encode()
        for i in range(len(b) + 1):
            want[256 if i == 0 or b[i - 1] in b" \n" else b[i - 1], b[i] if i < len(b) else cm.END] += 1
    assert {tuple(k.tolist()): pairs[tuple(k)] for k in np.argwhere(pairs)} == want
    code = cm.Code.huffman(pairs)
    for row in set(code.row.tolist()):
        assert abs((0.5 ** code.count[row: row + 257]).sum() - 1) < 1e-9
    assert code.count[code.row[ord("a")] + ord("b")] < code.count[code.row[256] + ord("b")]


def test_mixing_second_layer_sums_to_one(monkeypatch):
    from bagframe.llm import context_mixing as cm

    monkeypatch.setattr(cm, "LOWER", np.arange(256, dtype=np.uint8))          # else capitals are symbols that no text has
    model, prefix, total = _mixing_model(np.random.default_rng(8), cm), b"a word be", 0.0
    for symbol in range(257):
        data = prefix if symbol == cm.END else prefix + bytes([symbol])
        u = cm.units(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)), model.centres)
        x, gate, _ = model.inputs(u, np.arange(len(u.kind)), cm.Seen().known(u, model.code, 16, model))
        z = (x * model.across.weights[gate].T).sum(0)
        behind = model.code.row[[256 if i == 0 or prefix[i - 1] == 32 else prefix[i - 1] for i in range(len(prefix) + 1)]]
        before = model.code.count[behind[:-1] + list(prefix)].sum()
        own = z[before: before + model.code.count[behind[-1] + symbol]]
        total += math.exp(-np.log1p(np.exp(-own)).sum())
    assert abs(total - 1) < 1e-4


def test_mixing_weights_follow_the_coding_errors(monkeypatch):
    """Block by block and per gate, against a plain loop; a text costs the same alone, with others, and in any order."""
    from bagframe.llm import context_mixing as cm

    rng = np.random.default_rng(9)
    model = _mixing_model(rng, cm)
    monkeypatch.setattr(cm, "LANES", 3)
    monkeypatch.setattr(cm, "GROWTH", 4)                          # blocks grow early
    texts = [" ".join(rng.choice(["one", "two", "three", "\n", "seventeen"], n)) for n in (100, 3, 41, 0, 9, 8, 300)] + [None]
    got = model.bits(pa.array(texts))
    assert np.allclose(got, [model.bits(pa.array([t], pa.string()))[0] for t in texts]) and np.allclose(got[::-1], model.bits(pa.array(texts[::-1])))
    for text, bits in zip(texts, got):
        u = cm.units(pa.array([text], pa.string()), model.centres)
        known, n, done, total = cm.Seen().known(u, model.code, 16, model), len(u.kind), 0, 0.0
        weights, trust = model.across.weights.astype(float), cm.TRUST
        while done < n:
            step = max(cm.BLOCK, done // cm.GROWTH)
            x, gate, _ = model.inputs(u, np.arange(done, min(done + step, n)), known)
            z = (x * weights[gate].T).sum(0)
            cost = np.array([np.log1p(np.exp(-f * z)).sum() for f in cm.FACTORS.astype(float)])
            share = np.exp(cost.min() - cost) * trust
            total += cost.min() - math.log(share.sum())
            back = cm.SHARE * min(step / cm.SPAN, 1)
            trust = (1 - back) * share / share.sum() + back * cm.TRUST
            for g in range(cm.GATES):
                weights[g] += cm.RATE * min(cm.BLOCK / step, 1) * (x / (1 + np.exp(z)))[:, gate == g].sum(1)
            done += step
        assert abs(total / math.log(2) + math.log2(cm.SORTS) - bits) < 1e-3 * max(bits, 1)
    monkeypatch.setattr(cm, "RATE", 0.0)
    still = model.bits(pa.array(texts))
    assert abs(still[0] - got[0]) > 1 and np.allclose(still[[1, 3]], got[[1, 3]])           # one block: nothing to follow yet


def test_mixing_word_costs_by_the_word_before(spark):
    """Before, a word cost the same behind any word."""
    from bagframe.llm.context_mixing import score_texts

    rng = np.random.default_rng(3)
    pair = {"red": "apple", "blue": "whale", "old": "stone", "tall": "tower"}
    texts = [" ".join(f"{w} {pair[w]}" for w in rng.choice(list(pair), 30)) for _ in range(200)]
    fits, mixed = "red apple blue whale old stone tall tower", "red stone blue tower old apple tall whale"
    docs = spark.createDataFrame([*enumerate(texts), (1000, fits), (1001, mixed)], "doc_id long, text string").repartition(3)
    score = {r.doc_id: r.score for r in score_texts(docs, F.col("doc_id") < 1000).collect()}
    assert len(score) == 202 and score[1000] > score[1001] + 4


def test_mixing_empty(empty):
    from bagframe.llm.context_mixing import score_texts

    assert score_texts(empty, F.lit(True)).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------------

def test_contamination(messy, rows, benchmark, bench_rows):
    from bagframe.llm.decontaminate import contamination

    got = contamination(messy, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute.contamination(pairs(rows), bench_rows)
    assert bag(got) == bag(want) and sum(w[2] > 0 for w in want) >= 3


def test_contamination_proximity(spark):
    from bagframe.llm.decontaminate import contamination

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, item), (2, item.replace("zeta", "zeta then")), (3, "alpha mu")], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].near_share == 1.0 and got[1].contaminated and not got[2].contaminated and got[2].near_share == 1.0 and got[3].near_share in (None, 1 / 12)


def test_contamination_plan_has_no_python(messy, benchmark):
    from bagframe.llm.decontaminate import contamination
    from bagframe.llm.secrets import secret_digest

    for df in (contamination(messy, benchmark), secret_digest(messy)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|ArrowEval|CartesianProduct|BroadcastNestedLoop", plan)


def test_without_contaminated_keeps_rows_and_columns(messy, rows, benchmark, bench_rows):
    from bagframe.llm.decontaminate import without_contaminated

    bad = [c[-1] for c in brute.contamination(pairs(rows), bench_rows)]
    kept = without_contaminated(messy, benchmark)
    assert kept.columns == messy.columns
    assert bag(kept.select("doc_id", "text").collect()) == bag(p for p, b in zip(pairs(rows), bad) if not b)


# --- 3 -------------------------------------------------------------------------------------------------------------------

def test_token_shards_round_trip(spark, messy, rows):
    from tokenizers import Tokenizer

    from bagframe.llm import store
    from bagframe.llm.queries import vocabulary
    from bagframe.llm.token_shards import Shard, read_shards, write_shards

    tokenizer = Tokenizer.from_file(vocabulary())
    path = store.folder(spark, "shards-test")
    manifest = write_shards(messy, vocabulary(), path)
    got = read_shards(manifest, path).orderBy("start").collect()
    ordered = sorted(pairs(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (i, text) in zip(got, ordered, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = {}
    for i, text in ordered:
        first.setdefault(i, text)
    shards = [Shard(path, m["name"], m["wide"]) for m in manifest.collect()]
    for i in (7, 9, 39, -7, 2 ** 62, 20):
        found = [x for x in (s.get(i) for s in shards) if x is not None]
        assert len(found) == 1 and tokenizer.decode(found[0][:-1].tolist(), skip_special_tokens=False) == (first[i] or "")
    assert all(s.get(123456789) is None for s in shards)


def test_token_shards_empty(empty):
    from bagframe.llm.queries import vocabulary
    from bagframe.llm.token_shards import token_digest

    assert token_digest(empty, vocabulary()).count() == 0


def test_piece_encoder_equals_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from bagframe.llm.queries import vocabulary
    from bagframe.llm.token_shards import PieceEncoder

    tokenizer, encoder = Tokenizer.from_file(vocabulary()), PieceEncoder(vocabulary(), most=50)
    alphabet = st.sampled_from(list("ab 's\n\t\r.é  ​　\x1c\x85日😀1") + ["  ", " \n", "<|endoftext|>", "'ll"])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(alphabet, max_size=14).map("".join), max_size=5))
    def check(texts):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]

    check()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    from bagframe.llm.perfect_hash import PerfectHash

    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    mph, used = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes() + b"tail")
    assert used + 4 == len(PerfectHash.build(keys).to_bytes() + b"tail")
    assert sorted(mph.lookup(keys).tolist()) == list(range(len(keys))) and len(mph) == len(keys)


# --- 4 -------------------------------------------------------------------------------------------------------------------

def test_licenses(messy, rows):
    from bagframe.llm.licenses import scan_licenses

    got = scan_licenses(messy).collect()
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == bag(brute.license_base(pairs(rows)))
    by = {r.doc_id: r for r in got}
    assert by[35].labels == "apache-2,cc-by-nc,mit" and by[35].score == 1.0
    assert by[36].labels == "mit" and by[36].n_base == 0 and 0.8 <= by[36].score <= 1          # words put in: neighbouring diagonals
    assert all(r.labels == "" and r.score == 0 for r in got if r.doc_id not in (35, 36))
    assert all(0 <= s.first < s.last <= r.n_words for r in got for s in r.spans)


def test_licenses_in_many_pieces(spark):
    """A batch that is cut into pieces: more text than one piece holds, in one partition."""
    from bagframe.llm.licenses import scan_licenses

    rows = [(i, ("word " * 20_000) + ("under the MIT license" if i % 3 == 0 else "nothing here")) for i in range(100)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.labels for r in got} == {i: "mit" if i % 3 == 0 else "" for i, _ in rows}
    assert all(r.first_word == 20_000 for r in got if r.labels)


def test_licenses_empty(empty):
    from bagframe.llm.licenses import scan_licenses

    assert scan_licenses(empty).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------------

def test_line_dedup(messy, rows):
    from bagframe.llm.line_dedup import dedup_lines

    got = dedup_lines(messy).select("doc_id", "n_lines", "n_dropped", "text").collect()
    want = brute.dedup(pairs(rows))
    assert bag(got) == bag(want) and sum(w[2] for w in want) > 4


def test_line_dedup_taken_back(spark):
    from bagframe.llm.line_dedup import LineIndex

    rng = random.Random(2)
    lines = [f"a repeated line with the number {i} in it" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(6))) for i in range(40)]
    frame = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    ids = lambda d: spark.createDataFrame([(i,) for i, _ in d], "doc_id long")
    index = LineIndex.empty(spark, shards=4).insert(frame(docs[:25])).insert(frame(docs[25:])).delete(ids(docs[::3]))
    left = [d for k, d in enumerate(docs) if k % 3]
    got = index.dedup(frame(left)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert bag(got) == bag(brute.dedup(left))
    once = LineIndex.empty(spark, shards=4).insert(frame(left))
    columns = ["hi", "lo", "doc_id", "n"]
    assert bag(index.counts.collect()) == bag(once.counts.collect())
    assert bag(index.refs.select(columns).collect()) == bag(once.refs.select(columns).collect())
    again = index.insert(frame(docs[::3]))
    assert bag(again.dedup(frame(docs)).select("doc_id", "n_lines", "n_dropped", "text").collect()) == bag(brute.dedup(docs))
    with pytest.raises(ValueError):
        again.insert(frame(docs[:1]))
    assert LineIndex.empty(spark).insert(frame([])).dedup(frame([])).count() == 0


def test_cuckoo_filter():
    from bagframe.llm.cuckoo import CuckooFilter

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 6000).astype(np.uint64))
    f = CuckooFilter.for_keys(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2000])
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01
    small = CuckooFilter(2)
    assert not small.insert(keys[:50])
    with pytest.raises(KeyError):
        CuckooFilter(2).delete(keys[:1])


# --- 6 -------------------------------------------------------------------------------------------------------------------

def test_secrets(messy, rows):
    from bagframe.llm.secrets import secret_digest

    got = secret_digest(messy).collect()
    want = []
    for i, text in pairs(rows):
        s = brute.secret_spans(text)
        want.append((i, *(sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")), brute.sha(",".join(s))))
    assert bag((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == bag(want)
    text = dict(pairs(rows))[38]
    by = {r.doc_id: r.spans.split(",") for r in got}
    found = [text[int(s.split(":")[1]): int(s.split(":")[2])] for s in by[38] if s.startswith("entropy")]
    assert found == ["q7Zr9Kx2Lm4Tn8Vb3Yc6Wd1"]                            # not the UUID, not the words, not what hex has already
    assert not any(s.startswith("entropy") for i, x in by.items() if i != 38 for s in x)


def test_secrets_entropy_against_count(spark):
    from bagframe.llm.secrets import _entropy

    rng = random.Random(9)
    strings = ["".join(rng.choice("abcdefgh012345XYZ") for _ in range(n)) for n in (20, 21, 37, 5000)]
    rows = [(k, 0, len(s), s) for k, s in enumerate(strings)]
    got = {r.row: r.bits for r in _entropy(spark.createDataFrame(rows, "row long, start long, end long, string string"), 20).collect()}

    def bits(s):
        return -sum(c / 20 * math.log2(c / 20) for c in Counter(s).values())

    for k, s in enumerate(strings):
        assert abs(got[k] - max(bits(s[i:i + 20]) for i in range(len(s) - 19))) < 1e-9


def test_secrets_empty(empty):
    from bagframe.llm.secrets import secret_digest

    assert secret_digest(empty).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------------

def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the limit, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_mix(messy, rows):
    from bagframe.llm.mixing import mix_taken

    size = lambda t: len(brute.SPACED.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    got = mix_taken(messy).collect()
    assert bag((r.doc_id, r.size) for r in got) == bag((r[0], size(r[1])) for r in rows)
    assert bag((r.source_size, round(r.target, 6)) for r in got) == bag((sizes[r[3]], round(want[r[3]], 6)) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    per = Counter()
    for r in got:
        per[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= 0.5 for (_, t), n in per.items())
    assert bag(got) == bag(mix_taken(messy.repartition(5)).collect())


def test_mix_schedule_is_even(spark):
    from bagframe.llm.mixing import schedule

    slots = [500, 300, 150, 49, 1]
    got = schedule(spark.createDataFrame(list(enumerate(slots)), "source_no int, slots long"), sum(slots)).orderBy("slot").collect()
    assert Counter(r.source_no for r in got) == Counter({k: n for k, n in enumerate(slots)})
    seen = Counter()
    for t, r in enumerate(got):
        assert r["rank"] == seen[r.source_no]
        seen[r.source_no] += 1
        assert all(abs(seen[k] - (t + 1) * n / sum(slots)) < 12 for k, n in enumerate(slots))      # O(log n) discrepancy


def test_mixed_documents(messy, empty, rows):
    from bagframe.llm.mixing import mix_taken, mixed_documents

    out = mixed_documents(messy)
    assert out.columns == messy.columns
    copies = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    known = Counter((r[0], r[1], r[3]) for r in rows)
    assert set(copies) <= set(known) and all(n <= 3 * known[k] for k, n in copies.items())
    assert mixed_documents(empty).count() == 0 and mix_taken(empty).count() == 0


# --- 8 -------------------------------------------------------------------------------------------------------------------

def test_quality(messy, rows, empty):
    from bagframe.llm.quality import cascade

    got = cascade(messy, measures=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert bag(got) == bag(brute.quality(pairs(rows)))
    assert cascade(empty).count() == 0


def test_quality_order_changes_nothing(messy):
    from bagframe.llm.quality import RULES, cascade, planned

    assert {r.name for r in planned(messy)} == {r.name for r in RULES}
    results = [bag(cascade(messy, order=list(order)).select("doc_id", "kept").collect()) for order in (RULES, RULES[::-1])]
    assert results[0] == results[1]


# --- 9 -------------------------------------------------------------------------------------------------------------------

def test_crf_marginals_against_all_paths():
    from bagframe.llm.language import Crf

    rng = np.random.default_rng(6)
    crf = Crf(["a", "b", "c"], np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    size = np.array([4, 1, 5])
    first = np.cumsum(size) - size
    emission = rng.normal(size=(int(size.sum()), 3)).astype(np.float32)
    m, expected = crf.marginals(emission, first, size, pairs=True)
    moves = np.zeros((3, 3))
    for f, n in zip(first, size):
        total, per = 0.0, np.zeros((n, 3))
        own = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = crf.start[path[0]] + sum(emission[f + t, y] for t, y in enumerate(path)) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:]))
            p = math.exp(s)
            total += p
            for t, y in enumerate(path):
                per[t, y] += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        assert np.allclose(m[f: f + n], per / total, atol=1e-5)
        moves += own / total
    assert np.allclose(expected, moves, atol=1e-4)


def test_language_held_out_and_switching(spark, sf):
    from bagframe.llm.language import fit, label_texts, predict
    from bagframe.llm.queries import _remainder, importable

    importable(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crf = fit(docs.where(_remainder(4) != 2), per_label=60)
    held = docs.where(_remainder(4) == 2)
    got = {r.doc_id: r for r in predict(held, crf).collect()}
    rows = held.collect()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    by = {y: next(r.text for r in rows if r.lang == y and r.n_chars > 900) for y in ("en", "fr")}
    mixed = " ".join(by["en"].split()[:30] + by["fr"].split()[:30])
    _, _, m, w = label_texts(pa.array([mixed]), crf)
    best = [crf.labels[k] for k in m.argmax(1)]
    assert len(best) >= 55 and sum(y == "en" for y in best[:28]) >= 24 and sum(y == "fr" for y in best[-28:]) >= 24


def test_language_messy(messy, empty, rows):
    from bagframe.llm.language import fit, predict, recognised

    crf = fit(messy)
    got = predict(messy, crf).collect()
    assert bag((r.doc_id,) for r in got) == bag((r[0],) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "es", "und", "") for r in got)
    letters = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert recognised(messy, crf).columns == messy.columns
    none = fit(empty)
    assert predict(empty, none).count() == 0 and {r.lang_pred for r in predict(messy, none).collect()} == {"und"} and recognised(messy, none).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------

def test_near_classes(messy, rows, empty):
    from bagframe.llm.jaccard_join import near_classes

    want = brute.near_classes(pairs(rows))
    for shingles in (100_000, 300):
        assert bag(near_classes(messy, group_shingles=shingles).collect()) == bag(want)
    assert near_classes(empty).count() == 0


def test_near_classes_random_families(spark):
    """Families with edits around the threshold, sets of all small sizes, passages that unrelated texts share."""
    from bagframe.llm.jaccard_join import near_classes

    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = []
    for family in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 5, 8, 9, 10, 11, 12, 14, 18, 25, 40, 90]))]
        for _ in range(rng.choice([1, 2, 3, 8])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                copy[at: at + rng.randrange(2)] = [f"n{rng.randrange(10 ** 6)}"] * rng.randrange(2)
            docs.append((len(docs), " ".join(copy) + (" " + passage if rng.random() < 0.3 else "")))
    got = near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), group_shingles=200).collect()
    assert bag(got) == bag(brute.near_classes(docs))


def test_classes_share_a_token_at_the_threshold():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from bagframe.llm.jaccard_join import Classes, set_ids

    classes = Classes(Fraction(85, 100))

    @settings(max_examples=300, deadline=None)
    @given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2 ** 32))
    def check(common, only_a, only_b, seed):
        if 100 * common < 85 * (common + only_a + only_b) or only_a + only_b == 0:
            return
        h = np.random.default_rng(seed).integers(0, 1 << 63, common + only_a + only_b).astype(np.uint64)
        a, b = h[: common + only_a], np.concatenate([h[:common], h[common + only_a:]])
        text = np.repeat([0, 1], [len(a), len(b)])
        both = np.concatenate([a, b])
        size, sid = set_ids(text, both, 2)
        token, owner = classes.tokens(text, both, size, sid)
        assert set(token[owner == sid[0]].tolist()) & set(token[owner == sid[1]].tolist())

    check()


def test_one_of_each(messy, rows, empty):
    from bagframe.llm.jaccard_join import one_of_each

    kept = one_of_each(messy)
    assert kept.columns == messy.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    sets = [brute.shingles(t) for _, t in got]
    assert Counter(i for (i, _), s in zip(got, sets) if not s) == Counter(i for i, t in pairs(rows) if not brute.shingles(t))
    some = [s for s in sets if s]
    assert len(some) == len(set(some))
    full = [s for s in {brute.shingles(t) for _, t in pairs(rows)} if s]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    # every text is linked, through others, with one that stays, and no two that stay are linked
    reach = set(some)
    while True:
        more = {s for s in full if s not in reach and any(jaccard(s, x) >= 0.85 for x in reach)}
        if not more:
            break
        reach |= more
    assert reach == set(full) and all(jaccard(a, b) < 0.85 for a, b in itertools.combinations(some, 2))
    assert one_of_each(empty).count() == 0


def test_components_of_a_long_chain(spark):
    from bagframe.llm.components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
