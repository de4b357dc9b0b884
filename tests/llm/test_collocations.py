"""Collocations against brute force, with budgets that leave every prefix whole and budgets that split all of them."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import low
from llm_tables import bench_rows, benchmark, empty, messy, rows  # noqa: F401  (fixtures)


def _brute(rows, most, least, inside=80):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i: i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i: i + n]] = max(longer[p[i: i + n]], a)
        listed = []
        for p, a in found.items():
            if 100 * longer[p] < inside * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("budget,most,least", [(10, 2000, 2), (300, 7, 2), (1_000_000, 2000, 3), (40, 5, 5)])
def test_against_brute_force(messy, rows, budget, most, least):
    from bagframe.llm.collocations import collocations

    more = [(50, "a b c d, a b c d; A B\tC e\nx y. x y! x y: x y? x y", "en"), (51, "a b c d", None), (52, "a b c d a b c d a b", "und"), (53, "z " * 500, "zz")]
    table = messy.select("doc_id", "text", "lang").unionByName(messy.sparkSession.createDataFrame(more, "doc_id long, text string, lang string"))
    assert sorted(tuple(r) for r in collocations(table, most, least, budget=budget).collect()) == _brute([*rows, *more], most, least)


def test_hot_prefixes_are_split_to_the_budget(spark, messy):
    from bagframe.llm.collocations import dealt_suffixes, vertical_partition, word_table

    found = word_table(messy)
    total = found.groupBy().sum("f").first()[0]
    prefixes = vertical_partition(messy, found, total, 200)
    assert [len(k) > 0 for k in prefixes.keys] == [True, True, True]
    sizes = dealt_suffixes(messy, prefixes).selectExpr("group", "size(n) as kinds", "aggregate(n, 0L, (a, x) -> a + x) as n").groupBy("group").sum("kinds", "n").collect()
    assert sum(r["sum(n)"] for r in sizes) == total and len(sizes) > 5
    assert max(r["sum(kinds)"] for r in sizes) <= 2 * 200 + 200


def test_exact_beyond_64_bits(spark):
    """A count for which 2000000 a passes a long."""
    from bagframe.llm.collocations import scored

    schema = "lang string, h1 long, h2 long, h3 long, h4 long, m long, a long, l1 long, l2 long, l3 long"
    a, left, right = 9_007_199_254_740_993, 9_007_199_254_740_995, 36_028_797_018_963_969
    found = spark.createDataFrame([("en", 5, 6, 0, 0, 2, a, left, 0, 0), ("en", 5, 6, 7, 0, 3, a * 80 // 100 + 1, left, a, 0)], schema)
    counts = spark.createDataFrame([(5, left), (6, right), (7, a)], "h long, f long")
    got = {r.m: (r.l, r.r, r.score) for r in scored(found, counts).collect()}
    assert set(got) == {3}                              # the shorter one lies inside with 80 percent
    alone = scored(found.where("m = 2"), counts).collect()
    assert [(r.l, r.r, r.score) for r in alone] == [(left, right, 2_000_000 * a // (left + right))]


def test_suffixes_stop_at_the_end_of_a_piece():
    from bagframe.llm.collocations import suffixes

    s = suffixes(np.arange(1, 6, dtype=np.uint64), np.array([0, 0, 0, 1, 1]))
    assert s.T.tolist() == [[1, 2, 3, 0], [2, 3, 0, 0], [3, 0, 0, 0], [4, 5, 0, 0], [5, 0, 0, 0]]


def test_tables_without_phrases(spark, empty):
    from bagframe.llm.collocations import collocations

    for table in (empty, spark.createDataFrame([(None, None), ("...", "en"), ("one", "en")], "text string, lang string")):
        found = collocations(table, least=1)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == 0
