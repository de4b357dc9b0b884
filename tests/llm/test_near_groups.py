"""Groups of near copies: the bound on shared tokens, null and repeated ids, groups that many sets ask."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
from llm_tables import bench_rows, benchmark, empty, messy, rows  # noqa: F401  (fixtures)


def test_partners_share_as_many_tokens_as_said():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from bagframe.llm.jaccard_join import Classes, set_ids

    classes = Classes(Fraction(8, 10))

    @settings(max_examples=300, deadline=None)
    @given(st.integers(1, 900), st.integers(0, 120), st.integers(0, 120), st.integers(0, 2 ** 32))
    def check(common, only_a, only_b, seed):
        if 100 * common < 80 * (common + only_a + only_b) or only_a + only_b == 0:
            return
        h = np.random.default_rng(seed).integers(0, 1 << 63, common + only_a + only_b).astype(np.uint64)
        both = np.concatenate([h[: common + only_a], h[:common], h[common + only_a:]])
        text = np.repeat([0, 1], [common + only_a, common + only_b])
        size, sid = set_ids(text, both, 2)
        token, owner, least = classes.bounded_tokens(text, both, size, sid)
        shared = set(token[owner == sid[0]].tolist()) & set(token[owner == sid[1]].tolist())
        for who in sid:
            mine = np.isin(token, list(shared)) & (owner == who)
            assert mine.sum() >= least[mine].min()

    check()


def _families(n_null: int):
    rng = random.Random(4)
    docs = []
    for family, size in enumerate((60, 25, 9, 4, 2, 1, 1)):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
            docs.append((None if len(docs) % n_null == 0 else len(docs), " ".join(copy)))
    return docs + [(7, docs[3][1])] * 20 + [(None, docs[5][1])] * 20 + [(8, docs[i][1]) for i in range(70, 80)]


def test_null_and_repeated_ids_and_split_groups(spark):
    from bagframe.llm.jaccard_join import near_classes
    from bagframe.llm.queries import importable

    importable(spark)
    docs = _families(3)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = Counter(brute.near_classes(docs))
    for shingles in (10, 700, 400_000):
        assert Counter(tuple(r) for r in near_classes(table, group_shingles=shingles).collect()) == want


def test_a_pair_meets_in_one_task(spark):
    """Sets that share tokens across groups: every such pair meets once, and sets without a common token do not travel."""
    from bagframe.llm.jaccard_join import groups, openings

    rng = random.Random(9)
    shared = [(t, s, 1) for s in range(40) for t in rng.sample(range(s // 20 * 100, s // 20 * 100 + 12), 6)]
    frame = spark.createDataFrame(shared, "token long, sid long, least int")
    sizes = spark.createDataFrame([(s, 10) for s in range(40)], "sid long, n_shingles long")
    nodes, matrix = groups(frame, sizes, 40)
    meetings = openings(frame, nodes, matrix, 10).collect()
    tasks, tokens = defaultdict(lambda: ([], [])), defaultdict(set)
    for t, s, _ in shared:
        tokens[s].add(t)
    for r in meetings:
        tasks[(r.g, r.chunk)][0 if r.member else 1].append(r.sid)
    met = Counter()
    for (_, chunk), (members, asking) in tasks.items():
        if chunk == 0:
            met.update(frozenset((a, b)) for i, a in enumerate(members) for b in members[:i])
        met.update(frozenset((a, b)) for a in members for b in asking)
        union = set().union(*[tokens[s] for s in members])
        assert all(tokens[s] & union for s in asking)
    assert set(met.values()) == {1}
    assert {frozenset((a, b)) for a in range(40) for b in range(a) if tokens[a] & tokens[b]} <= set(met)
    assert max(c for _, c in tasks) > 0
