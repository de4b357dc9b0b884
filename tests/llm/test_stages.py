"""What the stages of the pipeline keep, and the samples they learn from, on rows the test tables do not have."""

import random

import brute
import pyarrow as pa
import pytest


def near_firsts(docs, size=5, percent=80):
    """Ids that stay of (doc_id, text): the smallest of each class."""
    sets = [brute.shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    kept = {}
    for k, (i, _) in enumerate(docs):
        kept[find(k)] = min(i, kept.get(find(k), i))
    return sorted(kept.values())


def test_near_copy_stage_takes_five_words_and_four_fifths(spark):
    from corpus_pipeline import near_copies

    word = lambda k: f"w{k}"
    grown = [word(k) for k in range(126)]
    spread = [word(1000 + k) for k in range(186)]
    edited = [f"x{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(spread)]
    docs = [(1, " ".join(grown[:104])), (2, " ".join(grown)), (3, " ".join(spread)), (4, " ".join(edited))]
    rng = random.Random(5)
    for family in range(30):
        base = [f"f{rng.randrange(3000)}" for _ in range(rng.choice([4, 5, 6, 9, 14, 25, 60, 120]))]
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"f{rng.randrange(3000)}"
            docs.append((len(docs) + 1, " ".join(text + [f"e{rng.randrange(3000)}" for _ in range(rng.randrange(1 + len(base) // 3))])))
    got = near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    want = near_firsts(docs)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert {2, 4}.isdisjoint(want) and {2, 4} <= set(near_firsts(docs, 4, 85))


def test_labelled_sample_with_more_null_ids_than_its_size(spark):
    from bagframe.llm.language import labelled_sample

    rows = [(i if i % 3 else None, f"text {i}", "en" if i % 2 else "de") for i in range(120)]
    rows += [(None, "a copy", "en")] * 60
    got = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=10)
    assert len(got) == len(set(got)) == 20 and set(got) <= {(t, y) for _, t, y in rows}
    assert all(5 <= sum(y == label for _, y in got) <= 15 for label in ("en", "de"))
    null = {t for i, t, _ in rows if i is None}
    assert any(t in null for t, _ in got) and any(t not in null for t, _ in got)


def test_labelled_keys_go_into_few_files(spark, monkeypatch):
    from bagframe.llm import language

    kept, write = [], language.store.written
    monkeypatch.setattr(language.store, "written", lambda *a: kept.append(write(*a)) or kept[-1])
    rows = [(i, f"{word} text of number {i}", y) for i in range(100) for y, word in (("en", "the"), ("de", "der"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        assert language.fit(docs, per_label=20, epochs=1).labels == ["de", "en"]
    finally:
        spark.conf.unset(coalesce)
    assert [(k.count(), len(k.inputFiles())) for k in kept] == [(200, 1)]


def test_recognised_keeps_even_mixes(spark, sf):
    from bagframe.llm.language import fit, predict, recognised
    from bagframe.llm.queries import importable

    importable(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crf = fit(docs, per_label=60)
    long = {r.lang: r.text.split() for r in docs.where("n_chars > 900").orderBy("doc_id").collect()}
    odd = "qzx xqv 1a"                                        # a few words of no language between the parts
    mixes = [(1, ("en", "fr"), ""), (2, ("de", "es"), odd), (3, ("en", "de", "fr"), ""), (4, ("es", "fr", "de"), odd), (5, ("en", "de", "es", "fr"), "")]
    rows = [(i, f" {between} ".join(" ".join(long[y][:40]) for y in langs)) for i, langs, between in mixes]
    mixed = spark.createDataFrame([*rows, (6, "12 34"), (7, None)], "doc_id long, text string")
    assert min(r.score for r in predict(mixed, crf).collect() if r.doc_id in (3, 4, 5)) < 0.5
    assert sorted(r.doc_id for r in recognised(mixed, crf).collect()) == [1, 2, 3, 4, 5]


def test_labelling_a_large_batch_in_little_memory():
    import tracemalloc

    from bagframe.llm.language import Crf, labelled

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(3000)] + [None, ""]      # 5.8 MB
    batch = pa.RecordBatch.from_pydict({"body": texts})
    tracemalloc.start()
    try:
        sizes = [(piece.num_rows, len(label), len(score), len(m) == len(w.start)) for piece, label, score, m, w in labelled(iter([batch]), Crf.empty(["de", "en", "fr"]), "body")]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, *_ in sizes) == len(texts) and all(n == a == b and same for n, a, b, same in sizes)
    assert peak < 80e6                                          # 123 MB with pieces of 4 MB


def test_proximity_over_inserted_and_unknown_words(spark):
    from bagframe.llm.decontaminate import contamination

    item = "aa bb cc dd ee ff gg hh ii jj"
    fill = " ".join(w for w in item.split() if w not in ("cc", "gg"))              # the anchors are the rarest: cc and gg
    docs = [(1, item.replace("ee", "ee new")), (2, item.replace("ii", "other")), *[(k, fill) for k in range(10, 14)]]
    known = {r.doc_id: r for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                                spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert known[1].near_share == 1.0 and known[2].near_share == 0.9 and not known[1].contaminated and not known[2].contaminated
    alone = contamination(spark.createDataFrame([docs[1], (3, "nothing of it")], "doc_id long, text string"),
                          spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.near_share for r in alone.collect()} == {2: 0.9, 3: None}      # no text has the tenth word
