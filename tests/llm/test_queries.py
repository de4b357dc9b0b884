"""The registered queries against DuckDB where SQL can say it, the others against brute force or their bounds; the pipeline end to end."""

import zlib

import brute
import numpy as np
import oracle_check as oc
import pytest

from bagframe.llm.oracles import SQL
from bagframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    ok, text = oc.compare(spark, oc.connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, text


def test_queries_and_pipeline():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_language_model_beats_unigram(spark):
    got = QUERIES["op1_context_mixing"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_licenses_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op4_license_spans"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(brute.license_base(docs))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_token_query(spark):
    from tokenizers import Tokenizer

    from bagframe.llm.queries import vocabulary

    tokenizer, at = Tokenizer.from_file(vocabulary()), 0
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r, (i, text) in zip(sorted(QUERIES["op3_token_shards"](spark, SF).collect()), docs, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline(spark):
    """Each stage against what brute force keeps of its own input."""
    import corpus_pipeline as cp
    from bagframe.llm import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(store.written(stage(spark, out[-1], SF), "pipeline-test"))
        if stage is not cp.STAGES[-1][1]:
            assert out[-1].columns == docs.columns
    assert rows(out[1]) == rows(docs.where("text rlike '[a-zA-Z]'"))
    assert rows(out[2]) == [r for r, c in zip(rows(out[1]), brute.near_classes(rows(out[1]))) if r[0] == c[2]]
    assert rows(out[3]) == [r for r, c in zip(rows(out[2]), brute.contamination(rows(out[2]), bench)) if not c[5]]
    mixed = rows(out[4])
    assert set(mixed) <= set(rows(out[3])) and all(mixed.count(r) <= 3 for r in set(mixed))
    words = lambda rs: sum(len(brute.SPACED.findall(t or "")) for _, t in rs)
    assert abs(words(mixed) - words(rows(out[3]))) < 0.2 * words(rows(out[3]))
    assert [r.doc_id for r in out[5].orderBy("start").collect()] == [i for i, _ in mixed]
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, out[5].collect()))
