"""The pipeline's stages one after another on tables that the driver's are not: messy, without labels, empty, with odd column names."""

import brute
import pytest
from llm_tables import bench_rows, benchmark, empty, messy, rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _through(spark, docs):
    import corpus_pipeline as cp
    from bagframe.llm import store

    out = [docs]
    for _, stage in cp.STAGES[:-1]:
        out.append(store.written(stage(spark, out[-1], SF), "pipeline-tables"))
        assert out[-1].columns == docs.columns
    return out, cp.STAGES[-1][1](spark, out[-1], SF)


def test_messy_table_with_a_dotted_column(spark, messy, rows):
    docs = messy.withColumn("a.b", F.col("doc_id")).withColumn("told", F.lit("x")).withColumn("g", F.lit(1))
    out, ids = _through(spark, docs)
    kept = [{(r.doc_id, r.text) for r in d.collect()} for d in out]
    assert all(b <= a for a, b in zip(kept, kept[1:])) and len(kept[1]) > 20
    texts = [brute.shingles(t, 5) for _, t in kept[2]]
    assert len([s for s in texts if s]) == len({s for s in texts if s})
    last = out[-1].collect()
    assert all(r["a.b"] == r.doc_id and r["told"] == "x" for r in last)
    found = ids.collect()
    assert len(found) == len(last) and sum(r.n_tokens for r in found) == max(r.start + r.n_tokens for r in found)


@pytest.mark.parametrize("kind", ["empty", "unlabelled"])
def test_nothing_to_learn_from_leaves_nothing(spark, empty, messy, kind):
    """Without a labelled document no language is known, so every document is rejected and the later stages run on no rows."""
    docs = empty if kind == "empty" else messy.withColumn("lang", F.lit(None).cast("string"))
    out, ids = _through(spark, docs)
    assert [d.count() for d in out[1:]] == [0, 0, 0, 0] and ids.count() == 0
