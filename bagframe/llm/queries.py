"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagframe.llm.oracles import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(SQL)


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Python workers of a session started outside the checkout find this package; a cluster gets it as a dependency."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, _ROOT] if p)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in binary shards, read back through the perfect hash index."""
    from bagframe.llm.token_shards import token_digest

    return token_digest(table(spark, sf_dir, "documents"), vocabulary())


@query
def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rule cascade on every document, with all measures."""
    from bagframe.llm.quality import cascade

    found = cascade(table(spark, sf_dir, "documents"), measures=True)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines held by three documents or more stay only in the largest of them."""
    from bagframe.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from bagframe.llm.mixing import mix_taken

    return mix_taken(table(spark, sf_dir, "documents"))


@query
def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a ten-word window of a benchmark item."""
    from bagframe.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row", "near_share")


@query
def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by pattern and by entropy."""
    from bagframe.llm.secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


@query
def op4_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    from bagframe.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _remainder(divisor: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


@query
def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    from bagframe.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents")
    held = _remainder(4) == 2
    return predict(docs, fit(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op10_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents that near copies link, four-word shingles, Jaccard 0.85 or more."""
    from bagframe.llm.jaccard_join import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents by mixed bit predictors, learned from nine tenths of them."""
    from bagframe.llm.context_mixing import score_texts

    return score_texts(table(spark, sf_dir, "documents"), _remainder(10) != 0)


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on their 32 leading components, to variance one."""
    from bagframe.llm.whitening import whitened_components

    return whitened_components(table(spark, sf_dir, "embeddings"))


@query
def op12_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by their sentences, learned from four fifths of the labels."""
    from bagframe.llm.toxicity import toxic_scores

    held = _remainder(5) == 0
    found = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "n_sentences", "n_offending", "worst")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language, over all documents."""
    from bagframe.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
