"""Smoothed unigram score of every text, by counts over all training texts, without a table of words in any task.

A batch of texts becomes a piece: its distinct words in order of their hashes, cut into buckets (ranges of hashes), and which texts
hold them how often. Pieces are written once. Words with their counts meet by bucket, where each word's total is known, and every
piece gets its words' totals back, in its own order. So what travels is a number per piece and distinct word, never a row per
document and word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.words import SPACE, buffers, ordered, words

#: The end of a text is a token of its own.
END = np.uint64(0xE7D0E7D0E7D0E7D1)
PIECE = 8 << 20


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of a text's content: with the id they name a row, and rows equal in both have equal scores."""
    raw = memoryview(np.ascontiguousarray(data))
    out = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(offsets[:-1], offsets[1:]))
    return np.frombuffer(out, "<i8")


@dataclass(frozen=True)
class Unigram:
    """sums: (doc_id, digest, partial, known), one row per text; tokens, kinds: N and V; byte_counts: of lower-cased training bytes, the
    end last."""

    sums: DataFrame
    tokens: int
    kinds: int
    byte_counts: np.ndarray

    def score(self, partial: Column, n_tokens: Column) -> Column:
        """Sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over a text's tokens."""
        return partial - n_tokens * F.lit(float(np.log10(self.tokens + 0.1 * (self.kinds + 1))))


def rows_of(docs: DataFrame, training: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))


def _pieces(docs: DataFrame, training: Column, buckets: int, files: int) -> DataFrame:
    """Per piece and bucket: hashes of the words, their training counts, how many texts hold each, which texts, how often. A row with
    bucket -1 per piece has ids, digests and the byte counts instead."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = uuid.uuid4().int >> 65              # pieces are numbered once: only the attempt whose files are committed counts
        for piece in store.pieces(batches, most=PIECE):
            w = words(piece.column("text"), SPACE, lower=True)
            n = piece.num_rows
            train = piece.column("train").to_numpy(zero_copy_only=False)
            byte_counts = np.zeros(257, np.int64)
            at = w.offsets
            for i in np.flatnonzero(train):
                byte_counts[:256] += np.bincount(w.data[at[i]: at[i + 1]], minlength=256)
            byte_counts[256] = int(train.sum())
            h, text = np.concatenate([w.hash, np.full(n, END)]), np.concatenate([w.text, np.arange(n)])
            order = ordered(h)                                            # equal words stay in text order
            h, text = h.take(order), text.take(order)
            pair = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (text[1:] != text[:-1])) + 1])
            times = np.diff(np.append(pair, len(h))).astype(np.uint32)
            h, text = h[pair], text[pair].astype(np.uint32)
            kind = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            texts_of = np.diff(np.append(kind, len(h))).astype(np.uint32)
            learned = np.add.reduceat(times * train[text], kind).astype(np.uint32)
            u = h[kind]
            bucket = ((u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(u))
            wide = np.append(kind[cut[:-1]], len(h))
            part = lambda x, c: [x[a:b].tobytes() for a, b in zip(c[:-1], c[1:])]
            ids = piece.column("doc_id")
            valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            own = {"hashes": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "learned": valid.tobytes(),
                   "texts_of": digests(*buffers(piece.column("text"))).tobytes(), "text": byte_counts.tobytes(), "times": b""}
            columns = {"hashes": part(u, cut), "learned": part(learned, cut), "texts_of": part(texts_of, cut), "text": part(text, wide), "times": part(times, wide)}
            m = len(cut)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(np.full(m, number)), "bucket": pa.array([-1, *bucket[cut[:-1]].tolist()], pa.int32())}
                                             | {c: pa.array([own[c], *v], pa.binary()) for c, v in columns.items()})
            number += 1

    schema = "piece long, bucket int, hashes binary, learned binary, texts_of binary, text binary, times binary"
    return store.written(rows_of(docs, training).mapInArrow(scan, schema), "unigram-pieces", files=files)


def _totals(found: pa.Table) -> pa.Table:
    """Of one bucket: to each piece the totals of its words; with the first, the numbers of tokens and of words that training has."""
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("hashes").combine_chunks()]
    u, where = np.unique(np.concatenate(hashes), return_inverse=True)
    learned = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in found.column("learned").combine_chunks()])
    total = np.bincount(where, weights=learned, minlength=len(u)).astype(np.int64)
    back = np.split(total[where], np.cumsum([len(h) for h in hashes])[:-1])
    first = np.arange(len(hashes)) == 0
    return pa.table({"piece": found.column("piece"), "bucket": found.column("bucket"), "totals": pa.array([b.astype("<i8").tobytes() for b in back], pa.binary()),
                     "tokens": pa.array(np.where(first, total.sum(), 0)), "kinds": pa.array(np.where(first, (total > 0).sum(), 0))})


def _scores(found: pa.Table) -> pa.Table:
    """Of one piece: the sums of its texts."""
    rows = found.to_pylist()
    totals = {r["bucket"]: r["totals"] for r in rows if r["totals"] is not None}
    parts = [r for r in rows if r["totals"] is None]
    own = next(r for r in parts if r["bucket"] == -1)
    ids, valid, digest = np.frombuffer(own["hashes"], "<i8"), np.frombuffer(own["learned"], np.uint8).astype(bool), np.frombuffer(own["texts_of"], "<i8")
    partial, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for r in parts:
        if r["bucket"] >= 0:
            c = np.repeat(np.frombuffer(totals[r["bucket"]], "<i8"), np.frombuffer(r["texts_of"], np.uint32))
            text, times = np.frombuffer(r["text"], np.uint32), np.frombuffer(r["times"], np.uint32)
            partial += np.bincount(text, weights=times * np.log10(c + 0.1), minlength=len(ids))
            known += np.bincount(text, weights=times * (c > 0), minlength=len(ids)).astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, mask=~valid), "digest": pa.array(digest), "partial": pa.array(partial), "known": pa.array(known)})


def count(docs: DataFrame, training: Column, chars: int) -> Unigram:
    """Counts over the rows of docs (doc_id, text) where `training` holds, and sums for all rows. A null text is empty. `chars`, the
    size of all texts, sets the number of buckets (about 8 MB of text each) and keeps tiny input files together."""
    pieces = _pieces(docs, training, max(32, chars // 8_000_000), 1 + chars // 4_000_000)
    by_bucket = pieces.where("bucket >= 0").select("piece", "bucket", "hashes", "learned")
    totals = store.written(by_bucket.groupBy("bucket").applyInArrow(_totals, "piece long, bucket int, totals binary, tokens long, kinds long"), "unigram-totals")
    numbers = totals.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    # 257 numbers per piece, added up in parallel
    counts = pieces.where("bucket = -1").select("text").mapInArrow(_added, "counts binary").repartition(1).mapInArrow(_added_again, "counts binary").collect()
    byte_counts = np.frombuffer(counts[0]["counts"], np.int64) if counts else np.zeros(257, np.int64)
    none = F.lit(None).cast("binary")
    both = pieces.select("piece", "bucket", F.when(F.col("bucket") == -1, F.col("hashes")).alias("hashes"),
                         F.when(F.col("bucket") == -1, F.col("learned")).alias("learned"), "texts_of", "text", "times", none.alias("totals"))
    both = both.unionByName(totals.select("piece", "bucket", *[none.alias(c) for c in ("hashes", "learned", "texts_of", "text", "times")], "totals"))
    sums = both.groupBy("piece").applyInArrow(_scores, "doc_id long, digest long, partial double, known long")
    return Unigram(sums, int(numbers["tokens"] or 0), int(numbers["kinds"] or 0), byte_counts)


def _sum_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    total, some = np.zeros(257, np.int64), False
    for batch in batches:
        for x in batch.column(column):
            total += np.frombuffer(x.as_buffer(), np.int64)
            some = True
    if some:
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sum_of(batches, "text")


def _added_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sum_of(batches, "counts")
