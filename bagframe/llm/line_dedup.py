"""Line deduplication that can be taken back: exact reference counts, and sharded cuckoo filters in front of them.

State, all in tables of the shared folder, a new generation per change:

* ``refs``    one row per (line key, document) with the number of lines; the ground truth
* ``counts``  one row per line key: number of documents, largest document
* ``filters`` one row per shard of keys: a cuckoo filter of the keys held by `min_docs` documents or more

Inserting documents adds references and puts keys that reach the limit into their shard's filter; deleting documents removes
references and takes keys that fall below it out again. A lookup asks the filters first, and only keys that pass meet the
exact counts, so false positives never show.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.cuckoo import CuckooFilter
from bagframe.llm.words import LOWER, buffers, code_points, lines, stripped

KEY = ["hi", "lo"]


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """(lines, rows of long keys, their keys as pairs of int64): stripped, A-Z lower-cased, at least min_chars long."""
    found = lines(data, offsets)
    a, b = stripped(data, found.start, found.end)
    points = code_points(data)
    long = np.flatnonzero(points[b] - points[a] >= min_chars)
    low = LOWER[data].tobytes()
    digests = b"".join(hashlib.blake2b(low[a[i]: b[i]], digest_size=16).digest() for i in long)
    return found, long, np.frombuffer(digests, "<i8").reshape(-1, 2)


def references(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """(hi, lo, doc_id, n) of every long line key of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches):
            data, offsets = buffers(piece.column("text"))
            found, long, keys = line_keys(data, offsets, min_chars)
            if len(long):
                ids = piece.column("doc_id").take(pa.array(found.text[long]))
                yield pa.RecordBatch.from_pydict({"hi": pa.array(keys[:, 0]), "lo": pa.array(keys[:, 1]), "doc_id": ids})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(scan, "hi long, lo long, doc_id long").groupBy(*KEY, "doc_id").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class LineIndex:
    """A generation of the state. Operations return a new one and leave the old one readable.

    Rows with a null document id hold no keys and are never changed; rows that repeat an id are one document. A null text
    is one empty line. Extra columns are not read.
    """

    spark: SparkSession
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int = 3
    min_chars: int = 20
    shards: int = 64
    key: str = "doc_id"
    text: str = "text"

    @classmethod
    def empty(cls, spark: SparkSession, **settings) -> LineIndex:
        return cls(spark, spark.createDataFrame([], "hi long, lo long, doc_id long, n long"),
                   spark.createDataFrame([], "hi long, lo long, n_docs long, max_doc long"),
                   spark.createDataFrame([], "shard int, filter binary"), **settings)

    def _shard(self):
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int")

    def _counted(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))

    def _filtered(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Filters after the keys of `old` counts that no longer reach the limit went and those of `new` came."""
        limit = self.min_docs
        full = lambda c: c.where(F.col("n_docs") >= limit).select(*KEY)
        came = full(new).join(full(old), KEY, "left_anti").withColumn("came", F.lit(True))
        gone = full(old).join(full(new), KEY, "left_anti").withColumn("came", F.lit(False))
        changes = came.unionByName(gone).withColumn("shard", self._shard())
        kept = full(new).withColumn("shard", self._shard()).groupBy("shard").agg(F.count(F.lit(1)).alias("total"))
        state = kept.join(self.filters, "shard", "full_outer")

        def change(state: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            shard = int((state if len(state) else changes)["shard"].iloc[0])
            blob = state["filter"].iloc[0] if len(state) else None
            total = int(state["total"].fillna(0).iloc[0]) if len(state) else 0
            keys = (changes["hi"].to_numpy(np.int64) ^ (changes["lo"].to_numpy(np.int64) << 1)).view(np.uint64)
            came = changes["came"].to_numpy(bool)
            table = CuckooFilter.for_keys(total) if blob is None else CuckooFilter.from_bytes(bytes(blob))
            table.delete(keys[~came])
            if not table.insert(keys[came]):
                return pd.DataFrame({"shard": [shard], "filter": [None]}).astype({"shard": "int32"})
            return pd.DataFrame({"shard": [shard], "filter": [table.to_bytes()]}).astype({"shard": "int32"})

        made = store.written(state.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, "shard int, filter binary"),
                             "line-filters")
        full_shards = made.where("filter is null").select("shard")
        if full_shards.isEmpty():
            return made
        # a filter ran full: build these shards anew, twice as large, from the exact counts
        again = full(new).withColumn("shard", self._shard()).join(full_shards, "shard", "left_semi")

        def rebuild(keys: pd.DataFrame) -> pd.DataFrame:
            k, room = (keys["hi"].to_numpy(np.int64) ^ (keys["lo"].to_numpy(np.int64) << 1)).view(np.uint64), 2 * len(keys)
            while not (table := CuckooFilter.for_keys(room)).insert(k):
                room *= 2
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "filter": [table.to_bytes()]}).astype({"shard": "int32"})

        return store.written(made.where("filter is not null").unionByName(again.groupBy("shard").applyInPandas(rebuild, "shard int, filter binary")),
                             "line-filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents whose ids are not in the index yet."""
        new = store.written(references(docs, self.min_chars, self.key, self.text), "line-refs")
        if not new.join(self.refs.select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("a document is already in the index; delete it first")
        counts = self.counts.unionByName(self._counted(new)).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        counts = store.written(counts, "line-counts")
        return replace(self, refs=self.refs.unionByName(new), counts=counts, filters=self._filtered(self.counts, counts))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Remove documents by id; counts, largest holders and filters become what they would be without them."""
        ids = ids.select(F.col(self.key).cast("long").alias("doc_id"))
        refs = store.written(self.refs.join(ids, "doc_id", "left_anti"), "line-refs")
        touched = self.refs.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        counts = self.counts.join(touched, KEY, "left_anti").unionByName(self._counted(refs.join(touched, KEY, "left_semi")))
        counts = store.written(counts, "line-counts")
        return replace(self, refs=refs, counts=counts, filters=self._filtered(self.counts, counts))

    def repeated(self, keys: DataFrame) -> DataFrame:
        """(hi, lo, max_doc) of those keys that reach the limit: filter first, then the exact counts."""
        asked = keys.select(*KEY).distinct().withColumn("shard", self._shard())

        def ask(keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if not len(keys) or not len(state):
                return keys[KEY].iloc[:0]
            k = (keys["hi"].to_numpy(np.int64) ^ (keys["lo"].to_numpy(np.int64) << 1)).view(np.uint64)
            return keys.loc[CuckooFilter.from_bytes(bytes(state["filter"].iloc[0])).contains(k), KEY]

        passed = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(ask, "hi long, lo long")
        exact = self.counts.where(F.col("n_docs") >= self.min_docs)
        return store.written(passed.join(exact, KEY).select(*KEY, "max_doc"), "line-repeated")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped) of the documents, which are in the index: repeated keys lose all their lines
        except in the largest document that holds them."""
        # both sides are written tables, so a key with a large share of all lines is an ordinary skewed join
        drops = self.refs.join(self.repeated(self.refs), KEY).where("doc_id < max_doc")
        drops = drops.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("drop"))     # bounded by a document's lines
        rows = docs.select(F.col(self.key).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        min_chars = self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in store.pieces(batches):
                data, offsets = buffers(piece.column("text"))
                total = np.diff(np.searchsorted(lines(data, offsets).text, np.arange(piece.num_rows + 1)))
                texts, dropped = piece.column("text").fill_null("").to_pylist(), np.zeros(piece.num_rows, np.int64)
                for i, drop in enumerate(piece.column("drop")):
                    if not drop.is_valid:
                        continue
                    gone = {(d["hi"], d["lo"]) for d in drop.as_py()}
                    own = data[offsets[i]: offsets[i + 1]]
                    _, long, keys = line_keys(own, np.array([0, len(own)]), min_chars)
                    out = {int(n) for n, k in zip(long, keys.tolist()) if tuple(k) in gone}
                    dropped[i] = len(out)
                    texts[i] = "\n".join(t for n, t in enumerate(texts[i].split("\n")) if n not in out)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "text": pa.array(texts, pa.string()),
                                                  "n_lines": pa.array(total.astype(np.int64)), "n_dropped": pa.array(dropped)})

        return rows.join(drops, "doc_id", "left").mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """Index all documents and return them without repeated lines."""
    return LineIndex.empty(docs.sparkSession, **settings).insert(docs).dedup(docs)
