"""Token ids in binary shards with a minimal perfect hash index per shard.

Files of one shard, all little-endian:

* ``<name>.ids``   raw ids, no header: unsigned 16 bit if the vocabulary fits, else unsigned 32 bit; documents after each other
* ``<name>.dir``   per row in order: key int64, 1 byte null flag, number of ids uint64 (three arrays, first the row count uint64)
* ``<name>.idx``   the perfect hash over the distinct keys, then per place: fingerprint uint32, offset uint64, number of ids uint64

A task writes under a name of its own and returns it; only names in the manifest table, which Spark commits, count. So a
retried or speculative task leaves an unused file at worst.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.perfect_hash import PerfectHash, fingerprints
from bagframe.llm.words import _hashes, buffers, mix

END_ID = 0
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEPARATOR_CONTROL = np.zeros(256, bool)
_SEPARATOR_CONTROL[0x1C:0x20] = True


class PieceEncoder:
    """Encodes many texts with a byte-level BPE file of the tokenizers library, each distinct piece once.

    A piece is a run of white space and what follows up to the next. The library splits every text before a run of white
    space, so its ids are those of the pieces in order. Texts where that is not plain (white space beyond ASCII, separator
    controls, special-token strings) are one piece. Pieces are remembered by 64-bit hash; the memory is emptied at `most`.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = max(vocabulary.values(), default=0) >= 1 << 16
        self.dtype = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts may be cut at white space."""
        odd = _SEPARATOR_CONTROL[data]
        wide = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xE3)) if len(data) > 1 else np.zeros(0, np.int64)
        a, b = data[wide], data[wide + 1]
        c = data[np.minimum(wide + 2, len(data) - 1)] if len(data) else a
        space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        space |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        at = np.concatenate([np.flatnonzero(odd), wide[space]])
        plain = np.ones(len(offsets) - 1, bool)
        plain[np.searchsorted(offsets, at, side="right") - 1] = False
        if self.special:
            raw = data.tobytes()
            for s in self.special:
                i = raw.find(s)
                while i >= 0:
                    plain[np.searchsorted(offsets, i, side="right") - 1] = False
                    i = raw.find(s, i + 1)
        return plain

    def _learn(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray, data: np.ndarray) -> None:
        raw = data.tobytes()
        joined, rows = np.flatnonzero(~alone), []
        flat: list[np.ndarray] = []
        counts = np.zeros(len(keys), np.int64)
        chunks = [joined[i: i + 64] for i in range(0, len(joined), 64)]
        texts = [b"".join(raw[start[i]: end[i]] for i in c).decode() for c in chunks]
        single = np.flatnonzero(alone)
        texts += [raw[start[i]: end[i]].decode() for i in single]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        for c, e in zip(chunks, encoded):
            ids = np.array(e.ids, np.int64)
            ends = np.cumsum(end[c] - start[c])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1
            if not np.array_equal(np.cumsum(self.lengths[ids])[cuts - 1], ends):
                raise ValueError("a token runs over a piece; this vocabulary is not byte-level with a split at white space")
            counts[c] = np.diff(cuts, prepend=0)
            flat.append(ids)
            rows.append(c)
        for i, e in zip(single, encoded[len(chunks):]):
            ids = np.array(e.ids, np.int64)
            counts[i] = len(ids)
            flat.append(ids)
            rows.append(np.array([i]))
        order = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        flat_new = np.concatenate(flat).astype(self.dtype) if flat else np.zeros(0, self.dtype)
        begin = np.zeros(len(keys), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order] + len(self.flat)
        self.flat = np.concatenate([self.flat, flat_new])
        merged = np.concatenate([self.keys, keys])
        by = np.argsort(merged, kind="stable")
        self.keys, self.begin, self.count = merged[by], np.concatenate([self.begin, begin])[by], np.concatenate([self.count, counts])[by]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after each other, each text ended by END_ID; number of ids of each)."""
        data, offsets = buffers(texts)
        n = len(offsets) - 1
        plain = self._plain(data, offsets)
        space = _SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[filled] = True
        start = np.flatnonzero(cut)
        text = np.searchsorted(offsets, start, side="right") - 1
        first = start == offsets[text]
        keep = plain[text] | first
        start, text, first = start[keep], text[keep], first[keep]
        end = np.append(start[1:], len(data))
        alone = first & (~space[start] | ~plain[text]) if len(start) else first
        key = _hashes(data, start, end)
        key[alone] = mix(key[alone] ^ np.uint64(0x5851F42D4C957F2D))
        u, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > self.most:
            self._forget()
        known = np.zeros(len(u), bool)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            known = self.keys[i] == u
        new = at[~known]
        if len(new):
            self._learn(u[~known], start[new], end[new], alone[new], data)
        slot = np.searchsorted(self.keys, u)[inverse]
        count, begin = self.count[slot], self.begin[slot]
        per_text = np.bincount(text, weights=count, minlength=n).astype(np.int64) if len(text) else np.zeros(n, np.int64)
        out = np.full(int(count.sum()) + n, END_ID, self.dtype)
        if len(count):
            place = np.cumsum(count) - count + text              # one end id for every earlier text
            total = int(count.sum())
            step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(place, count) + step] = self.flat[np.repeat(begin, count) + step]
        return out, per_text + 1


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


MANIFEST = "shard int, name string, rows long, ids long, wide boolean"


def write_shards(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ids of every text to shards below path, in ascending key order over all shards; returns the manifest.

    Rows are range-partitioned by key; a shard is a partition, so `spark.sql.shuffle.partitions` sets the shard size. A
    null text has only its end id; a null key comes first and is not in the index; rows that repeat a key follow each
    other, and the index gives the first of them. An empty table has an empty manifest. Other columns are not read.
    """
    ordered = (docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
               .repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        shard, keys, nulls, sizes = TaskContext.get().partitionId(), [], [], []
        name, out = f"shard-{shard:06d}-{uuid.uuid4().hex}", None
        for piece in store.pieces(batches):
            if out is None:
                system, where = store.open_folder(path)
                out = system.open_output_stream(f"{where}/{name}.ids")
            ids, count = encoder.encode(piece.column("text"))
            out.write(ids.tobytes())
            keys.append(piece.column("key").fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(piece.column("key").is_null().to_numpy(zero_copy_only=False))
            sizes.append(count)
        if out is None:
            return
        out.close()
        k, null, n = np.concatenate(keys).astype("<i8"), np.concatenate(nulls), np.concatenate(sizes).astype("<u8")
        store.write_bytes(path, f"{name}.dir", struct.pack("<Q", len(k)) + k.tobytes() + null.astype(np.uint8).tobytes() + n.tobytes())
        store.write_bytes(path, f"{name}.idx", index_bytes(k, null, n))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "rows": pa.array([len(k)], pa.int64()),
                                          "ids": pa.array([int(n.sum())], pa.int64()), "wide": [encoder.wide]})

    return store.written(ordered.mapInArrow(write, MANIFEST), "manifest")


def _first_rows(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    first = ~null
    first[1:] &= (keys[1:] != keys[:-1]) | null[:-1]
    return first


def index_bytes(keys: np.ndarray, null: np.ndarray, sizes: np.ndarray) -> bytes:
    first = _first_rows(keys, null)
    offsets = np.cumsum(sizes) - sizes
    k = keys[first].view("<u8")
    mph = PerfectHash.build(k)
    at = mph.lookup(k)
    prints, offset, size = np.zeros(len(k), "<u4"), np.zeros(len(k), "<u8"), np.zeros(len(k), "<u8")
    prints[at], offset[at], size[at] = fingerprints(k), offsets[first], sizes[first]
    return mph.to_bytes() + prints.tobytes() + offset.tobytes() + size.tobytes()


class Shard:
    """Keyed access to one shard; reads index and directory, and of the ids only what is asked for."""

    def __init__(self, path: str, name: str, wide: bool):
        self.path, self.name, self.dtype = path, name, np.dtype("<u4" if wide else "<u2")
        data = store.read_bytes(path, f"{name}.idx")
        self.hash, at = PerfectHash.from_bytes(data)
        n = len(self.hash)
        self.prints = np.frombuffer(data, "<u4", n, at)
        self.offset = np.frombuffer(data, "<u8", n, at + 4 * n)
        self.size = np.frombuffer(data, "<u8", n, at + 12 * n)
        self.system, self.where = store.open_folder(path)
        self.file = self.system.open_input_file(f"{self.where}/{name}.ids")

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the index, -1 where the key is not in this shard."""
        k = np.asarray(keys, "<i8").view("<u8")
        at = self.hash.lookup(k)
        known = at >= 0
        known[known] = self.prints[at[known]] == fingerprints(k[known])
        return np.where(known, at, -1)

    def get(self, key: int) -> np.ndarray | None:
        """Ids of a document, its end id included; None if the key is unknown."""
        at = self.locate(np.array([key]))[0]
        return None if at < 0 else self.read(int(self.offset[at]), int(self.size[at]))

    def read(self, offset: int, size: int) -> np.ndarray:
        self.file.seek(offset * self.dtype.itemsize)
        return np.frombuffer(self.file.read(size * self.dtype.itemsize), self.dtype)

    def directory(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = store.read_bytes(self.path, f"{self.name}.dir")
        (n,) = struct.unpack_from("<Q", data)
        return (np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(bool),
                np.frombuffer(data, "<u8", n, 8 + 9 * n))


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files: each key goes through its shard's index.

    A key that the index gives another place than the directory is an error: the files are damaged.
    """
    # one row per shard: even at 100 TB in shards of 128 MB this window holds under a million short rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    shards = shards.repartition(F.col("name"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(path, row["name"], row["wide"])
                keys, null, sizes = shard.directory()
                offsets = (np.cumsum(sizes) - sizes).astype(np.int64)
                first = _first_rows(keys, null)
                at = shard.locate(keys[first])
                if (at < 0).any() or (shard.offset[at] != offsets[first]).any() or (shard.size[at] != sizes[first]).any():
                    raise ValueError(f"index and directory of {row['name']} disagree")
                for i in range(0, len(keys), 4096):
                    some = slice(i, i + 4096)
                    crc = [zlib.crc32(shard.read(int(o), int(s)).astype("<u4").tobytes()) for o, s in zip(offsets[some], sizes[some])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(keys[some].astype(np.int64), mask=null[some]),
                        "start": pa.array(offsets[some] + row["before"]),
                        "n_tokens": pa.array(sizes[some].astype(np.int64)),
                        "ids_crc32": pa.array(crc, pa.int64())})

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the shards and read them back."""
    path = path or store.folder(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, tokenizer, path), path)
