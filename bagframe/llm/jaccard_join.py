"""Exact Jaccard self-join of word-shingle sets with a token-group matrix.

Equal sets are one node. Each set is cut by a hash of its shingles into classes; a pair at the threshold differs in at most D
shingles, so with more than D classes some class is equal as a whole. The shingles of one class are one token of the matrix:
a passage that many texts share makes no common token, only sets that agree on a whole class have one. Nodes without a token
in common with another node are done.

The others are partitioned into groups by their most common token; a group holds a bounded number of shingles. The matrix is the
union of the tokens of each group. For a set and another group the tokens that it shares with the group's union bound from above what it
shares with a member; a group is opened only for the sets that the bound lets through, and its members are counted exactly. Only
these sets travel to the group, each once, and groups that are asked by many are opened in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from bagframe.llm import store
from bagframe.llm.components import components
from bagframe.llm.decontaminate import small
from bagframe.llm.words import SPACE, counts_per_text, mix, repeats, windows, words

#: Shingles in a group of the matrix, about.
GROUP_SHINGLES = 400_000
#: Shingles of the sets that ask a group in one task, as a multiple of those of a group.
_ASKING = 4
#: Classes beyond D + 1, so that a few empty classes do not matter.
_SLACK = 2


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each shingle, shingle hash): distinct shingles of every text, in text order. A text of fewer words than a
    shingle has one, the whole; a text without words none."""
    w = words(texts, SPACE, lower=True)
    first, h = windows(w, size)
    text = w.text[first]
    count = counts_per_text(w)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        start = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            value = count[short].astype(np.uint64)
            for j in range(size - 1):
                has = count[short] > j
                value[has] = mix(value[has] ^ w.hash[start[short[has]] + j]) + np.uint64(j + 1)
        text, h = np.concatenate([text, short]), np.concatenate([h, mix(value)])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    order, same = repeats(text, h)
    keep = np.ones(len(h), bool)
    keep[order[same]] = False
    return text[keep], h[keep]


def set_ids(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, 64-bit id of the set) of each of n texts; equal sets have equal ids."""
    size = np.bincount(text, minlength=n).astype(np.int64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, text, mix(h ^ np.uint64(0x3C6EF372FE94F82B)))
        return size, mix(total ^ mix(size.astype(np.uint64))).view(np.int64)


class Classes:
    """Size bands and numbers of classes for a threshold. Partners of a set lie in its band or the next, either way."""

    def __init__(self, threshold: Fraction):
        self.threshold, self.low = threshold, [1]

    def _reach(self, size: int) -> int:
        return int(Fraction(size) / self.threshold)

    def band(self, size: np.ndarray) -> np.ndarray:
        while len(size) and self.low[-1] <= int(size.max()):
            self.low.append(self._reach(self.low[-1]) + 1)
        return np.searchsorted(np.array(self.low), size, side="right") - 1

    @lru_cache  # noqa: B019
    def of_band(self, band: int) -> tuple[int, int]:
        """(D, number of classes) for pairs whose smaller set is in this band: |a ^ b| <= (1-t)/(1+t) (|a|+|b|)."""
        while len(self.low) < band + 2:
            self.low.append(self._reach(self.low[-1]) + 1)
        high = self.low[band + 1] - 1
        most = int((1 - self.threshold) / (1 + self.threshold) * (high + self._reach(high)))
        return most, most + 1 + _SLACK + most // 16

    def tokens(self, text: np.ndarray, h: np.ndarray, size: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, set id) of :meth:`bounded_tokens`."""
        return self.bounded_tokens(text, h, size, sid)[:2]

    def bounded_tokens(self, text: np.ndarray, h: np.ndarray, size: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, set id, least) for all classes of all sets, in the role of the smaller and of the larger set; `least` is how many
        tokens of this role a partner shares at least.

        Matching classes number K - D or more. A set with fewer empty classes than that cannot match in empty ones only; a set
        with as many, as all its partners then are, also has tokens for its empty classes.
        """
        band, out = self.band(size), []
        spread, value = mix(h ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(32), mix(h ^ np.uint64(0x5BE0CD19137E2179))
        for role in (0, 1):
            own = band - role
            d = np.zeros(len(size), np.int64)
            k = np.zeros(len(size), np.int64)
            for b in np.unique(own):
                if b >= 0:
                    d[own == b], k[own == b] = self.of_band(int(b))
            k[(d == 0) | (size == 0)] = 0               # no different set can be near
            at = np.cumsum(k) - k
            some = k[text] > 0
            t = text[some]
            cell = at[t] + ((spread[some] * k[t].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            total, filled = np.zeros(int(k.sum()), np.uint64), np.zeros(int(k.sum()), bool)
            with np.errstate(over="ignore"):
                np.add.at(total, cell, value[some])
            filled[cell] = True
            owner = np.repeat(np.arange(len(size)), k)
            empty = k - np.bincount(owner[filled], minlength=len(size))
            sparse = empty >= k - d
            least = np.maximum(1, k - d - empty)
            keep = filled | sparse[owner]
            number = np.arange(len(owner)) - at[owner]
            salt = mix((own[owner].astype(np.uint64) << np.uint64(32)) ^ number.astype(np.uint64))
            out.append((mix(total[keep] ^ salt[keep]), sid[owner[keep]], least[owner[keep]]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): row is a hash of both, which tells rows of one id, or of none, apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def set_table(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, sid, row) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches):
            text, h = shingle_sets(piece.column("text"), size)
            n, sid = set_ids(text, h, piece.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_shingles": pa.array(n), "sid": pa.array(sid), "row": piece.column("row")})

    return _texts(docs).mapInArrow(scan, "doc_id long, n_shingles long, sid long, row long")


def shared_tokens(docs: DataFrame, classes: Classes, buckets: int, size: int = 4) -> DataFrame:
    """(token, sid, least): tokens that two or more different sets have. Tokens travel in arrays by bucket, and a bucket is one
    range of token hashes; `buckets` keeps it to about a million tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches):
            text, h = shingle_sets(piece.column("text"), size)
            n, sid = set_ids(text, h, piece.num_rows)
            token, owner, least = classes.bounded_tokens(text, h, n, sid)
            if not len(token):
                continue
            order = np.lexsort((owner, token)) if len(token) < 1000 else np.argsort(token, kind="stable")
            token, owner, least = token[order], owner[order], least[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])       # most repeats; the rest goes below
            token, owner, least = token[fresh], owner[fresh], least[fresh]
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            bounds = pa.array(np.append(cut, len(token)).astype(np.int32))
            listed = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut]), "tokens": listed(token.view(np.int64)), "sids": listed(owner),
                                              "leasts": listed(least.astype(np.int32))})

    def reduce(found: pa.Table) -> pa.Table:
        token, owner, least = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("tokens", "sids", "leasts"))
        order = np.argsort(token, kind="stable")
        token, owner, least = token[order], owner[order], least[order]
        again = np.zeros(len(token), bool)
        again[1:] = token[1:] == token[:-1]
        run = np.cumsum(~again) - 1
        start = np.flatnonzero(~again)
        differs = np.zeros(len(start), bool)
        np.logical_or.at(differs, run, owner != owner[start[run]])
        keep = differs[run]
        token, owner, least = token[keep], owner[keep], least[keep]
        order = np.lexsort((owner, token))
        token, owner, least = token[order], owner[order], least[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        return pa.table({"token": pa.array(token[first]), "sid": pa.array(owner[first]), "least": pa.array(least[first])})

    arrays = _texts(docs).mapInArrow(scan, "bucket int, tokens array<long>, sids array<long>, leasts array<int>")
    return store.written(arrays.groupBy("bucket").applyInArrow(reduce, "token long, sid long, least int"), "shared-tokens")


def with_partners(shared: DataFrame, rounds: int = 2) -> DataFrame:
    """shared without the sets that hold fewer shared tokens of a role than a partner in that role must have, and without the tokens that
    then one set alone has. A passage that many texts share gives a set some common tokens by chance, but not that many."""
    for _ in range(rounds):
        enough = shared.groupBy("sid", "least").agg(F.count(F.lit(1)).alias("held")).where("held >= least").select("sid", "least")
        kept = shared.join(enough, ["sid", "least"])
        several = kept.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("token")
        shared = store.written(kept.join(several, "token"), "tokens-with-partners")
    return shared


def groups(shared: DataFrame, sizes: DataFrame, group_shingles: int = GROUP_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sid, n_shingles, g): a node's group is its most common token, in parts of about group_shingles; and the matrix (token, g): the union
    of the tokens of every group, of those tokens that more than one group has."""
    common = shared.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    best = shared.join(common, "token").groupBy("sid").agg(F.max_by("token", F.struct("sets", "token")).alias("key"))
    best = store.written(best.join(sizes, "sid"), "node-keys")
    parts = best.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / group_shingles)).alias("parts"))
    nodes = best.join(parts, "key").select("sid", "n_shingles", F.xxhash64("key", F.pmod(F.xxhash64("sid"), F.col("parts"))).alias("g"))
    nodes = store.written(nodes, "groups")
    union = shared.join(nodes.select("sid", "g"), "sid").select("token", "g").distinct()
    several = union.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token")
    return nodes, store.written(union.join(several, "token"), "matrix")


def openings(shared: DataFrame, nodes: DataFrame, matrix: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(sid, g, chunk, member): which sets meet in which task. Members of a group are in all its tasks; another group's set is in one of them,
    if it shares as many tokens with the group's union as it would with a partner. Of two groups one asks the other, so a pair meets once."""
    own = shared.join(matrix.select("token").distinct(), "token", "left_semi").join(nodes.select("sid", "n_shingles", F.col("g").alias("own")), "sid")
    lower, upper = F.least("own", "g"), F.greatest("own", "g")
    asks = (F.col("own") == lower) == (F.pmod(F.xxhash64(lower, upper), F.lit(2)) == 0)
    met = own.join(matrix, "token").where((F.col("own") != F.col("g")) & asks)
    routes = met.groupBy("sid", "g").agg(F.count(F.lit(1)).alias("shared"), F.min("least").alias("least"), F.first("n_shingles").alias("n_shingles"))
    routes = store.written(routes.where("shared >= least").select("sid", "g", "n_shingles"), "routes")
    chunks = routes.groupBy("g").agg((1 + F.floor(F.sum("n_shingles") / (_ASKING * group_shingles))).alias("chunks"))
    asking = routes.join(chunks, "g").select("sid", "g", F.pmod(F.xxhash64("sid"), F.col("chunks")).alias("chunk"), F.lit(False).alias("member"))
    opened = nodes.join(chunks, "g", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)))
    return opened.select("sid", "g", "chunk", F.lit(True).alias("member")).unionByName(asking)


def opened_sets(docs: DataFrame, table: DataFrame, meetings: DataFrame, size: int = 4) -> DataFrame:
    """(g, chunk, member, sid, shingles): the sets of every task, each read from one of the documents that have it. A set comes more than
    once if partitions repeat that document's id and text."""
    goals = meetings.groupBy("sid").agg(F.collect_list(F.struct("g", "chunk", "member")).alias("goals"))
    one = table.join(goals.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("row").alias("row"))
    one = store.written(one.join(goals, "sid"), "node-documents")
    texts = _texts(docs).join(small(one), "row").select("sid", "goals", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for piece in store.pieces(batches):
            text, h = shingle_sets(piece.column("text"), size)
            _, sid = set_ids(text, h, piece.num_rows)
            bounds = np.searchsorted(text, np.arange(piece.num_rows + 1))
            wanted, goals = piece.column("sid").to_numpy(), piece.column("goals")
            for i in np.flatnonzero(sid == wanted):
                if wanted[i] in done:
                    continue
                done.add(wanted[i])
                into = goals[int(i)].values
                shingles = pa.array([h[bounds[i]: bounds[i + 1]].tobytes()], pa.binary())
                # a set with many goals leaves in steps
                for a in range(0, len(into), 64):
                    at = into.slice(a, 64)
                    yield pa.RecordBatch.from_pydict({"g": at.field("g"), "chunk": at.field("chunk"), "member": at.field("member"),
                                                      "sid": pa.array(np.full(len(at), wanted[i])), "shingles": pa.repeat(shingles[0], len(at))})

    return texts.mapInArrow(_few(scan), "g long, chunk long, member boolean, sid long, shingles binary")


def _few(scan, most: int = 4 << 20):
    """scan, its small batches put together to about `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in scan(batches):
            held.append(batch)
            size += batch.nbytes
            if size > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _linked(a: list[np.ndarray], b: list[np.ndarray], threshold: Fraction, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): sets a[i] and b[j] at the threshold or above; with `same`, b is a and i < j."""
    over, under = threshold.numerator, threshold.denominator
    size_a = np.array([len(x) for x in a], np.int64)
    flat, owner = np.concatenate(a), np.repeat(np.arange(len(a)), size_a)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    union, bounds = flat[first], np.append(first, len(flat))
    left, right = [], []
    for j, x in enumerate(b):
        fits = (under * np.minimum(size_a, len(x)) >= over * np.maximum(size_a, len(x)))
        if same:
            fits[j:] = False
        if not fits.any():
            continue
        at = np.searchsorted(union, x)
        at[at == len(union)] = 0
        hit = at[union[at] == x]
        # overlap with the group's union: at t |q & x| >= t |q|
        if under * len(hit) < over * len(x):
            continue
        n = bounds[hit + 1] - bounds[hit]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        common = np.bincount(owner[np.repeat(bounds[hit], n) + step], minlength=len(a))
        i = np.flatnonzero(fits & (under * common >= over * (size_a + len(x) - common)))
        left.append(i)
        right.append(np.full(len(i), j))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (i, j) among n nodes connect something that earlier ones do not."""
    root, keep = list(range(n)), np.zeros(len(i), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep[k] = True
    return keep


def links(meeting_sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b, n): b null: set a has n links inside this task; else a link, enough of them to connect what is linked."""

    def verify(found: pa.Table) -> pa.Table:
        member = found.column("member").to_numpy()
        sid, shingles = found.column("sid").to_numpy(), found.column("shingles").combine_chunks()
        sets = lambda rows: [np.frombuffer(shingles[int(i)].as_buffer(), np.uint64) for i in rows]
        ids_a, at = np.unique(sid[member], return_index=True)
        sets_a = sets(np.flatnonzero(member)[at])
        ids_b, at = np.unique(sid[~member], return_index=True)
        sets_b = sets(np.flatnonzero(~member)[at])
        left, right, ids = [], [], np.concatenate([ids_a, ids_b])
        if found.column("chunk")[0].as_py() == 0 and len(ids_a) > 1:
            i, j = _linked(sets_a, sets_a, threshold, True)
            left.append(i)
            right.append(j)
        if len(ids_a) and len(ids_b):
            i, j = _linked(sets_a, sets_b, threshold, False)
            left.append(i)
            right.append(j + len(ids_a))
        i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        tree = _forest(i, j, len(ids))
        who, times = np.unique(np.concatenate([ids[i], ids[j]]), return_counts=True)
        edges = int(tree.sum())
        return pa.table({"a": pa.array(np.concatenate([ids[i[tree]], who])),
                         "b": pa.array(np.concatenate([ids[j[tree]], np.zeros(len(who), np.int64)]), mask=np.arange(edges + len(who)) >= edges),
                         "n": pa.array(np.concatenate([np.ones(edges, np.int64), times]))})

    return store.written(meeting_sets.groupBy("g", "chunk").applyInArrow(verify, "a long, b long, n long"), "links")


def _rooted(docs: DataFrame, threshold: Fraction, size: int, group_shingles: int) -> DataFrame:
    """(doc_id, n_shingles, sid, root, n_links) of every row; root is a set id that all rows of a class share."""
    table = store.written(set_table(docs, size), "sets")
    sizes = table.where("n_shingles > 0").select("sid", "n_shingles").distinct()
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    shared = shared_tokens(docs, Classes(threshold), int(max(32, total // 1_500_000)), size)
    shared = with_partners(shared)
    nodes, matrix = groups(shared, sizes, group_shingles)
    found = links(opened_sets(docs, table, openings(shared, nodes, matrix, group_shingles), size), threshold)
    roots = components(found.where("b is not null"))
    degree = found.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n_links"))
    degree = store.written(degree.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left"), "near-roots", nodes.count())
    n_links = F.coalesce("n_links", F.lit(0)).alias("n_links")
    return store.written(table.join(degree, "sid", "left").select("doc_id", "n_shingles", "sid", F.coalesce("root", "sid").alias("root"), n_links), "rooted", table.count())


def near_classes(docs: DataFrame, threshold: Fraction = Fraction(85, 100), size: int = 4, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: component_id is the smallest doc_id that links reach, n_links the number of
    other texts (distinct sets) that the text links with.

    A null or wordless text has the empty set and links with nothing. Rows with equal sets are linked, whether their ids differ, repeat
    or are null; a component of null ids only has a null id. An empty table gives no rows. Extra columns are not read.
    """
    rooted = _rooted(docs, threshold, size, group_shingles)
    some = rooted.where("n_shingles > 0")
    smallest = store.written(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest", some.count())
    some = some.join(smallest, "root").select("doc_id", "n_shingles", "component_id", "n_links")
    none = rooted.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "n_links")
    return some.unionByName(none)


def one_of_each(docs: DataFrame, threshold: Fraction = Fraction(85, 100), size: int = 4, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: of each class the row with the smallest id (null after all others)
    stays, one row if several have it. All rows with the empty set stay."""
    rooted = _rooted(docs, threshold, size, group_shingles)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sid"))
    chosen = rooted.where("n_shingles > 0").groupBy("root").agg(first.alias("c")).select("c.doc_id", "c.sid")
    rows = rooted.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).alias("rows"))
    chosen = store.written(chosen.join(rows, chosen.doc_id.eqNullSafe(rows.doc_id) & (chosen.sid == rows.sid)).select(chosen.doc_id, chosen.sid, "rows"), "chosen", rooted.count())
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = names.index("text")
    schema = StructType([*inner.schema.fields, StructField("sid", LongType()), StructField("empty", BooleanType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches, f"c{text}"):
            t, h = shingle_sets(piece.column(f"c{text}"), size)
            n, sid = set_ids(t, h, piece.num_rows)
            yield piece.append_column("sid", pa.array(sid)).append_column("empty", pa.array(n == 0))

    told = inner.mapInArrow(scan, schema)
    picked = small(chosen.select(F.col("doc_id").alias("id"), F.col("sid").alias("id_sid"), "rows"))
    told = told.join(picked, F.col(f"c{names.index('doc_id')}").cast("long").eqNullSafe(F.col("id")) & (F.col("sid") == F.col("id_sid")), "left")
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    single = told.where("empty or rows = 1").select(*back)
    if chosen.where("rows > 1").isEmpty():
        return single
    return single.unionByName(told.where("not empty and rows > 1").dropDuplicates(["id", "sid"]).select(*back))
