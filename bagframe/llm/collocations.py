"""Collocations of two to four words from suffix subtrees that are built apart from each other.

Vertical partitioning: the suffixes of all pieces of text are dealt by their first word. A word with more occurrences than a group may
hold is replaced by its continuations, and so on up to four words, so every prefix fits the budget. Prefixes are put together, in the
order of their hashes, into groups that fit it too. A group is one task: its suffixes, cut off after four words, are sorted, which is the
subtree, and the total of the leaves below a node is the count of its phrase. Nothing but the borders of the groups and the prefixes
that were too large, both bounded by corpus size over budget, comes to the driver.

Suffixes that are equal in a batch travel once, with their number. Words are 64-bit hashes of language and word until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.words import Words, mix, words

#: A piece ends at one of `[.,;:!?\x0A-\x0D]`; words in it are parted by `[\x20\x09]`.
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
PARTS = BREAKS.copy()
PARTS[[0x20, 0x09]] = True
#: Words of the longest phrase, and so the depth of the subtrees.
DEPTH = 4
#: Occurrences in a group, about; a group holds at most twice as many suffixes.
BUDGET = 500_000
#: No group holds much more than one part in so many of the corpus, however small that is.
_PARTS = 256
#: Prefixes beyond the budget and borders of groups stay below this number, whatever the corpus size.
_LISTED = 1_000_000
_PIECE = 4 << 20
#: Bytes of text whose suffixes a task sorts at once.
_SORTED = 2 << 20
_H = [f"h{i}" for i in range(1, DEPTH + 1)]


def word_pieces(piece: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, hash of language and word, number of the piece of each word) of a batch with `text` and `seed`, the hash of the language."""
    w = words(piece.column("text"), PARTS, lower=True)
    seen = np.concatenate([[0], np.cumsum(BREAKS[w.data], dtype=np.int64)])
    fresh = np.ones(len(w.text), bool)
    fresh[1:] = (w.text[1:] != w.text[:-1]) | (seen[w.start[1:]] != seen[w.start[:-1]])
    seed = mix(piece.column("seed").to_numpy(zero_copy_only=False).view(np.uint64))
    h = mix(w.hash ^ seed[w.text])
    h[h == 0] = 1                                     # 0 stands for the end of a piece
    return w, h, np.cumsum(fresh) - 1


def suffixes(h: np.ndarray, piece: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """depth x words: the word itself and those after it in its piece, 0 after the end."""
    out = np.zeros((depth, len(h)), np.uint64)
    for k in range(depth):
        n = len(h) - k
        if n > 0:
            out[k, :n] = np.where(piece[:n] == piece[k:], h[k:], np.uint64(0))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("seed"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins in sorted columns."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def word_table(docs: DataFrame) -> DataFrame:
    """(h, lang, word, f): every word of every language with its number of occurrences."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches, most=_PIECE):
            w, h, _ = word_pieces(piece)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            text = pa.array([w.data[a:b].tobytes() for a, b in zip(w.start[at], w.end[at])], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict({"h": pa.array(u.view(np.int64)), "lang": piece.column("lang").take(pa.array(w.text[at])), "word": text, "f": pa.array(n)})

    found = _rows(docs).mapInArrow(scan, "h long, lang string, word string, f long")
    return store.written(found.groupBy("h", "lang", "word").agg(F.sum("f").alias("f")), "words")


@dataclass
class Prefixes:
    """Prefixes beyond the budget, of one to three words: sorted keys, their counts, and their words; and the borders of the groups."""

    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)       # prefix x words
    shift: int = 0
    borders: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))

    def count(self, level: int, key: np.ndarray) -> np.ndarray:
        """Occurrences of those prefixes of level + 1 words that are beyond the budget; 0 for all others."""
        if level >= len(self.keys) or not len(self.keys[level]):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        return np.where(self.keys[level][at] == key, self.counts[level][at], 0)

    def dealt(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key of the shortest prefix within the budget, its number of words) of suffixes."""
        key, level = s[0].copy(), np.ones(s.shape[1], np.int8)
        live = np.arange(s.shape[1])
        for k in range(DEPTH - 1):
            live = live[self.count(k, key[live]) > 0]
            if not len(live):
                break
            key[live] = extended(key[live], s[k + 1, live])
            level[live] += 1
        return key, level

    def group(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, key >> np.uint64(self.shift), side="right") - 1


def extended(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Key of a prefix with one word more."""
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(0x9FB21C651E98DF25) ^ mix(h + np.uint64(0x165667B19E3779F9)))


def _files(total: int) -> int:
    """Files of a table that grows with `total` occurrences."""
    return 1 + total // 1_000_000


def _continued(docs: DataFrame, known: Prefixes, total: int) -> DataFrame:
    """(key, h1.., f) of the prefixes one word longer than the longest that `known` has, where those are beyond the budget."""
    size = len(known.keys) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches, most=_PIECE):
            _, h, number = word_pieces(piece)
            s = suffixes(h, number, size)
            s = s[:, known.count(0, s[0]) > 0]
            key, level = known.dealt(np.concatenate([s, np.zeros((DEPTH - size, s.shape[1]), np.uint64)]))
            some = np.flatnonzero(level == size)
            u, at, n = np.unique(key[some], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(u.view(np.int64))} | {_H[k]: pa.array(s[k, some[at]].view(np.int64)) for k in range(size)} | {"f": pa.array(n)})

    names = _H[:size]
    found = _rows(docs).mapInArrow(scan, f"key long, {', '.join(f'{c} long' for c in names)}, f long")
    return store.written(found.groupBy("key").agg(*[F.min(c).alias(c) for c in names], F.sum("f").alias("f")), "prefixes", files=_files(total))


def vertical_partition(docs: DataFrame, found: DataFrame, total: int, budget: int = BUDGET) -> Prefixes:
    """The groups of prefixes for `total` occurrences, from the word table `found`."""
    budget = max(1, min(budget, total // _PARTS), total // _LISTED)
    out, level = Prefixes(), found.select(F.col("h").alias("key"), F.col("h").alias("h1"), "f")
    fits = []
    for size in range(1, DEPTH + 1):
        beyond = F.col("f") > budget
        fits.append(level.where(~beyond if size < DEPTH else F.lit(True)).select("key", F.least("f", F.lit(budget)).alias("f")))
        if size == DEPTH:
            break
        hot = level.where(beyond & (F.col(f"h{size}") != 0)).collect()       # at most total / budget
        if size > 1:                                                     # a piece that ends there has no longer prefix
            fits.append(level.where(beyond & (F.col(f"h{size}") == 0)).select("key", F.lit(budget).cast("long").alias("f")))
        if not hot:
            break
        hot.sort(key=lambda r: r["key"] % (1 << 64))
        out.keys.append(np.array([r["key"] for r in hot], np.int64).view(np.uint64))
        out.counts.append(np.array([r["f"] for r in hot], np.int64))
        out.words.append(np.array([[r[c] for c in _H[:size]] for r in hot], np.int64).view(np.uint64))
        level = _continued(docs, out, total)
    bits = max(10, int(16 * total // budget).bit_length())
    cell = F.expr(f"shiftrightunsigned(key, {64 - bits})").alias("cell")
    cells = fits[0].unionByName(fits[1]) if len(fits) > 1 else fits[0]
    for more in fits[2:]:
        cells = cells.unionByName(more)
    cells = cells.select(cell, "f").groupBy("cell").agg(F.sum("f").alias("f")).withColumn("block", F.expr("shiftright(cell, 10)"))
    order = Window.partitionBy("block").orderBy("cell")
    before = F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("number", F.floor(F.coalesce(before, F.lit(0)) / F.lit(budget)))
    borders = sorted(r["cell"] for r in cells.groupBy("block", "number").agg(F.min("cell").alias("cell")).collect())
    out.shift, out.borders = 64 - bits, np.array([0, *borders[1:]], np.uint64)
    return out


def dealt_suffixes(docs: DataFrame, prefixes: Prefixes) -> DataFrame:
    """(group, lang, h1.. as arrays, n): the different suffixes of a batch in each group, and how often the batch has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches, most=_SORTED):
            w, h, number = word_pieces(piece)
            if not len(h):
                continue
            s = suffixes(h, number)
            key, _ = prefixes.dealt(s)
            group = prefixes.group(key).astype(np.int64)
            names, lang = np.unique(piece.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            part = group * len(names) + lang[w.text]
            order = np.lexsort((s[3], s[2], s[1], s[0], part))
            part, s = part[order], s[:, order]
            first = _runs(part, *s)
            n = np.diff(np.append(first, len(part)))
            part, s = part[first], s[:, first]
            cut = _runs(part)
            bounds = pa.array(np.append(cut, len(part)).astype(np.int32))
            listed = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"group": pa.array((part[cut] // len(names)).astype(np.int64)), "lang": pa.array(names[part[cut] % len(names)].tolist(), pa.string())}
                                             | {c: listed(s[k]) for k, c in enumerate(_H)} | {"n": listed(n)})

    return _rows(docs).mapInArrow(scan, f"group long, lang string, {', '.join(f'{c} array<long>' for c in _H)}, n array<long>")


def subtree_counts(prefixes: Prefixes, least: int):
    """A function from a group's suffixes to its phrases (lang, h1.., m, a, l1..): those that occur `least` times or more, with the counts
    of their beginnings of one word and more."""

    def reduce(found: pa.Table) -> pa.Table:
        column = lambda c: found.column(c).combine_chunks().flatten().to_numpy()
        s, n = np.stack([column(c).view(np.uint64) for c in _H]), column("n")
        lang = np.repeat(np.arange(found.num_rows), [len(x) for x in found.column("n").combine_chunks()])
        order = np.lexsort(s[::-1])
        s, n, lang = s[:, order], n[order], lang[order]
        _, level = prefixes.dealt(s)
        totals, out = [], {c: [] for c in ("at", "m", "a", "l1", "l2", "l3")}
        key = s[0]
        for depth in range(1, DEPTH + 1):
            first = _runs(*s[:depth])
            total = np.add.reduceat(n, first)
            run = np.zeros(len(n), np.int64)
            run[first] = 1
            run = np.cumsum(run) - 1
            if depth > 1:
                key = extended(key, s[depth - 1])
            if depth < DEPTH:
                beyond = prefixes.count(depth - 1, key[first]) if depth <= len(prefixes.keys) else np.zeros(len(first), np.int64)
                # a prefix beyond the budget is spread over groups; its count is known
                spread = level[first] > depth
                total = np.where(spread, beyond, total)
            totals.append((run, total))
            if depth > 1:
                mine = (s[depth - 1, first] != 0) & (total >= least) & (level[first] <= depth)
                at = first[mine]
                out["at"].append(at)
                out["m"].append(np.full(len(at), depth))
                out["a"].append(total[mine])
                for k in range(1, DEPTH):
                    out[f"l{k}"].append(totals[k - 1][1][totals[k - 1][0][at]] if k < depth else np.zeros(len(at), np.int64))
        out = {c: np.concatenate(v) for c, v in out.items()}
        at, m = out.pop("at"), out["m"]
        names = found.column("lang").combine_chunks().take(pa.array(lang[at]))
        return pa.table({"lang": names} | {c: pa.array(np.where(k < m, s[k, at], np.uint64(0)).view(np.int64)) for k, c in enumerate(_H)}
                        | {c: pa.array(v.astype(np.int64)) for c, v in out.items()})

    return reduce


_PHRASE = f"lang string, {', '.join(f'{c} long' for c in _H)}, m long, a long, l1 long, l2 long, l3 long"


def phrases(docs: DataFrame, least: int = 30, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): all phrases of two to four words with `least` occurrences or more, as (lang, h1.., m words, a occurrences, l1.. those of
    the beginnings), and the word table."""
    found = word_table(docs)
    total = found.agg(F.sum("f")).first()[0] or 0
    prefixes = vertical_partition(docs, found, total, budget)
    trees = dealt_suffixes(docs, prefixes).groupBy("group").applyInArrow(subtree_counts(prefixes, least), _PHRASE)
    # prefixes beyond the budget are phrases as well, of which no group has all
    rows = []
    for size in range(2, len(prefixes.keys) + 1):
        for hs, a in zip(prefixes.words[size - 1], prefixes.counts[size - 1]):
            if a >= least:
                key, before = hs[:1], []
                for k in range(size - 1):
                    before.append(int(prefixes.count(k, key)[0]))
                    key = extended(key, hs[k + 1: k + 2])
                rows.append([*hs.view(np.int64).tolist(), *[0] * (DEPTH - size), size, int(a), *before, *[0] * (DEPTH - 1 - len(before))])
    if rows:
        known = docs.sparkSession.createDataFrame(rows, _PHRASE.split(", ", 1)[1])
        named = known.join(found.select(F.col("h").alias("h1"), "lang"), "h1").select(*trees.columns)
        trees = trees.unionByName(named)
    return store.written(trees, "phrases", files=_files(total)), found


def _shifted(m: int, first: int) -> Column:
    """The words first.. first + m - 1 of a phrase as a key of three."""
    return F.struct(*[(F.col(_H[first + k]) if k < m else F.lit(0).cast("long")).alias(f"x{k + 1}") for k in range(DEPTH - 1)])


def scored(found: DataFrame, word_counts: DataFrame, least: int = 30, inside: int = 80) -> DataFrame:
    """(lang, h1.., m, a, l, r, score) of the phrases of which no longer one has `inside` percent or more of their occurrences. A phrase's score is the
    smallest of floor(2000000 a / (l + r)) over its cuts into a beginning that occurs l times and a rest that occurs r times; the
    first cut of equal ones counts. All products are decimals of 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # rests: every phrase asks for the counts of its ends, which are phrases or words of at least `least` occurrences themselves
    asks = F.explode(F.array(*[F.when(F.col("m") > k, F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.when(F.col("m") == k + 1, _shifted(1, k)).when(
        F.col("m") == k + 2, _shifted(min(2, DEPTH - k), k)).otherwise(_shifted(DEPTH - k, k)).alias("x"))) for k in range(1, DEPTH)]))
    asks = found.select("lang", *_H, "m", "a", asks.alias("ask")).where("ask is not null").select("lang", *_H, "m", "a", "ask.k", "ask.l", "ask.x.*")
    zero = F.lit(0).cast("long")
    known = found.where(F.col("m") < DEPTH).select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("h3").alias("x3"), F.col("a").alias("r"))
    known = known.unionByName(word_counts.where(F.col("f") >= least).select(F.col("h").alias("x1"), zero.alias("x2"), zero.alias("x3"), F.col("f").alias("r")))
    cuts = asks.join(known, ["x1", "x2", "x3"]).withColumn("top", wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("under", wide("l") + wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    best = cuts.groupBy("lang", *_H).agg(F.first("m").alias("m"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    parts = [F.struct(_shifted(size, at).alias("x"), (F.col("m") >= at + size).alias("fits"), F.lit(size).alias("size")) for size in range(2, DEPTH) for at in range(DEPTH - size + 1)]
    held = found.where(F.col("m") > 2).select("m", "a", F.explode(F.array(*parts)).alias("part")).where("part.fits and part.size < m")
    held = held.groupBy(F.col("part.x.x1").alias("h1"), F.col("part.x.x2").alias("h2"), F.col("part.x.x3").alias("h3"), zero.alias("h4")).agg(F.max("a").alias("longer"))
    alone = best.join(held, _H, "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside))
    return alone.select("lang", *_H, "m", "a", "cut.l", "cut.r", "cut.score")


def first_of(df: DataFrame, key: str, order: list[Column], most: int, buckets: int, spread: list[str]) -> DataFrame:
    """df's first `most` rows of every key, with their rank: first of each of `buckets` parts of a key, then of what is left."""
    part = F.pmod(F.xxhash64(*spread), F.lit(buckets))
    near = df.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)))
    near = near.where(F.col("rank") <= most).drop("part", "rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, most: int = 2000, least: int = 30, inside: int = 80, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of every language by score, then a, both falling, then the phrase's bytes.
    n is the number of words of the language.

    Texts and languages of all rows count, repeated ones each time. A null language is `und`; a null, empty or wordless text has no phrase.
    An empty table, or one without a phrase that occurs often enough, gives no rows. Only text and lang are read.
    """
    found, word_counts = phrases(docs, least, budget)
    rows = store.written(scored(found, word_counts, least, inside), "scored")
    buckets = 1 + rows.count() // 10_000
    by = [F.col("score").desc(), F.col("a").desc()]
    last = first_of(rows.select("lang", *_H, "score", "a"), "lang", by, most, buckets, _H).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    # as many as are asked for, and those that tie with the last
    kept = rows.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    spelled = kept.select(*_H, F.posexplode(F.array(*_H)).alias("at", "h")).where("h <> 0").join(word_counts.select("h", "word"), "h")
    spelled = spelled.groupBy(*_H).agg(*[F.max(F.when(F.col("at") == k, F.col("word"))).alias(f"w{k}") for k in range(DEPTH)])
    named = kept.join(spelled, _H).withColumn("phrase", F.concat_ws(" ", *[f"w{k}" for k in range(DEPTH)]))
    sizes = word_counts.groupBy("lang").agg(F.sum("f").alias("n"))
    final = first_of(named.select("lang", "phrase", "a", "l", "r", "score"), "lang", [*by, F.col("phrase")], most, buckets, ["phrase"])
    return final.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
