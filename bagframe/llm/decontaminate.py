"""Benchmark decontamination with a positional inverted index of the training texts. DataFrame functions only.

Postings (row, position, term) of the terms that occur in the benchmark are written once. For every benchmark window the
two rarest terms are looked up, and their lists, shifted by the term's place in the item, are intersected: what is left is
a (text, item, diagonal) that may hold the window. Only there the lists of all terms are joined, and runs of consecutive
places on one diagonal are exact phrases.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.llm import store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of this many short rows at most (16 MB or less) may be broadcast; larger ones meet in ordinary joins.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def text_key() -> Column:
    """128 bits of the text; null for a null text."""
    text = F.col("text").cast("string")
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its count, which is taken now, is within BROADCAST_ROWS."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class PhraseIndex:
    """terms (term, term_id), texts (row, doc_id, text_key, n_words), postings (row, pos, term_id), items (item, item_id, ipos, term_id,
    item_words): a place per benchmark word."""

    terms: DataFrame
    texts: DataFrame
    postings: DataFrame
    items: DataFrame
    window: int

    @classmethod
    def build(cls, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> PhraseIndex:
        """docs: (doc_id, text); benchmark: (item_id, text). Each row is a text of its own, whether its id is null, repeated
        or not; null texts have no words; extra columns are not read."""
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
        items = store.written(items.withColumn("item", F.monotonically_increasing_id()), "items")
        n = int(items.agg(F.sum(F.size("words"))).first()[0] or 0)
        places = items.select("item", "item_id", F.size("words").alias("item_words"), F.posexplode("words").alias("ipos", "term"))
        terms = store.written(places.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms", n)
        places = store.written(places.join(terms, "term").drop("term"), "item-places", n)
        found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"),
                            words_of(F.col("text")).alias("words"))
        # a null word in front stands for the text itself, so one pass writes texts and postings
        found = found.select("row", "doc_id", "text_key", F.size("words").alias("n_words"),
                             F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("pos", "term"))
        found = found.join(small(terms), "term", "left").where("pos = 0 or term_id is not null")
        index = store.written(found.select("row", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"),
                                           F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"),
                                           F.when(F.col("pos") == 0, F.col("text_key")).alias("text_key"),
                                           (F.col("pos") - 1).alias("pos"), "term_id"), "postings")
        return cls(terms, index.where("pos = -1").select("row", "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words")),
                   index.where("pos >= 0").select("row", "pos", "term_id"), places, window)

    def _span(self) -> Column:
        return F.least(F.lit(self.window), F.col("item_words"))

    def anchors(self, rarest: int = 2, slop: int = 0) -> DataFrame:
        """(item, ipos, term_id, need, whole): the `rarest` + `slop` rarest places of every window, of the terms that some text has. `whole`
        places are among the `rarest` of a window of which every term occurs; only such a window can be found exactly."""
        frequency = self.postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
        places = self.items.join(frequency, "term_id")
        first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - self._span() + 1), F.least(F.col("ipos"), F.col("item_words") - self._span())))
        windows = places.withColumn("start", first)
        by = Window.partitionBy("item", "start").orderBy("df", "ipos")
        full = F.count(F.lit(1)).over(Window.partitionBy("item", "start"))
        chosen = windows.withColumn("turn", F.row_number().over(by)).withColumn("known", full).where(F.col("turn") <= rarest + slop)
        whole = F.max((F.col("known") == self._span()) & (F.col("turn") <= rarest))
        chosen = chosen.groupBy("item", "ipos", "term_id").agg(F.min(F.least(F.lit(rarest), self._span())).alias("need"), whole.alias("whole"))
        return store.written(chosen, "anchors", self.items.count())

    def hits(self, anchors: DataFrame) -> DataFrame:
        """(row, item, diagonal, ipos, need) of every place where a text has an anchor."""
        return self.postings.join(small(anchors), "term_id").withColumn("diagonal", F.col("pos") - F.col("ipos"))

    def candidates(self, anchors: DataFrame) -> DataFrame:
        """(row, item, diagonal) where the shifted lists of `need` anchors meet."""
        hits = self.hits(anchors.where("whole"))
        return hits.groupBy("row", "item", "diagonal").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need")).where("hits >= need").drop("hits", "need")

    def near_candidates(self, anchors: DataFrame, slop: int) -> DataFrame:
        """(row, item, diagonal) of anchor hits that, with those of other anchors on diagonals within `slop`, make `need`. So words may be
        put in between two anchors, and `slop` of a window's rarest words be put out or occur in no text."""
        near = self.hits(anchors).withColumn("centre", F.explode(F.sequence(F.col("diagonal") - slop, F.col("diagonal") + slop)))
        near = near.groupBy("row", "item", "centre").agg(F.count_distinct("ipos").alias("hits"), F.max("need").alias("need"),
                                                         F.max(F.col("diagonal") == F.col("centre")).alias("own"))
        return near.where("own and hits >= need").select("row", "item", F.col("centre").alias("diagonal"))

    def matches(self, candidates: DataFrame, rows: DataFrame) -> DataFrame:
        """(row, item, item_id, item_words, diagonal, ipos, pos): places where text and item agree on the candidates' diagonals; `rows`
        are the candidates' rows."""
        near = self.postings.join(rows, "row", "left_semi")
        wanted = candidates.join(self.items, "item").withColumn("pos", F.col("diagonal") + F.col("ipos"))
        return wanted.join(near, ["row", "pos", "term_id"])

    def exact(self, candidates: DataFrame) -> DataFrame:
        """(row, item, item_id, pos): text places inside an occurrence of a window of the item."""
        line = Window.partitionBy("row", "item", "diagonal")
        runs = self.matches(candidates, small(candidates.select("row").distinct())).withColumn("run", F.col("ipos") - F.row_number().over(line.orderBy("ipos")))
        length = F.count(F.lit(1)).over(Window.partitionBy("row", "item", "diagonal", "run"))
        return runs.withColumn("length", length).where(F.col("length") >= self._span()).select("row", "item", "item_id", "pos")

    def proximity(self, candidates: DataFrame, slop: int = 2) -> DataFrame:
        """(row, item, item_id, share): the largest share of an item's places that agree within `slop` of one candidate diagonal,
        that is with at most so many words put in or left out. Nothing runs before the result is read."""
        shifted = candidates.withColumn("centre", F.col("diagonal")).withColumn("diagonal", F.explode(F.sequence(F.col("centre") - slop, F.col("centre") + slop)))
        agree = self.matches(shifted, candidates.select("row").distinct()).groupBy("row", "item", "item_id", "item_words", "centre").agg(F.count_distinct("ipos").alias("agree"))
        return agree.groupBy("row", "item", "item_id").agg(F.max(F.col("agree") / F.col("item_words")).alias("share"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, near_share) of every text.

    An item of fewer words than the window, but not none, is one window; one without words is none. n_items counts distinct
    item ids; a null item id counts as the empty string. near_share is the best proximity match, null without a candidate.
    """
    index = PhraseIndex.build(docs, benchmark, window)
    anchors = index.anchors(slop=slop)
    exact = index.exact(store.written(index.candidates(anchors), "candidates"))
    ids = F.array_sort(F.collect_set(F.coalesce("item_id", F.lit(""))))
    hit = exact.groupBy("row").agg(F.count_distinct("pos").alias("n_hit"), ids.alias("ids"))
    near = index.proximity(index.near_candidates(anchors, slop), slop).groupBy("row").agg(F.max("share").alias("near_share"))
    found = index.texts.join(hit, "row", "left").join(near, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"), "near_share")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of the benchmark. That depends on the text alone, so rows
    are told by 128 bits of their text."""
    index = PhraseIndex.build(docs, benchmark, window)
    hit = index.exact(store.written(index.candidates(index.anchors()), "candidates")).select("row").distinct()
    keys = store.written(index.texts.join(hit, "row").select("text_key").distinct(), "contaminated", index.texts.count())
    return docs.join(small(keys), text_key() == keys.text_key, "left_anti")
