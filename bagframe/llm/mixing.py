"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by hash, are one stream of words that is cut into blocks of equal size. Slot t
of the schedule has the van der Corput point of t (the bits of t reversed, as a fraction); the point's place among the cumulative
weights names the source, and the slot's rank among that source's slots names its next block, beginning again after the last.
Sources therefore alternate evenly at every scale. A source has as many slots as its target needs, the last one cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.decontaminate import small

WEIGHTS = (5, 2, 1)
#: rows per hash bucket or slot chunk inside which a window may order rows
_CHUNK = 1 << 15


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source_no, source, source_size, target): sources by code point, null last, take the weights in turn and share the sum
    of all sizes; a target stops at `most` times its source's size, and the excess is shared by weight among the others.

    The fixed point of that sharing is one level: target = min(most * size, level * weight). Sources in order of
    size / weight reach their limit first, so running sums give the level. The windows hold one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))).cast("int") + 1)
    numbered = totals.withColumn("source_no", turn).withColumn("weight", weight)
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (numbered.withColumn("total", F.sum("source_size").over(everything))
              .withColumn("limit", most * F.col("source_size"))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)))
    # the first source in this order that its level leaves below its limit fixes the level of all that follow
    levels = levels.withColumn("place", F.row_number().over(by))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))).over(everything)
    level = F.when(F.col("place") >= level["place"], level["level"])
    return (levels.withColumn("level", level)
            .select("source_no", "source", "source_size",
                    F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double"))).alias("target")))


def _streams(sized: DataFrame, n_rows: int) -> DataFrame:
    """Adds `start`: a row's first word in its source's shuffled stream. Running sums inside hash buckets of about
    _CHUNK rows, plus the sums of the buckets before; so no task orders a whole source."""
    digits = max(1, min(8, 1 + (max(1, n_rows // _CHUNK)).bit_length() // 4))
    rows = sized.withColumn("bucket", F.substring("shuffle", 1, digits))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["source_no", "bucket"]).withColumn("start", F.col("offset") + F.col("within")).drop("bucket", "offset", "within")


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source_no, rank) from plan (source_no, slots): the first n_slots van der Corput points through the cumulative
    slots; a source's surplus points are void, and ranks that it missed follow at the end. Both are O(log n) a source."""
    spark = plan.sparkSession
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = plan.where("slots > 0").withColumn("a", F.coalesce(F.sum("slots").over(before), F.lit(0)) / F.lit(n_slots))
    spans = spans.withColumn("b", F.col("a") + F.col("slots") / F.lit(n_slots))
    bits = max(1, (n_slots - 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("t"), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))
    cells = max(1, plan.count())
    points = spark.range(n_slots).select(F.col("id").alias("t")).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * cells))
    # spans meet points through cells of equal width; points fill the cells evenly
    cut = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") * cells), F.least(F.floor(F.col("b") * cells), F.lit(cells - 1)))))
    hits = points.join(cut, "cell").where("u >= a and u < b").select("t", "source_no", "slots")
    hits = store.written(hits.withColumn("chunk", F.floor(F.col("t") / _CHUNK)), "mix-hits", n_slots)
    per_chunk = hits.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("hits"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("offset", F.coalesce(F.sum("hits").over(earlier), F.lit(0)))
    inside = Window.partitionBy("source_no", "chunk").orderBy("t")
    ranked = (hits.withColumn("within", F.row_number().over(inside) - 1).join(per_chunk.drop("hits"), ["source_no", "chunk"])
              .withColumn("rank", F.col("offset") + F.col("within")).where("rank < slots").select(F.col("t").alias("slot"), "source_no", "rank"))
    got = per_chunk.groupBy("source_no").agg(F.sum("hits").alias("got"))
    missing = (plan.where("slots > 0").join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
               .select("source_no", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
               .select((F.lit(n_slots) + F.col("rank")).alias("slot"), "source_no", "rank"))
    return ranked.unionByName(missing)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): `rows` are the documents as (source_no, start, doc_id, size, source_size, target); `pieces` are the mix
    as (slot, source_no, start, epoch, first, last): slot by slot the words first..last-1 of the row that begins at `start`.

    A null text has no words; a null source is a source of its own, the last; rows that repeat an id are rows of their own,
    and their order is by id and size; an empty table gives empty results. Extra columns are not read. The shuffle is md5 of the id, so reruns agree.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size"))
    sized = store.written(sized.withColumn("shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    targets = store.written(source_targets(sized, weights, most), "mix-targets")
    n_rows = sized.count()
    numbered = sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(sized.source)
    rows = store.written(_streams(numbered, n_rows), "mix-rows", n_rows)

    take = F.round(F.col("target")).cast("long")
    plan = targets.where("source_size > 0").withColumn("take", take).withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("rest", F.pmod("take", F.col("source_size")))
    plan = plan.withColumn("slots", F.floor(F.col("take") / F.col("source_size")) * F.col("blocks") + F.ceil(F.col("rest") / block))
    plan = plan.select("source_no", "source_size", "blocks", "rest", "slots")
    n_slots = plan.agg(F.sum("slots")).first()[0] or 0
    slots = schedule(plan.select("source_no", "slots"), n_slots).join(plan.drop("source_size"), "source_no")
    slots = slots.select("slot", "source_no", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), F.pmod("rank", F.col("blocks")).alias("block"),
                         F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("rest")).alias("stop"))
    end = F.col("start") + F.col("size")
    cut = rows.where("size > 0").select("source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    last = F.least(end, (F.col("block") + 1) * block, F.col("stop")) - F.col("start")       # least() passes over a null stop
    pieces = cut.join(slots, ["source_no", "block"]).select("slot", "source_no", "start", "epoch", first.alias("first"), last.alias("last"))
    return rows, pieces.where("first < last")


def mix_taken(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row, `taken` counting repeats."""
    rows, pieces = mix(docs, **settings)
    taken = pieces.groupBy("source_no", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    some = rows.where("size > 0").join(taken, ["source_no", "start"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as whole documents with all their columns: each row as often as the schedule takes its middle word.

    Rows that are equal in id, source and number of words get the sum of their copies shared evenly, the first ones one more.
    """
    rows, pieces = mix(docs, **settings)
    middle = rows.where("size > 0").join(pieces, ["source_no", "start"]).where("first <= floor(size / 2) and floor(size / 2) < last")
    copies = middle.groupBy("source_no", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    equal = rows.where("size > 0").groupBy("source_no", "source", "doc_id", "size").agg(F.count(F.lit(1)).alias("equals"))
    told = lambda doc_id, source, size: F.xxhash64(doc_id, source, size).alias("told")
    copies = store.written(equal.join(copies, (equal.source_no == copies.source_no) & equal.doc_id.eqNullSafe(copies.doc_id) & (equal.size == copies.size))
                           .select(told(equal.doc_id, equal.source, equal.size), "equals", "copies"), "mix-copies", rows.count())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    size = n_words(F.col("text").cast("string")).cast("long")
    sized = docs.select(F.struct(*columns).alias("row"), told(F.col("doc_id").cast("long"), F.col("source").cast("string"), size))
    # three longs a row: 12 MB at the most that are broadcast
    found = sized.join(small(copies), "told")
    single = found.where("equals = 1").withColumn("times", F.col("copies"))
    if not copies.where("equals > 1").isEmpty():
        # rows that share id, source and size are numbered
        number = F.row_number().over(Window.partitionBy("told").orderBy(F.col("row")["text"])) - 1
        several = found.where("equals > 1").withColumn("number", number)
        times = F.floor(F.col("copies") / F.col("equals")) + (F.col("number") < F.pmod("copies", F.col("equals"))).cast("int")
        single = single.unionByName(several.withColumn("times", times).drop("number"))
    return single.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
