"""Secret scan: fixed patterns, and strings whose characters are too evenly spread. DataFrame functions only.

One pass over the texts keeps, per kind, the length of the gap before every match and of the match itself; running sums of those
few numbers are the spans. Candidate strings for the entropy test go through sliding windows with incremental counts: a character
that enters or leaves a window changes the sum of c * log2(c) by a difference that depends on its own count only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.llm import store


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# fixed values: the patterns of the base kinds
ASSIGN = ("(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
          + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: (kind, pattern, group whose length counts, least length, pattern without which there can be no such match)
BASE = (("assign", ASSIGN, 1, 6, ASSIGN), ("access", ACCESS, 0, 20, "AKIA[A-Z0-9]{16}"), ("hex", HEX, 0, 24, "[0-9a-f]{24}"))
KINDS = tuple(b[0] for b in BASE) + ("entropy",)

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: least bits per character of the best window, by character class of the candidate; random text has about 3.4, 4.0 and 4.0
LIMITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: Candidates that match one of these are no secrets: no digit or no letter, words and numbers joined by signs, UUIDs, documented samples.
ALLOW = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+))*[+/_=-]*$",
         r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "EXAMPLE")


def _found(text: Column, pattern: str, group: int, least: int, need: str, keep_text: bool = False) -> Column:
    """array of (gap, size, ok[, text]) of all leftmost matches that do not overlap; ok: long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def entry(x: Column) -> Column:
        fields = [x["0"].alias("gap"), F.length(x["1"]).alias("size"), (F.length(x["2"]) >= least).alias("ok")]
        return F.struct(*fields, *([x["1"].alias("string")] if keep_text else []))

    matches = F.filter(F.arrays_zip(gaps.alias("0"), whole.alias("1"), part.alias("2")), lambda x: x["1"].isNotNull())
    return F.when(text.rlike(need), F.transform(matches, entry))


def _spans(rows: DataFrame, kind: str, extra: list[str]) -> DataFrame:
    one = rows.where(F.size(kind) > 0).select("row", F.posexplode(kind).alias("i", "m"))
    before = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(before)).where("m.ok")
    return one.select("row", F.lit(kind).alias("kind"), (F.col("end") - F.col("m.size")).alias("start"), "end", *[F.col(f"m.{e}").alias(e) for e in extra])


def _entropy(candidates: DataFrame, window: int) -> DataFrame:
    """(row, start, end, bits): the highest entropy of any window of a candidate's characters.

    Long candidates are cut into overlapping stretches, so that no window function sees an unbounded string.
    """
    stretch = 4096
    size = F.col("end") - F.col("start")
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), size - window), F.lit(stretch)))
    cut = candidates.select("row", "start", "end", "string", part.alias("part"))
    cut = cut.withColumn("string", F.substring("string", F.col("part").cast("int") + 1, F.lit(stretch + window - 1)))
    chars = cut.select("row", "start", "end", "part", F.posexplode(F.split("string", "")).alias("i", "c")).where("c <> ''")
    same = Window.partitionBy("row", "start", "part", "c").orderBy("i")
    whole = Window.partitionBy("row", "start", "part").orderBy("i")

    def f(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0)

    entering = F.count(F.lit(1)).over(same.rangeBetween(-(window - 1), 0))
    leaving = F.count(F.lit(1)).over(same.rangeBetween(0, window - 1))
    steps = chars.withColumn("up", f(entering) - f(entering - 1)).withColumn("down", f(leaving) - f(leaving - 1))
    left = F.coalesce(F.lag("down", window).over(whole), F.lit(0.0))
    total = F.sum(F.col("up") - F.col("left")).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    bits = steps.withColumn("left", left).withColumn("total", total).where(F.col("i") >= window - 1)
    return bits.groupBy("row", "start", "end").agg(F.max(F.log2(F.lit(float(window))) - F.col("total") / window).alias("bits"))


def _class(s: Column) -> Column:
    return F.when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), "hex").when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def scan(docs: DataFrame, limits: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (row, doc_id), one for every row whatever its id; spans (row, kind, start, end) in code points.

    A base match that is too short is dropped after matching. Entropy spans that touch a base span are not given. A null text
    has no spans; extra columns are not read.
    """
    limits = limits or LIMITS
    text = F.col("text")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = store.written(texts.select("row", "doc_id", *[_found(text, *b[1:]).alias(b[0]) for b in BASE],
                                      _found(text, CANDIDATE, 0, window, CANDIDATE, keep_text=True).alias("entropy")), "secret-matches")
    base = _spans(rows, BASE[0][0], [])
    for b in BASE[1:]:
        base = base.unionByName(_spans(rows, b[0], []))
    base = store.written(base, "secret-spans")
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | F.col("string").rlike(pattern)
    candidates = _spans(rows, "entropy", ["string"]).where(~allowed)
    taken = base.select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    free = candidates.join(taken, (candidates.row == taken.row) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    free = store.written(free.withColumn("class", _class(F.col("string"))), "secret-candidates")
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("class"))
    high = _entropy(free, window).join(free.drop("string", "end"), ["row", "start"]).where(F.col("bits") >= limit)
    return rows.select("row", "doc_id"), base.unionByName(high.select("row", F.lit("entropy").alias("kind"), "start", "end"))


def secret_digest(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every text; spans are written kind:start:end, by start and then kind."""
    texts, spans = scan(docs, **settings)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entry = F.struct("start", order.alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    in_base = F.col("kind") != "entropy"
    per = spans.groupBy("row").agg(*[F.count(F.when(F.col("kind") == b[0], 1)).alias(f"n_{b[0]}") for b in BASE],
                                   F.array_sort(F.collect_list(F.when(in_base, entry))).alias("base"), F.array_sort(F.collect_list(entry)).alias("all"))
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["s"]), ","), F.lit(""))
    return texts.join(per, "row", "left").select("doc_id", *[F.coalesce(f"n_{b[0]}", F.lit(0)).cast("long").alias(f"n_{b[0]}") for b in BASE],
                                                 F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
