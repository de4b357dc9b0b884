"""License scan by diagonal voting.

All rolling k-gram hashes of the texts' words are joined to the k-gram positions of the templates. A hit votes for the diagonal
(place in the text minus place in the template); the votes of neighbouring diagonals, which words put in or left out make, are
merged, and what has enough votes is verified word by word.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.words import NOT_ALNUM, counts_per_text, windows, words

K = 3
#: Template words, together at most; the tables of template grams are within a broadcast's bounds.
MOST_TEMPLATE_WORDS = 1_000_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@dataclass(frozen=True)
class Template:
    """exact: only whole, unchanged places count. Others count if `share` of the template's words are in the span in order."""

    label: str
    text: str
    exact: bool = False
    share: float = 0.8


# fixed values: phrases of the base and their labels
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)
# fixed values: opening words of public licenses
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files, to deal in the Software without restriction"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
             "Free Software Foundation"),
)
TEMPLATES = PHRASES + NOTICES


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _grams(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """(hash, template, place) of all k-grams."""
    out = []
    for number, t in enumerate(templates):
        first, h = windows(words(pa.array([t.text]), NOT_ALNUM, lower=True), K)
        if not len(h):
            raise ValueError(f"a template needs {K} words or more: {t.text!r}")
        out += [(int(x), number, int(p)) for x, p in zip(h.view(np.int64), first)]
    return out


def _scanned(docs: DataFrame, grams: list[tuple[int, int, int]]) -> DataFrame:
    """One row per text: row, doc_id, n_words, the grams that occur in a template, and the text if there are any."""
    known = np.unique(np.array([g[0] for g in grams], np.int64)).view(np.uint64)
    known.sort()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for piece in store.pieces(batches):
            w = words(piece.column("text"), NOT_ALNUM, lower=True)
            first, h = windows(w, K)
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h     # others can join nothing
            first, h = first[hit], h[hit]
            text, before = w.text[first], np.concatenate([[0], np.cumsum(counts_per_text(w))])
            at = np.searchsorted(text, np.arange(piece.num_rows + 1))
            has = np.diff(at) > 0
            entries = pa.StructArray.from_arrays([pa.array((first - before[text]).astype(np.int32)), pa.array(h.view(np.int64))], ["pos", "hash"])
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.arange(row, row + piece.num_rows)), "doc_id": piece.column("doc_id"), "n_words": pa.array(counts_per_text(w)),
                "grams": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), entries),
                "text": piece.column("text").take(pa.array(np.arange(piece.num_rows), mask=~has))})
            row += piece.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store.written(rows.mapInArrow(scan, "row long, doc_id long, n_words long, grams array<struct<pos:int,hash:long>>, text string"), "license-grams")


def spans_to_verify(scanned: DataFrame, templates: tuple[Template, ...], grams: list, gap: int = 3, votes: float = 0.25) -> DataFrame:
    """(row, template, first, last, votes): merged diagonals with votes from that share of the template's grams or more."""
    spark = scanned.sparkSession
    places = spark.createDataFrame([(h, n, p) for h, n, p in grams], "hash long, template int, place int")
    sizes = spark.createDataFrame([(n, sum(g[1] == n for g in grams), t.exact) for n, t in enumerate(templates)], "template int, grams int, exact boolean")
    hits = scanned.select("row", F.explode("grams").alias("g")).select("row", "g.pos", "g.hash").join(places, "hash")
    per = hits.withColumn("diagonal", F.col("pos") - F.col("place")).groupBy("row", "template", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), (F.max("pos") + K).alias("last")).join(sizes, "template")
    # an exact phrase has all its grams on one diagonal; others may lie on several
    exact = per.where("exact and votes = grams").select("row", "template", "first", "last", "votes")
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    loose = per.where("not exact").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(line) > gap).cast("int"))
    loose = loose.withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(line))
    merged = loose.groupBy("row", "template", "cluster").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("grams").alias("grams"))
    merged = merged.where(F.col("votes") >= F.greatest(F.lit(2), F.ceil(F.col("grams") * votes)))
    return exact.unionByName(merged.select("row", "template", "first", "last", "votes"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every text.

    `spans` are the verified ones as (label, first, last, share, exact); n_base, first_word, last_word and base_labels come from the
    exact ones, `labels` from all, score is the largest share, 0 without a span. A null text has no words; a row is a text of
    its own whatever its id; extra columns are not read.
    """
    if sum(len(split_words(t.text)) for t in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("too many template words")
    grams = _grams(templates)
    scanned = _scanned(docs, grams)
    found = spans_to_verify(scanned, templates, grams).groupBy("row").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    wanted = [split_words(t.text) for t in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                good = []
                own = split_words(text) if spans and text else []
                for s in spans or ():
                    t, need = templates[s["template"]], wanted[s["template"]]
                    first, last = s["first"], s["last"]
                    if t.exact:
                        if own[first:last] == need:
                            good.append((t.label, first, last, 1.0, True))
                        continue
                    first, last = max(0, first - len(need) // 4), last + len(need) // 4
                    blocks = difflib.SequenceMatcher(None, need, own[first:last], autojunk=False).get_matching_blocks()
                    same = [b for b in blocks if b.size]
                    share = sum(b.size for b in same) / len(need)
                    if share >= t.share and same[-1].b + same[-1].size - same[0].b <= 1.5 * len(need):
                        good.append((t.label, first + same[0].b, first + same[-1].b + same[-1].size, share, False))
                good.sort()
                base = [g for g in good if g[4]]
                out["n_base"].append(len(base))
                out["first_word"].append(min((g[1] for g in base), default=None))
                out["last_word"].append(max((g[1] for g in base), default=None))
                out["base_labels"].append(",".join(sorted({g[0] for g in base})))
                out["labels"].append(",".join(sorted({g[0] for g in good})))
                out["score"].append(max((g[3] for g in good), default=0.0))
                out["spans"].append([dict(zip(("label", "first", "last", "share", "exact"), g)) for g in good])
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64()), ("exact", pa.bool_())]))
            types = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
                     "score": pa.float64(), "spans": kind}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words")}
                                             | {c: pa.array(v, types[c]) for c, v in out.items()})

    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "spans array<struct<label:string,first:long,last:long,share:double,exact:boolean>>")
    return scanned.drop("grams").join(found, "row", "left").drop("row").mapInArrow(verify, schema)
