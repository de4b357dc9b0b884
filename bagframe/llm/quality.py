"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one group of measures. On a sample the cost of every group and the share of documents that
every rule rejects are estimated; rules then run in order of rejection per cost, each only on documents that no earlier
rule rejected. The order decides what is computed and which rule is named, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagframe.llm import store
from bagframe.llm.words import SPACE, _hashes, buffers, code_points, lines, repeats, sums_per_text, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8


def word_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = buffers(texts)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    return {"n_words": sums_per_text(begin, offsets), "word_chars": sums_per_text(inside & ((data & 0xC0) != 0x80), offsets)}


def symbol_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = buffers(texts)
    return {"n_symbols": sums_per_text(_SYMBOL[data], offsets)}


def line_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = buffers(texts)
    found = lines(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data], dtype=np.int64)])
    some = solid[found.end] > solid[found.start]
    text, start, end = found.text[some], found.start[some], found.end[some]
    order, same = repeats(text, _hashes(data, start, end))
    n = len(offsets) - 1
    return {"n_lines": np.bincount(text, minlength=n).astype(np.int64),
            "n_dup_lines": np.bincount(text[order[same]], minlength=n).astype(np.int64)}


def repeat_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    w = words(texts)
    first, h = windows(w, WINDOW)
    order, same = repeats(w.text[first], h)
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, first[order[twice]], 1)
    np.add.at(cover, first[order[twice]] + WINDOW, -1)
    hit = np.cumsum(cover)[:-1] > 0
    return {"n_repeat_words": np.bincount(w.text[hit], minlength=len(w.offsets) - 1).astype(np.int64)}


#: group name -> (columns, function of a text array)
GROUPS: dict[str, tuple[tuple[str, ...], Callable[[pa.Array], dict[str, np.ndarray]]]] = {
    "words": (("n_words", "word_chars"), word_measures),
    "symbols": (("n_symbols",), symbol_measures),
    "lines": (("n_lines", "n_dup_lines"), line_measures),
    "repeats": (("n_repeat_words",), repeat_measures),
}
COLUMNS = tuple(c for columns, _ in GROUPS.values() for c in columns)


@dataclass(frozen=True)
class Rule:
    """rejects: from the measures of the groups it needs, True where a document is rejected."""

    name: str
    groups: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


#: The first two are the base rules. The others have wide limits: they are meant for junk, not for style.
RULES = (
    Rule("few_words", ("words",), lambda m: m["n_words"] < 20),
    Rule("repeated_words", ("words", "repeats"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("word_length", ("words",), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("symbols", ("words", "symbols"), lambda m: m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("lines",), lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
)
BASE_RULES = ("few_words", "repeated_words")


class _Measures:
    """Measures of one batch, computed group by group and only for the rows asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.values = {c: np.zeros(len(texts), np.int64) for c in COLUMNS}
        self.done = {g: np.zeros(len(texts), bool) for g in GROUPS}

    def need(self, group: str, rows: np.ndarray) -> None:
        new = rows[~self.done[group][rows]]
        if len(new) == 0:
            return
        texts = self.texts if len(new) == len(self.texts) else self.texts.take(pa.array(new))
        for column, values in GROUPS[group][1](texts).items():
            self.values[column][new] = values
        self.done[group][new] = True

    def rejected(self, rule: Rule, rows: np.ndarray) -> np.ndarray:
        for g in rule.groups:
            self.need(g, rows)
        return rule.rejects({c: self.values[c][rows] for g in rule.groups for c in GROUPS[g][0]})


def planned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 500) -> list[Rule]:
    """Rules by rejection per cost, best first, estimated on at most `sample_rows` rows.

    The greedy order: after a rule is placed, the next one is rated on the sample rows it leaves, and groups that are
    already paid for cost nothing more.
    """
    rows = docs.select(F.col(text).cast("string").alias("text")).limit(sample_rows).toArrow().column("text").combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], pa.string())
    if len(rows) == 0:
        return list(rules)
    sample, cost = _Measures(rows), {}
    everything = np.arange(len(rows))
    for g in GROUPS:
        began = time.perf_counter()
        sample.need(g, everything)
        cost[g] = time.perf_counter() - began + 1e-9
    left, paid, order, rest = everything, set(), [], list(rules)
    while rest:
        def gain(rule: Rule) -> tuple[float, float]:
            price = sum(cost[g] for g in rule.groups if g not in paid) + 1e-9
            return float(sample.rejected(rule, left).sum()) / price, -price
        best = max(rest, key=gain)
        order.append(best)
        rest.remove(best)
        paid.update(best.groups)
        left = left[~sample.rejected(best, left)]
    return order


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", order: list[Rule] | None = None,
            measures: bool = False) -> DataFrame:
    """(key, kept, failed_rule) of every row, in the planned order; with `measures` also all measures and base_failed.

    Without `measures` a document costs only what the rules up to its first failure need. A null text is an empty text (no
    words, so `few_words` rejects it). Keys are carried along, null or repeated ones too; other columns are not read.
    """
    order = order or planned(docs, rules, text)
    names = [r.name for r in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in store.pieces(batches):
            found = _Measures(piece.column("text").fill_null(""))
            left, failed = np.arange(piece.num_rows), np.full(piece.num_rows, -1)
            for i, rule in enumerate(order):
                bad = found.rejected(rule, left)
                failed[left[bad]] = i
                left = left[~bad]
            out = {"key": piece.column("key"), "kept": pa.array(failed < 0),
                   "failed_rule": pa.array([None if i < 0 else names[i] for i in failed], pa.string())}
            if measures:
                everything = np.arange(piece.num_rows)
                base = np.zeros(piece.num_rows, bool)
                for rule in order:
                    if rule.name in BASE_RULES:
                        base |= found.rejected(rule, everything)
                for g in GROUPS:
                    found.need(g, everything)
                out |= {c: pa.array(found.values[c]) for c in COLUMNS} | {"base_failed": pa.array(base)}
            yield pa.RecordBatch.from_pydict(out)

    schema = "key long, kept boolean, failed_rule string"
    if measures:
        schema += "".join(f", {c} long" for c in COLUMNS) + ", base_failed boolean"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(judge, schema).withColumnRenamed("key", key)
