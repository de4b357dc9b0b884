"""Label encodings and output functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(cols: Sequence[str] | Column) -> Column:
    if isinstance(cols, Column):
        return cols
    return F.array(*[F.col(c).cast("double") for c in cols])


def split_labels(labels: str) -> Column:
    """Label text to an array: separated by commas, else by pipes; a single label is a one-element list.
    NULL and empty text give an empty array."""
    c = F.col(labels)
    parts = F.when(c.contains(","), F.split(c, ",")).otherwise(F.split(c, "\\|"))
    return F.when(c.isNull() | (F.length(c) == 0), F.array().cast("array<string>")).otherwise(parts)


def one_hot(labels: Column, classes: Sequence[str]) -> list[Column]:
    """One 0/1 INT column per class from an array of class names."""
    return [F.array_contains(labels, F.lit(c)).cast("int").alias(c) for c in classes]


def one_hot_index(label: str | Column, n_classes: int, prefix: str) -> list[Column]:
    c = F.col(label) if isinstance(label, str) else label
    return [(c == k).cast("int").alias(f"{prefix}{k}") for k in range(n_classes)]


def argmax(cols: Sequence[str] | Column) -> Column:
    """Index of the first maximum."""
    a = _doubles(cols)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def label_indices(cols: Sequence[str]) -> Column:
    """Indices of all classes that are set, ascending."""
    return F.array_compact(F.array(*[F.when(F.col(c) != 0, F.lit(i)) for i, c in enumerate(cols)]))


def class_text(cols: Sequence[str]) -> Column:
    """Names of the classes that are set, joined by a space."""
    return F.concat_ws(" ", *[F.when(F.col(c) != 0, F.lit(c)) for c in cols])


def worst_label(cols: Sequence[str]) -> Column:
    """Highest class index that is set; a row without a label is an error."""
    best = F.array_max(label_indices(cols))
    return F.when(best.isNull(), F.raise_error(F.lit("row without a label")).cast("int")).otherwise(best)


def highest_label(cols: Sequence[str], none_class: int | None = None) -> Column:
    """Highest class index that is set. A row without a label becomes the last class unless ``none_class`` says
    otherwise."""
    default = len(cols) - 1 if none_class is None else none_class
    return F.coalesce(F.array_max(label_indices(cols)), F.lit(default)).cast("int")


def softmax(x: Sequence[str] | Column) -> Column:
    a = _doubles(x)
    top = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def post_process(x: Sequence[str] | Column, function: str | None, size: int) -> Column:
    """Raw outputs (array of ``size``) to scores.

    softmax (a single output uses sigmoid), sigmoid, tanh, surv (one output: exp(-x), several: sigmoid), or identity.
    """
    a = _doubles(x)
    if function == "softmax":
        return softmax(a) if size > 1 else F.transform(a, sigmoid)
    if function == "sigmoid":
        return F.transform(a, sigmoid)
    if function == "tanh":
        return F.transform(a, F.tanh)
    if function == "surv":
        return F.transform(a, (lambda v: F.exp(-v)) if size == 1 else sigmoid)
    if function is None:
        return a
    raise ValueError(f"unknown output function {function}")


def predicted_labels(probs: Sequence[str] | Column, train_type: str, strict: bool = False) -> Column:
    """clf: index of the maximum; multilabel: 0/1 array at 0.5 (``strict``: above 0.5); otherwise the values."""
    a = _doubles(probs)
    if train_type == "clf":
        return argmax(a)
    if train_type == "multilabel":
        return F.transform(a, lambda p: ((p > 0.5) if strict else (p >= 0.5)).cast("int"))
    return a


def row_mean(cols: Sequence[str]) -> Column:
    """Several outputs to one risk: their mean."""
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in cols]) / float(len(cols))


def unroll(array: str, size: int, prefix: str) -> list[Column]:
    """Array column to ``prefix0 .. prefix{size-1}``."""
    return [F.col(array)[i].alias(f"{prefix}{i}") for i in range(size)]


def link_name(true_idx: Column, pred_idx: Column, classes: Sequence[str]) -> Column:
    """``B_A-C``: true classes and predicted classes, each from the highest index down."""
    names = F.array(*[F.lit(c) for c in classes])

    def text(idx: Column) -> Column:
        return F.array_join(F.transform(F.reverse(F.array_sort(idx)), lambda k: F.get(names, k)), "_")

    return F.replace(F.concat(text(true_idx), F.lit("__"), text(pred_idx)), F.lit("__"), F.lit("-"))


def dot(a: Column, b: Sequence[float] | Column) -> Column:
    """Dot product of an array column with constant weights or another array."""
    w = b if isinstance(b, Column) else F.array(*[F.lit(float(v)) for v in b])
    return F.aggregate(F.zip_with(a, w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def hazards_to_survival(outputs: Column) -> Column:
    """Discrete hazard logits per bin to survival: exp(cumsum(log(1 - sigmoid(x) + 1e-7)))."""
    step = F.transform(outputs, lambda x: F.log(1.0 - sigmoid(x.cast("double")) + 1e-7))
    empty = F.array().cast("array<double>")
    sums = F.aggregate(
        step, empty, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))
    return F.transform(sums, F.exp)


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Stable binary cross-entropy of a logit: max(x,0) - x*y + log(1 + exp(-|x|))."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def cross_entropy(logits: Sequence[str], label: str) -> Column:
    """-log softmax(logits)[label] with a shifted log-sum-exp."""
    a = _doubles(logits)
    top = F.array_max(a)
    lse = top + F.log(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return lse - F.get(a, F.col(label).cast("int"))
