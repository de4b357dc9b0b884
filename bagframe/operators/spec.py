"""What kind of cohort a table is: training type, target columns, column names."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class TrainType(str, Enum):
    CLF = "clf"
    MULTILABEL = "multilabel"
    REGR = "regr"
    SURV = "surv"

    @property
    def post_function(self) -> str | None:
        """The function that turns raw outputs into scores."""
        return {"clf": "softmax", "multilabel": "sigmoid", "surv": "surv"}.get(self.value)

    @property
    def monitor(self) -> tuple[str, str]:
        """Validation metric that selects an epoch, and whether more is better."""
        return {"surv": ("val_cind", "max"), "regr": ("val_loss", "min")}.get(self.value, ("val_auc", "max"))

    @property
    def is_class_type(self) -> bool:
        return self in (TrainType.CLF, TrainType.MULTILABEL)


@dataclass(frozen=True)
class CohortSpec:
    """Names and types beside a cohort DataFrame. Survival targets are in the order (event, duration)."""

    train_type: TrainType
    target_cols: tuple[str, ...]
    name_col: str = "name"
    split_col: str = "split"
    category_col: str = "category"
    label_col: str = "label"
    classes_col: str = "classes"
    out_prefix: str = "out"
    pred_prefix: str = "pred"
    categories_order: tuple[str, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "train_type", TrainType(self.train_type))
        object.__setattr__(self, "target_cols", tuple(self.target_cols))
        if self.train_type is TrainType.SURV and len(self.target_cols) != 2:
            raise ValueError("survival cohorts need the targets (event, duration)")

    @property
    def n_classes(self) -> int:
        return len(self.target_cols)

    @property
    def event_col(self) -> str:
        return self.target_cols[0]

    @property
    def duration_col(self) -> str:
        return self.target_cols[1]

    @property
    def out_cols(self) -> list[str]:
        return [f"{self.out_prefix}{i}" for i in range(self.n_classes)]

    def category(self, level: str | int = "") -> str:
        return f"{self.category_col}{level}"
