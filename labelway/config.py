"""Parameters and schemas shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Separators, names and texts of the service.
LABEL_SEP = "__SEP__"
SINGLE_LABEL = "__single__"
OTHERS = "others"
NULL_LABEL = "nan"
UNIQUE_RULE = "subissue -> subissue ⟨issue⟩ when ambiguous across different issues"

TICKET_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("text_obr", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("subissue", T.StringType()),
        T.StructField("grade", T.StringType()),
    ]
)

PREDICTIONS_TYPE = (
    "array<struct<category:string,proba:double,subissues:array<"
    "struct<label:string,issue:string,subissue_unique:string,proba:double>>>>"
)


@dataclass(frozen=True)
class HierConfig:
    """One training run: epochs are passes over the rows, each with ``updates`` steps on
    fixed blocks of rows. A model stops early once a pass lowers its mean loss by less
    than ``tolerance`` of it (0: never)."""

    model_id: str = "default"
    id_col: str = "row_id"
    text_col: str = "text_obr"
    cat_col: str = "category"
    issue_col: str = "issue"
    sub_col: str = "subissue"
    grade_col: str = "grade"
    use_grade_filter: bool = True
    max_rows: int | None = None
    min_count: int = 3
    top_keep: int = 5
    max_share: float = 0.6
    min_floor: int = 1
    val_size: float = 0.05
    test_size: float = 0.05
    seed: int = 42
    features: int = 1024
    router_epochs: int = 60
    router_lr: float = 0.05
    head_epochs: int = 60
    head_lr: float = 0.05
    weight_decay: float = 1e-4
    updates: int = 1
    tolerance: float = 0.0

    def __post_init__(self) -> None:
        hold = self.val_size + self.test_size
        if not 0.0 < hold < 1.0:
            raise ValueError(
                f"Invalid val/test sizes: val_size={self.val_size}, test_size={self.test_size}"
            )
