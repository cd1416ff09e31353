"""Slide labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import stem

MODES = ("type", "index")
#: The two classes.
CLASSES = {"a luminal": 1, "b luminal": 0}


def luminal_label(value: Column) -> Column:
    """1 or 0; anything else, null too, raises."""
    out = None
    for name, label in CLASSES.items():
        out = F.when(value == name, F.lit(label)) if out is None else out.when(value == name, F.lit(label))
    return out.otherwise(F.raise_error(F.concat(F.lit("Unknown luminal type label: "), F.coalesce(value, F.lit("null")))).cast("int"))


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"Unsupported label mode: {mode}")
    return mode


def process_slides(slides: DataFrame, mode: str | None = None, index_column: str = "index") -> DataFrame:
    """Adds `name`, and for mode `type` type_label, for `index` the numeric index (text that is no number raises)."""
    if mode is not None and _checked(mode) == "type":
        slides = slides.withColumn("type_label", luminal_label(F.col("type")))
    elif mode == "index":
        slides = slides.withColumn("index", F.col(index_column).cast("double"))
    return slides.withColumn("name", stem(F.col("path")))


def target_column(mode: str) -> str:
    return "type_label" if _checked(mode) == "type" else "index"


def label_value(mode: str) -> Column:
    """The label as a 64-bit integer (`type`) or a 32-bit float (`index`)."""
    return F.col("type_label").cast("bigint") if _checked(mode) == "type" else F.col("index").cast("float")
