"""Path expressions: all are columns over columns, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file-name prefixes of the three quality-control masks.
QC_PREFIXES = {
    "blur": "Piqe_piqe_median_activity_mask_",
    "folding": "FoldingFunction_folding_test_",
    "residual": "ResidualArtifactsAndCoverage_coverage_mask_",
}


def slide_path(path: Column, suffix: str = ".mrxs") -> Column:
    """The suffix is always appended, even where one is present; null stays null."""
    return F.concat(path, F.lit(suffix))


def stem(path: Column) -> Column:
    """Last path component without its last suffix; a leading dot is no suffix."""
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def with_suffix_name(path: Column, suffix: str = ".tiff") -> Column:
    return F.concat(stem(path), F.lit(suffix))


def join_path(root: str, name: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), name)


def mask_path(path: Column, root: str | None) -> Column:
    """Mask of a slide under `root`; the empty text where the mask kind is disabled."""
    return join_path(root, with_suffix_name(path)) if root else F.lit("")


def qc_mask_path(path: Column, root: str | None, kind: str) -> Column:
    return join_path(root, F.concat(F.lit(QC_PREFIXES[kind]), with_suffix_name(path))) if root else F.lit("")


def embedding_key(path: Column, mode: str = "full") -> Column:
    """Key of a slide's embedding file. `reference` strips a second suffix, so dotted stems can share a key; `full` keeps the stem."""
    if mode not in ("full", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    return stem(stem(path)) if mode == "reference" else stem(path)
