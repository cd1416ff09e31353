"""Pixel and token arithmetic over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel means and deviations of the usual image statistics.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Class token first, then register tokens, then patches.
REGISTERS = 4


def normalize_channels(pixels: Column, most: float = 255.0) -> Column:
    """(value / most - mean) / deviation for interleaved channel values."""
    mean, deviation = F.array(*map(F.lit, MEAN)), F.array(*map(F.lit, DEVIATION))
    return F.transform(pixels, lambda v, i: (v.cast("double") / most - F.element_at(mean, i % 3 + 1)) / F.element_at(deviation, i % 3 + 1))


def class_and_mean(tokens: Column, registers: int = REGISTERS) -> Column:
    """The class token followed by the mean of the patch tokens, in double; register tokens are left out."""
    patches = F.slice(tokens, F.lit(registers + 2), F.size(tokens) - registers - 1)
    first = F.transform(F.element_at(tokens, 1), lambda v: v.cast("double"))
    zero = F.transform(first, lambda v: v * 0.0)
    total = F.aggregate(patches, zero, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b.cast("double")))
    return F.concat(first, F.transform(total, lambda v: v / F.size(patches)))


def in_tokens(values: Column, width: int) -> Column:
    """A flat array cut into tokens of `width` values."""
    places = F.sequence(F.lit(0), F.floor(F.size(values) / width).cast("int") - 1)
    return F.transform(places, lambda i: F.slice(values, i * width + 1, F.lit(width)))
