"""Callables by name, for encoders, transforms and clients that a job's parameters name."""

from __future__ import annotations

import importlib
from collections.abc import Callable


def resolve(name: str) -> Callable:
    """`package.module.attribute` to the attribute."""
    module, dot, attribute = name.rpartition(".")
    if not dot:
        raise ValueError(f"{name!r} names no module")
    found = getattr(importlib.import_module(module), attribute)
    if not callable(found):
        raise TypeError(f"{name!r} can't be called")
    return found
