"""Named operators: dispatch by name, as a registry of tools, and loading of plug-ins by path."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    OPERATORS[function.__name__] = function
    return function


def run(name: str, *args, **options) -> DataFrame:
    """Call a registered operator; an unknown name raises with the known ones."""
    if name not in OPERATORS:
        raise KeyError(f"no operator {name!r}; there are {sorted(OPERATORS)}")
    return OPERATORS[name](*args, **options)


def load(path: str) -> Callable[..., DataFrame]:
    """A callable named ``module:function``."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)
