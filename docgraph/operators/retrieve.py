"""Lookups by key and by file name, and their dispatch by the kind of request."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The rows with the key: a filter that reaches the scan. A null key finds nothing."""
    return df.where(F.col(key) == F.lit(value))


def safe_path(base: str, name: str) -> str:
    """``name`` under ``base``; names that lead out of it are refused."""
    root = posixpath.normpath(base)
    found = posixpath.normpath(posixpath.join(root, name))
    if found != root and not found.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name!r} is not under the base folder")
    return found


def by_file(df: DataFrame, base: str, name: str, path: str = "path") -> DataFrame:
    """The stored file of that name under ``base``."""
    return df.where(F.regexp_replace(path, r"^file:/*", "/") == safe_path(base, name))


class UnknownRequest(ValueError):
    pass


class Dispatcher:
    """Handlers by the type of a request; a handler's failure names the type."""

    def __init__(self, **handlers: Callable[..., DataFrame]) -> None:
        self.handlers = handlers

    def __call__(self, kind: str, **request: Any) -> DataFrame:
        if kind not in self.handlers:
            raise UnknownRequest(f"no handler for {kind!r}: there are {sorted(self.handlers)}")
        try:
            return self.handlers[kind](**request)
        except TypeError as e:
            raise ValueError(f"a request of type {kind!r} can't be answered: {e}") from e
