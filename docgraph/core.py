"""Settings, timing, safe calls and observers: driver-side helpers of the recipes."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable, Mapping
from contextlib import contextmanager
from copy import deepcopy
from typing import Any

from pyspark.sql import Column, DataFrame, Observation

log = logging.getLogger("docgraph")


class Config:
    """Nested settings by dotted keys; an environment variable KEY_IN_CAPITALS stands in for a key that is not set."""

    def __init__(self, values: Mapping[str, Any] | None = None) -> None:
        self._values: dict[str, Any] = deepcopy(dict(values or {}))

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self._values
        for part in key.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return os.environ.get(key.replace(".", "_").upper(), default)
            at = at[part]
        return at

    def section(self, key: str) -> dict[str, Any]:
        found = self.get(key, {})
        return dict(found) if isinstance(found, Mapping) else {}

    def set(self, key: str, value: Any) -> None:
        *path, last = key.split(".")
        at = self._values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    def merged(self, other: Mapping[str, Any]) -> Config:
        """A copy in which ``other``'s top-level keys win."""
        return Config({**self._values, **other})


def safe_run(call: Callable[[], Any], default: Any = None) -> Any:
    """The call's result, or ``default`` after a logged failure."""
    try:
        return call()
    except Exception:
        log.exception("a call failed; going on with %r", default)
        return default


@contextmanager
def timed(name: str, tell: Callable[[str, float], None] | None = None) -> Any:
    began = time.perf_counter()
    try:
        yield
    finally:
        took = time.perf_counter() - began
        log.debug("%s took %.3f s", name, took)
        if tell:
            safe_run(lambda: tell(name, took))


class Callbacks:
    """Observers of a run: on_start, on_finish, on_error. An observer's own failure never stops the run."""

    def __init__(self, *observers: Any) -> None:
        self.observers = observers

    def tell(self, event: str, *args: Any) -> None:
        for o in self.observers:
            if f := getattr(o, event, None):
                safe_run(lambda f=f: f(*args))

    def run(self, name: str, call: Callable[[], Any]) -> Any:
        self.tell("on_start", name)
        try:
            out = call()
        except Exception as e:
            self.tell("on_error", name, e)
            raise
        self.tell("on_finish", name, out)
        return out


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """The rows with measures that Spark takes on their way, without another pass."""
    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in measures.items()]), o
