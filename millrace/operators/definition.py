"""How queries are declared: key classes, executors, styles."""

from __future__ import annotations

import dataclasses
import inspect
import re
from collections.abc import Callable, Iterable
from enum import Enum
from typing import Any

from millrace.functions.codec import class_name, register_class


class Style(Enum):
    """How an executor's node takes part in invalidation."""

    NORMAL = "normal"
    #: Dirtiness stops here; callers become dirty only when the value has really changed.
    FIREWALL = "firewall"
    #: Takes a slice out of a firewall or projection; runs again as soon as that has changed.
    PROJECTION = "projection"
    #: A leaf that reads the outside world; runs once, then on refresh only.
    EXTERNAL = "external"


#: The kind of a node whose value was set by a session.
INPUT = "input"


class MillraceError(Exception):
    """Base of this library's errors."""


class MissingExecutor(MillraceError):
    """No executor is registered for a key's type, and no value was set."""


class NoCycleValue(MillraceError):
    """A member of a dependency cycle has no value to fall back on."""


class RuleError(MillraceError):
    """An executor broke a rule of its style."""


class CyclicRead(BaseException):
    """Unwinds an executor that is part of a cycle; not an ``Exception``, so executors don't catch it by chance."""


def query(cls: type | None = None, *, name: str | None = None, version: int = 1, method: str | None = None, spread: bool = False) -> Any:
    """Make a class a query key: a frozen dataclass with a stable type name.

    ``method`` adds a method of that name to contexts, taking the key, or with
    ``spread`` the key's fields. A new ``version`` makes stored nodes of older ones unknown.
    """

    def make(c: type) -> type:
        out = dataclasses.dataclass(frozen=True)(c)
        out.__type_name__ = f"{name or f'{c.__module__}.{c.__qualname__}'}@{version}"
        register_class(out.__type_name__, out)
        if method:
            METHODS[method] = (lambda ctx, *a, **k: ctx.query(out(*a, **k))) if spread else (lambda ctx, key: ctx.query(key))
        return out

    return make(cls) if cls is not None else make


#: Methods of contexts by name, added by ``query(method=...)``.
METHODS: dict[str, Callable] = {}


@dataclasses.dataclass
class Executor:
    """How the value of one key type is computed. ``runs`` counts calls."""

    key_type: type
    compute: Callable[[Any, Any], Any]
    style: Style = Style.NORMAL
    cycle_value: Callable[[], Any] | None = None
    runs: int = 0

    @property
    def type_name(self) -> str:
        return class_name(self.key_type)


def executor(key_type: type, *, style: Style = Style.NORMAL, cycle_value: Callable[[], Any] | None = None, program: list | None = None) -> Callable[[Callable], Executor]:
    """Turn a function ``(key, ctx) -> value`` into an executor; with ``program`` also append it there."""

    def make(f: Callable) -> Executor:
        if len(inspect.signature(f).parameters) != 2:
            raise RuleError(f"{f.__name__} must take a key and a context")
        out = Executor(key_type, f, style, cycle_value)
        if program is not None:
            program.append(out)
        return out

    return make


class Registry:
    """Executors by type name; the last registration counts."""

    def __init__(self) -> None:
        self._by_name: dict[str, Executor] = {}

    def add(self, *executors: Executor) -> None:
        for e in executors:
            self._by_name[e.type_name] = e

    def add_program(self, program: Iterable[Executor]) -> None:
        self.add(*program)

    def find(self, type_name: str) -> Executor | None:
        return self._by_name.get(type_name)

    def get(self, type_name: str) -> Executor:
        found = self.find(type_name)
        if found is None:
            raise MissingExecutor(type_name)
        return found

    def short(self, type_name: str) -> str:
        """A type's name for people; unknown types are named as such."""
        if type_name not in self._by_name:
            return f"Unknown({type_name})"
        return re.sub(r"@\d+$", "", type_name).rpartition(".")[2]
