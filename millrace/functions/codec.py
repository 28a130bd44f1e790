"""A canonical, reversible text form of Python values.

Equal values have equal text, whatever the process or the order in which sets
and dictionaries were filled, so the text serves as key, as stored value and
as the input of stable hashes.  Every value is a JSON list ``[tag, ...]``; a type
that is not listed cannot be encoded.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import json
import math
from typing import Any

_CLASSES: dict[str, type] = {}


def register_class(name: str, cls: type) -> None:
    """Let dataclass ``cls`` be decoded from ``name``; the last registration counts."""
    _CLASSES[name] = cls


def class_name(cls: type) -> str:
    return getattr(cls, "__type_name__", f"{cls.__module__}.{cls.__qualname__}")


def _text(tree: Any) -> str:
    return json.dumps(tree, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _float(x: float) -> str:
    # All NaNs are one; -0.0 and 0.0 are two.
    return "nan" if math.isnan(x) else x.hex()


def to_tree(x: Any) -> list:  # noqa: PLR0911, PLR0912
    """The value as nested tagged lists."""
    if x is None:
        return ["n"]
    if isinstance(x, bool):
        return ["b", int(x)]
    if isinstance(x, int):
        return ["i", str(x)]
    if isinstance(x, float):
        return ["f", _float(x)]
    if isinstance(x, str):
        return ["s", x]
    if isinstance(x, (bytes, bytearray)):
        return ["y", bytes(x).hex()]
    if isinstance(x, decimal.Decimal):
        return ["d", str(x)]
    if isinstance(x, dt.datetime):
        return ["t", x.isoformat()]
    if isinstance(x, dt.date):
        return ["a", x.isoformat()]
    if isinstance(x, dt.timedelta):
        return ["p", x.days, x.seconds, x.microseconds]
    if isinstance(x, range):
        return ["r", x.start, x.stop, x.step]
    if isinstance(x, list):
        return ["l", *map(to_tree, x)]
    if isinstance(x, tuple):
        return ["u", *map(to_tree, x)]
    if isinstance(x, (set, frozenset)):
        return ["S" if isinstance(x, set) else "F", *sorted(map(to_tree, x), key=_text)]
    if isinstance(x, dict):
        return ["m", *sorted(([to_tree(k), to_tree(v)] for k, v in x.items()), key=_text)]
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        kept = [f for f in dataclasses.fields(x) if not f.metadata.get("skip")]
        return ["c", class_name(type(x)), *([f.name, to_tree(getattr(x, f.name))] for f in kept)]
    raise TypeError(f"values of type {type(x).__name__} have no canonical form")


def from_tree(t: list) -> Any:  # noqa: PLR0911, PLR0912
    """The value of a tree; fields that were skipped get their default."""
    tag, *rest = t
    match tag:
        case "n":
            return None
        case "b":
            return bool(rest[0])
        case "i":
            return int(rest[0])
        case "f":
            return math.nan if rest[0] == "nan" else float.fromhex(rest[0])
        case "s":
            return rest[0]
        case "y":
            return bytes.fromhex(rest[0])
        case "d":
            return decimal.Decimal(rest[0])
        case "t":
            return dt.datetime.fromisoformat(rest[0])
        case "a":
            return dt.date.fromisoformat(rest[0])
        case "p":
            return dt.timedelta(*rest)
        case "r":
            return range(*rest)
        case "l":
            return [from_tree(x) for x in rest]
        case "u":
            return tuple(from_tree(x) for x in rest)
        case "S":
            return {from_tree(x) for x in rest}
        case "F":
            return frozenset(from_tree(x) for x in rest)
        case "m":
            return {from_tree(k): from_tree(v) for k, v in rest}
        case "c":
            name, *fields = rest
            if name not in _CLASSES:
                raise ValueError(f"class {name} is not registered")
            return _CLASSES[name](**{k: from_tree(v) for k, v in fields})
    raise ValueError(f"unknown tag {tag!r}")


def encode(x: Any) -> str:
    return _text(to_tree(x))


def decode(s: str) -> Any:
    return from_tree(json.loads(s))
