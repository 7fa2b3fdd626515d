"""JSON containment, the one JSON operator that Spark has no expression for."""

from __future__ import annotations

import json


def contains(a, b) -> bool:
    """Whether JSON value a holds b: objects by keys, arrays by members, scalars by equality."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        wanted = b if isinstance(b, list) else [b]
        return all(any(contains(x, y) for x in a) for y in wanted)
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def json_contains(a: str | None, b: str | None) -> bool | None:
    """NULL for a null or for text that is no JSON."""
    if a is None or b is None:
        return None
    try:
        return contains(json.loads(a), json.loads(b))
    except ValueError:
        return None
