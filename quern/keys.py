"""Key specifications: "c", ["a", "b"], [f, "c"], [[f, "c"], "d"], [[f, "c"], ["d"]]."""

from __future__ import annotations

from .errors import OperationError


def function_name(fn) -> str:
    return getattr(fn, "name", None) or getattr(fn, "__name__", type(fn).__name__)


def parse_keys(spec) -> list[tuple[object, str]]:
    """[(function or None, column)]"""
    if isinstance(spec, str):
        return [(None, spec)]
    spec = list(spec)
    if len(spec) == 2 and callable(spec[0]) and isinstance(spec[1], str):
        return [(spec[0], spec[1])]
    out: list[tuple[object, str]] = []
    for part in spec:
        if isinstance(part, str):
            out.append((None, part))
        elif isinstance(part, (list, tuple)) and len(part) == 1 and isinstance(part[0], str):
            out.append((None, part[0]))
        elif isinstance(part, (list, tuple)) and len(part) == 2 and callable(part[0]) and isinstance(part[1], str):
            out.append((part[0], part[1]))
        else:
            raise OperationError(f"no key specification: {part!r}")
    if not out:
        raise OperationError("no keys are given")
    return out


def key_name(fn, column: str) -> str:
    return column if fn is None else f"{function_name(fn)}({column})"
