"""Registered queries and their SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from . import io_queries  # noqa: F401  its queries are among the frames'
    from .data_queries import QUERIES as data
    from .frame_queries import QUERIES as frames

    return frames | data


def all_oracles() -> dict:
    from . import io_queries  # noqa: F401
    from .data_queries import ORACLES as data
    from .frame_queries import ORACLES as frames

    return frames | data
