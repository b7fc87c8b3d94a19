"""Queries by name, each with the inventory ids it covers and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}
#: Added before rounding, so that values that end in a 5 round alike in every engine.
NUDGE = "1e-9"


def expand(sql: str) -> str:
    """Write out r4(x) and r6(x): rounding as the functions of that name round columns."""
    while m := re.search(r"\br([46])\(", sql):
        at, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[: m.start()]}round(({sql[m.end() : at - 1]}) + {NUDGE}::DOUBLE, {m[1]}){sql[at:]}"
    return sql


def query(name: str, ids: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def keep(f):
        if name in ENTRIES:
            raise ValueError(f"two queries named {name}")
        ENTRIES[name] = Entry(name, tuple(ids.split()), f, sql and expand(sql))
        return f

    return keep
