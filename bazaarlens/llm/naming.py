"""Keeps the columns of a caller apart from those that operators add for their own use."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def names_apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Columns whose names begin with two underscores, as the operators' own ones do, pass through under other names.

    They come back as they were; an argument that names one of them is understood, too.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        other: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                name = "carried" + c
                while name.lower() in taken:
                    name = "carried_" + name
                taken.add(name.lower())
                other[c] = name
        if not other:
            return operator(docs, *args, **kwargs)
        named = lambda x: other.get(x, x) if isinstance(x, str) else x
        out = operator(docs.withColumnsRenamed(other), *map(named, args), **{k: named(v) for k, v in kwargs.items()})
        return out.withColumnsRenamed({new: old for old, new in other.items()})

    return run
