"""Column forms of a search in a sorted list of constants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_below(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie below ``key``: by groups of cuts, then inside one group."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[at : at + step] for at in range(0, len(cuts), step)]

    def below(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda n, c: n + (c < key).cast("int"))

    full = below(F.array(*[F.lit(g[-1]) for g in groups]))
    inner = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), full)
    return F.least(full * step + F.coalesce(below(inner), F.lit(0)), F.lit(len(cuts)))
