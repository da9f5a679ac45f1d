"""Map / dimension expressions (native higher-order functions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sorted_entries(dims) -> Column:
    """Entries of a map, ascending by key."""
    return F.sort_array(F.map_entries(_c(dims)))


def series_key(dims) -> Column:
    """Canonical key of a dimension map: for each entry in key order,
    ``len(key) key len(value) value`` (lengths in characters)."""
    return entries_key(sorted_entries(dims))


def entries_key(entries) -> Column:
    """:func:`series_key` of entries that are in key order."""
    return F.array_join(F.transform(_c(entries), lambda e: F.concat(
        F.length(e["key"]).cast("string"), e["key"], F.length(e["value"]).cast("string"), e["value"])), "")


def render_map(dims, sep: str = ";") -> Column:
    """``k=v;k=v`` in key order: a stable, hashable text form of a map."""
    return F.array_join(F.transform(sorted_entries(dims), lambda e: F.concat(e["key"], F.lit("="), e["value"])), sep)


def index_subsets(n: Column, max_size: int) -> Column:
    """All subsets of ``{0 .. n-1}`` with at most ``max_size`` members, as
    ascending index arrays (the empty one included). Built level by level:
    each subset of size j is extended by every index above its last one."""
    idx = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    level = F.array(F.array().cast("array<int>"))
    out = level
    for _ in range(max_size):
        level = F.flatten(F.transform(level, lambda s: F.transform(
            F.filter(idx, lambda i: i > F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(-1))),
            lambda i: F.concat(s, F.array(i)))))
        out = F.concat(out, level)
    return out


def _subsets_py(n: int, max_size: int) -> list[list[int]]:
    from itertools import combinations

    return [list(c) for k in range(max_size + 1) for c in combinations(range(n), k)]


def index_subsets_fast(n: Column, max_size: int, table_up_to: int = 16) -> Column:
    """:func:`index_subsets` with the answers for ``n <= table_up_to`` read from
    a constant table (one ``element_at`` per row instead of nested lambdas);
    larger ``n`` falls back to the general expression."""
    table = F.array(*[F.array(*[F.array(*[F.lit(i) for i in s]).cast("array<int>") for s in _subsets_py(k, max_size)])
                      for k in range(table_up_to + 1)])
    return F.when(n <= table_up_to, F.element_at(table, n + 1)).otherwise(index_subsets(n, max_size))
