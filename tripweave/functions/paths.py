"""Expressions on paths held as ``ARRAY<BIGINT>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(path: Column, before: Column | None = None) -> Column:
    """Drop elements equal to the one just before them (O1).

    ``before`` is what counts as standing in front of the first element; by default nothing does.
    """

    def keep(x: Column, i: Column) -> Column:
        prev = F.get(path, i - 1)
        if before is not None:
            return x != F.coalesce(prev, before)
        return prev.isNull() | (x != prev)

    return F.filter(path, keep)


def slice_sites(path: Column, first: Column, last: Column) -> Column:
    """Elements at 0-based sites first..last, both included (O6); empty when last < first."""
    return F.slice(path, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))


def first_site(path: Column, x: Column) -> Column:
    """0-based site of the first occurrence, -1 when absent."""
    return F.array_position(path, x) - 1


def tail_after(path: Column, site: Column) -> Column:
    """Everything strictly after a 0-based site."""
    return F.slice(path, (site + 2).cast("int"), F.size(path))


def visits_in_order(vertices: Column, o: Column, d: Column) -> Column:
    """Some visit of d comes strictly after the first visit of o."""
    at = first_site(vertices, o)
    return (at >= 0) & F.array_contains(tail_after(vertices, F.greatest(at, F.lit(0))), d)


def contains_sub_route(edges: Column, sub: Column) -> Column:
    """``sub`` lies in ``edges`` as one run starting at the first occurrence of its first edge."""
    head = F.get(sub, F.lit(0))
    at = F.array_position(edges, head)
    return F.coalesce(
        (at > 0) & (F.slice(edges, F.greatest(at, F.lit(1)).cast("int"), F.size(sub)) == sub), F.lit(False)
    )


def same_route(a: Column, b: Column) -> Column:
    """Same edges in the same order."""
    return a == b


def edge_count(edges: Column, vertices: Column | None = None) -> Column:
    """Number of edges; the vertex form wins when both are known."""
    by_edges = F.size(edges)
    if vertices is None:
        return by_edges.cast("bigint")
    return F.coalesce(F.when(vertices.isNotNull(), F.size(vertices) - 1), by_edges).cast("bigint")


def path_text(path: Column) -> Column:
    """Comma-joined ids."""
    return F.array_join(path.cast("array<string>"), ",")
