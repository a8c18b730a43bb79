"""Groups of ranges that overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def overlap_groups(ranges: Mapping[str, Sequence[tuple | None]]) -> list[list[str]]:
    """Connected components of items whose ranges overlap in every dimension; None overlaps everything.

    Items are swept in order of the first dimension, so only those that overlap there are compared.
    """
    names = sorted(ranges)
    parent = {n: n for n in names}

    def root(n: str) -> str:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    def meet(a: Sequence[tuple | None], b: Sequence[tuple | None]) -> bool:
        return all(x is None or y is None or x[0] <= y[1] and y[0] <= x[1] for x, y in zip(a, b, strict=True))

    known = sorted((n for n in names if ranges[n] and ranges[n][0] is not None), key=lambda n: ranges[n][0][0])
    unknown = [n for n in names if not (ranges[n] and ranges[n][0] is not None)]
    open_: list[str] = []
    for n in known:
        open_ = [m for m in open_ if ranges[m][0][1] >= ranges[n][0][0]]
        for m in open_:
            if meet(ranges[m], ranges[n]):
                parent[root(m)] = root(n)
        open_.append(n)
    for n in unknown:
        for m in names:
            if m != n and meet(ranges[m], ranges[n]):
                parent[root(m)] = root(n)
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(root(n), []).append(n)
    return sorted(groups.values())
