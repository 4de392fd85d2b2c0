"""Families of graphs as lists of faces, vertices counted from 1."""

from __future__ import annotations


def cycle_pair(n: int) -> list[list[int]]:
    """Inside and outside of an n-cycle."""
    return [list(range(1, n + 1))] * 2


def wheel(n: int) -> list[list[int]]:
    """Hub 1 and rim 2..n+1."""
    rim = list(range(2, n + 2))
    return [[1, rim[i], rim[(i + 1) % n]] for i in range(n)] + [rim[::-1]]


def theta(a: int, b: int, c: int) -> list[list[int]]:
    """Poles 1 and 2 joined by three paths with a, b and c inner vertices."""
    paths, at = [], 3
    for n in (a, b, c):
        paths.append(list(range(at, at + n)))
        at += n
    return [[1, *p, 2, *q[::-1]] for p, q in zip(paths, paths[1:] + paths[:1])]


def grid(rows: int, columns: int) -> list[list[int]]:
    """Unit squares of a grid of vertices, and the outer face."""
    v = lambda r, c: r * columns + c + 1
    squares = [[v(r, c), v(r, c + 1), v(r + 1, c + 1), v(r + 1, c)] for r in range(rows - 1) for c in range(columns - 1)]
    rim = [v(0, c) for c in range(columns)] + [v(r, columns - 1) for r in range(1, rows)] + [v(rows - 1, c) for c in range(columns - 2, -1, -1)] + [v(r, 0) for r in range(rows - 2, 0, -1)]
    return [*squares, rim]


def path_walk(n: int) -> list[list[int]]:
    """The one face of a path of n vertices: there and back."""
    return [list(range(1, n + 1)) + list(range(n - 1, 1, -1))]


def star_walk(n: int) -> list[list[int]]:
    """The one face of a star with n leaves."""
    return [[v for leaf in range(2, n + 2) for v in (1, leaf)]]


def tree_walk(children: dict[int, list[int]], root: int = 1) -> list[list[int]]:
    """The one face around a rooted plane tree."""

    def around(v: int) -> list[int]:
        out = [v]
        for c in children.get(v, []):
            out += [*around(c), v]
        return out

    return [around(root)[:-1]]
