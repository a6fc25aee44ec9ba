"""Spanning forests of small link matrices."""

from __future__ import annotations

import numpy as np


def forest(m: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric boolean matrix joins; each row is read once."""
    todo, out = np.ones(len(m), bool), []
    for i in np.flatnonzero(m.sum(1) > m.diagonal()):
        if not todo[i]:
            continue
        todo[i] = False
        stack = [int(i)]
        while stack:
            v = stack.pop()
            new = np.flatnonzero(m[v] & todo)
            todo[new] = False
            out += [(v, int(x)) for x in new]
            stack += new.tolist()
    return out


def forest_between(m: np.ndarray) -> list[tuple[int, int]]:
    """The same for links between rows and columns: edges (row, column)."""
    rows, cols, turned, out = np.ones(m.shape[0], bool), np.ones(m.shape[1], bool), np.ascontiguousarray(m.T), []
    for i in np.flatnonzero(m.any(1)):
        if not rows[i]:
            continue
        rows[i] = False
        stack = [(int(i), True)]
        while stack:
            v, is_row = stack.pop()
            line, todo = (m[v], cols) if is_row else (turned[v], rows)
            new = np.flatnonzero(line & todo)
            todo[new] = False
            out += [(v, int(x)) if is_row else (int(x), v) for x in new]
            stack += [(int(x), not is_row) for x in new]
    return out
