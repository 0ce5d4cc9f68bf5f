"""A spanning forest of links found block by block, inside one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Labels of ``n`` items; ``add`` joins items pairwise, ``roots`` gives the items that have another one as root.

    ``add`` returns the places of the pairs that joined two trees; of several pairs that could, it takes the earliest.
    """

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.label[i], self.label[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return apart
        a, b = a[apart], b[apart]
        first = np.sort(np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)[1])
        used = np.zeros(len(first), bool)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for k, (x, y) in enumerate(zip(a[first].tolist(), b[first].tolist())):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                used[k] = True
        moved = np.arange(len(self.label))
        for x in list(root):
            moved[x] = find(x)
        self.label = moved[self.label]
        return apart[first[used]]

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        tied = np.flatnonzero(self.label != np.arange(len(self.label)))
        return tied, self.label[tied]
