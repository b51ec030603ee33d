"""Union of numbered things within one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """``root[i]`` is the least number that ``i`` has been linked to."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while (a != b).any():
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            a, b = self.root[a], self.root[b]
