"""First passage: the first bar at or after an entry whose price passes a level.

Running minima and maxima over stretches of 1, 2, 4, ... bars are built once per security. The first
bar below (or above) a level is then found by skipping the longest stretches that hold none, so a
question costs the logarithm of the bars, however late the answer lies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class FirstPassage:
    """Extremes of ``values`` over stretches of powers of two from every place; NaN never passes."""

    def __init__(self, values: np.ndarray, lowest: bool):
        self.count = len(values)
        idle = np.inf if lowest else -np.inf
        pick = np.minimum if lowest else np.maximum
        level = np.append(np.where(np.isnan(values), idle, values), idle)
        self.levels = [level]
        step = 1
        while step < self.count:
            ahead = np.concatenate([level[step:], np.full(min(step, len(level)), idle)])[: len(level)]
            level = pick(level, ahead)
            self.levels.append(level)
            step *= 2

    def after(self, start: np.ndarray, passes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """First place from each ``start`` on whose value ``passes``; ``count`` where none does.

        ``passes`` must hold for an extreme exactly if it holds for one of the values it stands for.
        """
        place = np.minimum(start, self.count).astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            clear = ~passes(self.levels[k][place])
            place = np.minimum(np.where(clear, place + (1 << k), place), self.count)
        return place


def next_true(flags: np.ndarray) -> np.ndarray:
    """Place of the first True at or after each place, the length where there is none."""
    places = np.where(flags, np.arange(len(flags)), len(flags))
    return np.append(np.minimum.accumulate(places[::-1])[::-1], len(flags)) if len(flags) else np.zeros(1, np.int64)
