"""Clamped lines, the functions of one number that stay among themselves when one follows another."""

from __future__ import annotations

import math
from typing import NamedTuple


class Line(NamedTuple):
    """x → slope · x + shift, held between ``low`` and ``high``; the slope is 1 or -1."""

    slope: int = 1
    shift: float = 0
    low: float = -math.inf
    high: float = math.inf

    def __call__(self, x: float) -> float:
        return max(self.low, min(self.high, self.slope * x + self.shift))

    def then(self, after: Line) -> Line:
        """This line followed by another one."""
        ends = sorted(after.slope * end + after.shift for end in (self.low, self.high))
        low, high = (max(after.low, min(after.high, end)) for end in ends)
        return Line(self.slope * after.slope, after.slope * self.shift + after.shift, low, high)


def towards(x: float, goal: float, steps: float, down: float, up: float) -> float:
    """Where ``x`` is after some steps towards a goal it doesn't pass."""
    return max(goal, x - steps * down) if x > goal else min(goal, x + steps * up)
