"""A quasi-Newton minimiser that is asked for a point and told what was found there, so that finding can be a Spark job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Minimiser:
    """BFGS with backtracking over a handful of unconstrained parameters.

    `trial` is the point to look at next; `tell` takes its value and gradient. The best point so far is `at`, with its
    `value`. All state is in plain numbers, so it can be kept in a row of a table between rounds (`state`, `restored`).
    """

    def __init__(self, start: np.ndarray, tolerance: float = 1e-8, rounds: int = 300):
        self.at = self.trial = np.asarray(start, float)
        self.tolerance, self.left = tolerance, rounds
        self.value, self.slope = np.inf, np.zeros_like(self.at)
        self.inverse, self.step, self.fresh, self.done = np.eye(len(self.at)), 1.0, True, False

    def tell(self, value: float, slope: np.ndarray) -> None:
        self.left -= 1
        good = np.isfinite(value) and np.isfinite(slope).all()
        moved = self.trial - self.at
        if not np.isfinite(self.value):
            if not good:
                self.done = True
                return
            self.value, self.slope = value, slope
        elif good and value <= self.value + 1e-4 * float(self.slope @ moved):
            change, gained = slope - self.slope, self.value - value
            along = float(moved @ change)
            if along > 1e-14 * np.linalg.norm(moved) * np.linalg.norm(change):
                if self.fresh:
                    self.inverse *= along / float(change @ change)
                    self.fresh = False
                left = np.eye(len(moved)) - np.outer(moved, change) / along
                self.inverse = left @ self.inverse @ left.T + np.outer(moved, moved) / along
            self.at, self.value, self.slope = self.trial, value, slope
            if np.abs(slope).max() < self.tolerance or gained <= 1e-15 * (1 + abs(value)):
                self._again(gained)
        else:
            fall = -float(self.slope @ moved)
            rise = value - self.value + fall if good else np.inf
            self.step *= min(0.5, max(0.1, 0.5 * fall / rise)) if np.isfinite(rise) and rise > 0 else 0.1
            if self.step < 1e-10:
                self._again(0.0)
            else:
                self.trial = self.at + self.step * self._direction()
            if self.left <= 0:
                self.done = True
            return
        self.step = 1.0
        self.trial = self.at + self._direction()
        if self.left <= 0:
            self.done = True

    def _again(self, gained: float) -> None:
        """Where no more is gained along the curvature that was gathered: once from scratch, then it is the end."""
        if self.fresh or np.abs(self.slope).max() < self.tolerance:
            self.done = True
        self.inverse, self.step, self.fresh = np.eye(len(self.at)), 1.0, True
        self.trial = self.at + self._direction()

    def _direction(self) -> np.ndarray:
        way = -self.inverse @ self.slope
        if self.slope @ way >= 0:
            self.inverse = np.eye(len(way))
            way = -self.slope
        return way * min(1.0, 2.0 / max(1e-300, np.abs(way).max()))

    def state(self) -> list[float]:
        return [len(self.at), self.tolerance, self.left, self.value, self.step, self.fresh, self.done, *self.at, *self.trial, *self.slope, *self.inverse.ravel()]

    @staticmethod
    def restored(state: list[float]) -> Minimiser:
        n = int(state[0])
        out = Minimiser(np.asarray(state[7 : 7 + n]), state[1], int(state[2]))
        rest = np.asarray(state[7:], float)
        out.value, out.step, out.fresh, out.done = state[3], state[4], bool(state[5]), bool(state[6])
        out.trial, out.slope, out.inverse = rest[n : 2 * n], rest[2 * n : 3 * n], rest[3 * n :].reshape(n, n)
        return out


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """The point and value that the minimiser ends at, if f gives a value and its gradient."""
    search = Minimiser(start, **options)
    while not search.done:
        search.tell(*f(search.trial))
    return search.at, search.value
