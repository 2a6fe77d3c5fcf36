"""Named extension points: metrics, baselines, benchmarks."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    def add(self, name: str) -> Callable:
        if name in self:
            raise ValueError(f"{name} is registered already")

        def take(f: Callable) -> Callable:
            self[name] = f
            return f

        return take


METRICS, BASELINES, BENCHMARKS = Registry(), Registry(), Registry()
