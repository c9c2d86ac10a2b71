"""Driver-side loops over tables: every round's state is cut in the shared folder, its predecessor deleted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loomgraph.plans.shared import forget, written


class FailedToConvergeError(RuntimeError):
    """No fixpoint within the rounds allowed."""


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], stop: Callable[[DataFrame, int], bool] | None, rounds: int, every: int = 1) -> tuple[DataFrame, bool]:
    """Applies ``step`` up to ``rounds`` times until ``stop`` holds for a state; that state, and whether it did. Lineage is cut each ``every`` rounds."""
    spark, path = state.sparkSession, None
    for i in range(1, rounds + 1):
        state = step(state, i)
        if i % every == 0 or i == rounds or stop:
            old, (state, path) = path, written(state)
            if old:
                forget(spark, old)
        if stop and stop(state, i):
            return state, True
    return state, stop is None
