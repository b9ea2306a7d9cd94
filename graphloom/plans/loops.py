"""Iteration: a step per hop, the state cut after each so that lineage stays short and executors may be lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import Scratch


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int, settled: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """``step`` applied ``most`` times, or until ``settled``(before, after).

    Every state is written to the shared folder and read back; only the last one is kept, as a reliable checkpoint.
    """
    with Scratch(state.sparkSession, "loop") as scratch:
        now = scratch.cut(state, "s0")
        for k in range(most):
            before, now = now, scratch.cut(step(now, k), f"s{k + 1}")
            done = settled is not None and settled(before, now)
            scratch.drop(f"s{k}")
            if done:
                break
        return scratch.keep(now)


def unrolled(start: str, step: Callable[[str, int], str], times: int, last: str, before: str = "") -> str:
    """A chain of CTEs: s0 AS (start), s1 AS (step of s0), ..., then ``last`` with {s} for the name of the last state."""
    ctes = [before] if before else []
    ctes.append(f"s0 AS MATERIALIZED ({start})")
    ctes += [f"s{k + 1} AS MATERIALIZED ({step(f's{k}', k)})" for k in range(times)]
    return "WITH " + ",\n".join(ctes) + "\n" + last.format(s=f"s{times}")
