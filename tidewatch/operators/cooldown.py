"""Greedy cooldown: which triggers of a rule fire when each firing blocks the next for a while."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.fold import Kernel, Steps, ordered_fold


class CooldownKernel(Kernel):
    """The state is the time of the last firing in microseconds."""

    outputs = T.StructType([T.StructField("fired", T.BooleanType())])
    needs = ("__us",)

    def __init__(self, cooldown_seconds: float) -> None:
        self.micros = round(cooldown_seconds * 1_000_000)

    def run(self, state: Any, cols: dict[str, Any], lo: int, hi: int, out: dict[str, list] | None) -> Any:
        times = cols["__us"]
        fired = [False] * (hi - lo) if out is not None else None
        at = lo if state is None else bisect_left(times, state + self.micros, lo, hi)
        while at < hi:
            state = int(times[at])
            if fired is not None:
                fired[at - lo] = True
            at = bisect_left(times, state + self.micros, at + 1, hi)
        if out is not None:
            out["fired"].extend(fired)
        return state

    def transfer(self, cols: dict[str, np.ndarray]) -> Steps:
        """The last firing of a run of rows by the last one before it.

        An entry decides which row fires first, and from there each firing decides the next; where a chain ends follows for
        all rows at once by doubling the steps. Only rows within a cooldown of the first can be the first to fire.
        """
        times = cols["__us"]
        n = len(times)
        index = np.arange(n)
        following = np.maximum(np.searchsorted(times, times + self.micros), index + 1)
        ends = np.where(following < n, following, index)
        while not np.array_equal(further := ends[ends], ends):
            ends = further
        firsts = slice(0, int(np.searchsorted(times - self.micros, times[0])) + 1)
        return Steps((times - self.micros)[firsts], times[ends][firsts])


def cooldown_firings(
    triggers: DataFrame,
    key: str,
    order: Sequence[str],
    cooldown_seconds: float,
    ts: str = "ts",
    partitions: int | None = None,
) -> DataFrame:
    """Triggers with ``fired``. ``order`` starts with ``ts`` and names each row of the key uniquely."""
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0))
    timed = triggers.withColumn("__us", micros)
    return ordered_fold(timed, key, order, CooldownKernel(cooldown_seconds), partitions).drop("__us")
