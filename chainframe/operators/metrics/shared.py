"""Vectors that a set of rules shares: each is computed and stored once, whatever the number of
rules on it, and the metrics are scanned once for all of them.

A rule's expression asks a ``Vectors`` for what it reads. Asked before ``prepare``, it only notes the
request (function, window and metric name) and answers with an empty vector, so the rules themselves
tell what is needed; afterwards it filters the stored vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.operators.metrics import ranges as R
from chainframe.session import stored

FUNCTIONS = {"instant": R.instant, "rate": R.rate, "increase": R.increase, "irate": R.irate, "deriv": R.deriv, "changes": R.changes,
             "avg_over_time": R.avg_over_time, "max_over_time": R.max_over_time, "min_over_time": R.min_over_time}
_EMPTY = "name string, labels map<string,string>, series_key string, eval_ts timestamp_ntz, value double"


class Vectors:
    def __init__(self, metrics: DataFrame, grid: R.Grid) -> None:
        self._metrics, self._grid = metrics, grid
        self.wanted: dict[tuple[str, str], set[str]] = {}  # (function, window) to metric names
        self._tables: dict[tuple[str, str], DataFrame] | None = None

    def prepare(self) -> Vectors:
        """Computes what has been asked for: one table a function and window."""
        names = sorted(set().union(*self.wanted.values())) if self.wanted else []
        own = stored(self._metrics.filter(F.col("name").isin(names)), "rule-metrics")
        self._tables = {}
        for (fn, window), some in self.wanted.items():
            rows = own.filter(F.col("name").isin(sorted(some)))
            vector = R.instant(rows, self._grid, window) if fn == "instant" else FUNCTIONS[fn](rows, window, self._grid)
            self._tables[fn, window] = stored(vector, f"rule-{fn}")
        return self

    def get(self, fn: str, window: str, name: str, *matchers: tuple[str, str, str]) -> DataFrame:
        """The vector of ``fn(name{matchers}[window])``; for ``instant`` the window is the lookback."""
        if self._tables is None:
            self.wanted.setdefault((fn, window), set()).add(name)
            return self._metrics.sparkSession.createDataFrame([], _EMPTY)
        return R.select(self._tables[fn, window], name, list(matchers))

    def instant(self, name: str, *matchers: tuple[str, str, str], lookback: str = "5m") -> DataFrame:
        return self.get("instant", lookback, name, *matchers)
