"""Where counts of a running stack go: an exporter gets them, batch by batch or from streaming progress."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from relayloom.operators.metrics import COUNTERS

#: Counter of each command.
OF_ACTION = {"done": "dispatch_success", "retry": "dispatch_failure", "defer": "dispatch_deferred", "dead": "dispatch_dead"}


class Exporter:
    """Override what is of interest; by default nothing is kept."""

    def add(self, counter: str, n: int) -> None: ...

    def queue_depth(self, source: str, depth: int) -> None: ...

    def oldest_lag_ms(self, lag: int) -> None: ...

    def latency_ms(self, count: int, total: int, largest: int | None) -> None: ...

    def listener_ms(self, count: int, total: float, largest: float | None) -> None: ...

    def close(self) -> None: ...


class Recorder(Exporter):
    """Keeps everything in memory, for tests and small tools."""

    def __init__(self):
        self.counters: Counter[str] = Counter(dict.fromkeys(COUNTERS, 0))
        self.depths: dict[str, int] = {}
        self.lag, self.latencies, self.durations = 0, [], []

    def add(self, counter: str, n: int) -> None:
        self.counters[counter] += n

    def queue_depth(self, source: str, depth: int) -> None:
        self.depths[source] = depth

    def oldest_lag_ms(self, lag: int) -> None:
        self.lag = lag

    def latency_ms(self, count: int, total: int, largest: int | None) -> None:
        self.latencies.append((count, total, largest))

    def listener_ms(self, count: int, total: float, largest: float | None) -> None:
        self.durations.append((count, total, largest))


def observed(commands: DataFrame, name: str = "commands") -> DataFrame:
    """commands with their counts as an observation, which costs no extra pass; see ProgressListener."""
    return commands.observe(name, *[F.count(F.when(F.col("action") == a, 1)).alias(c) for a, c in OF_ACTION.items()])


class ProgressListener(StreamingQueryListener):
    """Passes the observations of streaming queries on to an exporter; add it with spark.streams.addListener."""

    def __init__(self, exporter: Exporter, name: str = "commands"):
        self.exporter, self.name = exporter, name

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for counter, n in row.asDict().items():
                self.exporter.add(counter, n)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
