"""Progress of jobs as rows: what each step of a batch job, and each batch of a stream, has read."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STEPS = "step string, at long, rows long, bytes long, share double"
BATCHES = "query string, batch long, rows long, observed long"
#: Batches of streams that are remembered; older ones go first.
MOST_BATCHES = 10_000


class JobProgress:
    """Counts of the steps of a batch job.

    ``watch`` gives a table back with its rows, and the bytes of one expression, counted as
    they pass by; nothing is read twice for it. ``rows`` waits for the counts of the steps
    whose action has begun, so it is called after these.
    """

    def __init__(self, steps: int):
        self.steps, self.seen = steps, []

    def watch(self, df: DataFrame, step: str, size: Column | None = None) -> DataFrame:
        observation = Observation(f"{step} {len(self.seen)}")
        self.seen.append((step, observation))
        bytes_ = F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.lit(0)
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), bytes_.cast("long").alias("bytes"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """Rows of STEPS in order; share is how much of the job's steps has passed."""
        made = [(step, k, o.get["rows"], o.get["bytes"], (k + 1) / self.steps) for k, (step, o) in enumerate(self.seen)]
        return spark.createDataFrame(made, STEPS)


class StreamProgress(StreamingQueryListener):
    """Rows of BATCHES for the batches of all streams while it listens.

    ``observed`` is the count that a stream's own ``observe(name, count(..) as rows)`` gave,
    if there is one named like ``metric``.
    """

    def __init__(self, metric: str = "progress"):
        self.metric, self.batches, self.ended = metric, deque(maxlen=MOST_BATCHES), {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(self.metric)
        self.batches.append((p.name, p.batchId, p.numInputRows, seen["rows"] if seen is not None else None))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.batches), BATCHES)
