"""A message stream folded to the latest state of each job, in batch and as a stream.

Messages are (job_id, seq, status, progress, error). The latest message by seq gives the
status and progress; an error stays until a later message that isn't one clears it.
"""

from __future__ import annotations

from collections.abc import Iterator

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitelens.durable import shared_folder

DONE = ("ready", "error")


def latest_state(messages: DataFrame) -> DataFrame:
    """(job_id, seq, status, progress, error, done): one row a job, by a mergeable aggregate."""
    latest = F.max_by(F.struct("seq", "status", "progress", F.when(F.col("status") == "error", F.col("error")).alias("error")), "seq")
    return messages.groupBy("job_id").agg(latest.alias("s")).select("job_id", "s.*", F.col("s.status").isin(*DONE).alias("done"))


def batch_complete(states: DataFrame) -> DataFrame:
    """One row: number of jobs, of those done, and whether all are."""
    return states.agg(F.count("*").alias("jobs"), F.coalesce(F.sum(F.col("done").cast("long")), F.lit(0)).alias("finished")).withColumn("complete", F.col("jobs") == F.col("finished"))


def stream_latest_state(messages: DataFrame) -> DataFrame:
    """The same over a stream, in update mode: a job's row whenever it changes."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None, None)
        for rows in batches:
            top = rows.loc[rows["seq"].idxmax()]
            if now[0] is None or top["seq"] > now[0]:
                now = (int(top["seq"]), top["status"], float(top["progress"]), top["error"] if top["status"] == "error" else None)
        state.update(now)
        yield pd.DataFrame([(key[0], *now, now[1] in DONE)], columns=["job_id", "seq", "status", "progress", "error", "done"])

    return messages.groupBy("job_id").applyInPandasWithState(
        fold,
        "job_id long, seq long, status string, progress double, error string, done boolean",
        "seq long, status string, progress double, error string",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def batches_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there and give the rows of all its batches, with their batch_id.

    Offsets, state and rows lie in the shared folder; a batch that runs again after a lost
    executor replaces its own rows, and nothing passes through the driver.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch_id=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch}")

    running = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(f"{folder}/rows")
