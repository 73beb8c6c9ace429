"""Board crawls as a stream: each micro-batch of raw bodies is one ingest run against the store.

Exactly once: a version keeps the name of the batch that it was made of (the stream's checkpoint and the batch's number
there), so a batch that was committed before a failure is recognised and skipped, whatever else the store holds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..config import Profile
from ..plans.ingest import Store, ingest


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """Recorded bodies as they arrive: JSON lines of RAW."""
    return spark.readStream.schema(schemas.RAW).json(path)


def start_ingest(stream: DataFrame, store: Store, checkpoint: str, clock: Callable[[], datetime], boards_of: Callable[[DataFrame], list], profile: Profile | None = None):
    """A running query; boards_of names the boards of a batch (a small list)."""

    def run(batch: DataFrame, number: int) -> None:
        name = f"{checkpoint}#{number}"
        if not store.has_batch(name):
            ingest(store, batch, boards_of(batch), clock(), profile=profile, batch=name)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def sightings_per_window(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Postings seen per board and window of time from (ts, board, posting), late sightings up to `late` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "board").agg(F.approx_count_distinct("posting").alias("n_postings"), F.count("*").alias("n_sightings"))
