"""Incremental runs: batches of query cases that arrive over time, each handled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_records


def run_stream(cases: DataFrame, run: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs the batch pipeline on every micro-batch of a stream of cases.

    Results are appended to JSON lines; ids that the output already holds are
    left out, so a batch that is replayed after a failure adds nothing twice.
    """

    def handle(batch: DataFrame, _: int) -> None:
        append_records(run(batch), output, resume=True)

    writer = cases.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
