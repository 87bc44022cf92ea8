"""Continuous runs: every micro-batch of changed entries becomes the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.lineage import scratch
from shelfmark.plans import runs, snapshots

# Time between two runs.
INTERVAL = "60 seconds"


def snapshot_path(state_path: str, batch_id: int) -> str:
    """Folder of the snapshot a batch leaves behind; the state before the first batch is number -1."""
    return f"{state_path}/batch={batch_id}"


def stream_entries(
    changes: DataFrame, state_path: str, checkpoint: str, as_of=None, interval: str | None = INTERVAL
) -> StreamingQuery:
    """Start the incremental run on a stream of entry changes.

    A batch reads the snapshot of the batch before it and writes its own, which
    holds the parts that changed and points to the others.  A batch repeated after
    a failure starts from the same snapshot and gives the same state.  Afterwards
    its scratch tables go, and what neither of the two snapshots points to.
    ``as_of`` defaults to the newest harvest time of the batch; ``interval=None``
    works off what is there and stops.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = snapshot_path(state_path, batch_id - 1), snapshot_path(state_path, batch_id)
        with scratch(spark):
            changed = runs.cut(batch)
            state = snapshots.read_snapshot(spark, before)
            # A batch without any harvest time goes on from the newest time of the state.
            newest = (x.selectExpr("max(harvested_at) + interval 1 second AS m").first()["m"] for x in (changed, state["entries"]))
            moment = as_of or next((m for m in newest if m is not None), runs.NEVER_INDEXED)

            def keep(state: runs.Catalogue) -> runs.Catalogue:
                snapshots.write_snapshot(state, after, before)
                return state

            runs.run_incremental(state, changed, moment, keep)
        snapshots.remove_unused(spark, state_path, [before, after])

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
