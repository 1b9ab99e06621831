"""Cache filling as a file stream: each new dump is inserted once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.landing import RAW_SCHEMA, standardize
from ..sources.tables import ShotStore


def fill_from_landing(store: ShotStore, landing_path: str, checkpoint_path: str) -> None:
    """Take in the JSON dumps that arrived since the last run, then stop.

    Files are tracked in the stream's checkpoint, and the insert ignores
    stored rows, so a batch repeated after a failure adds nothing.
    """

    def insert(batch: DataFrame, _: int) -> None:
        store.upsert(standardize(batch))

    stream = store.spark.readStream.schema(RAW_SCHEMA).json(landing_path)
    query = (
        stream.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
