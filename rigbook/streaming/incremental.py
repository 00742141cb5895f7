"""The refresh as an incremental job: each new feed file is loaded once, as it arrives."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rigbook.plans.refresh import load_feed
from rigbook.schemas import FEED
from rigbook.sources.tables import CatalogueTables


def read_feed_stream(spark: SparkSession, path: str, fmt: str = "json",
                     files_per_batch: int | None = None) -> DataFrame:
    """Feed files of a folder as a stream, in order of arrival."""
    reader = spark.readStream.schema(FEED).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_loading(stream: DataFrame, tables: CatalogueTables, checkpoint: str,
                  now: Column | None = None) -> StreamingQuery:
    """Load what has arrived and stop.

    The stream's checkpoint remembers which files are done. If the job dies between a load and that
    note, the batch is loaded again, which adds no price row: loading is insert-or-ignore.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        load_feed(tables, batch, now)

    return (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
