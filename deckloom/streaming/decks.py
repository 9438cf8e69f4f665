"""A folder of decks converted as files arrive.

Each deck is whole in its file, so the batch plan serves every micro-batch; no
state is kept beyond the list of files seen, which the checkpoint holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from deckloom.api import ConvertOptions, convert_contents

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def convert_stream(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    options: ConvertOptions | None = None,
    *,
    files_per_trigger: int = 1000,
    available_now: bool = False,
) -> StreamingQuery:
    """Write (deck_id, markdown) of every new deck in ``folder`` as Parquet,
    each micro-batch under a folder of its own, so that a batch that is run
    again replaces what it wrote."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pptx").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )

    def write(batch: DataFrame, number: int) -> None:
        convert_contents(batch, options).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
