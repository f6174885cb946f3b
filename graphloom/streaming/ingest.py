"""N-Triples files that arrive in a folder, appended to a store.

Each micro-batch is parsed in parallel and becomes one change table of the store,
so a query always sees whole batches. A batch that is replayed after a failure
adds triples that are there already, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.graph import Store
from ..sources.ntriples import read_lines

#: Changes after which a store is folded.
FOLD_AFTER = 50


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start appending the files of a folder; once: what is there now, then stop."""

    def append(lines, _: int) -> None:
        triples = read_lines(lines).distinct()
        store.append(triples)
        if len(store.version().changes) > FOLD_AFTER:
            store.checkpoint()

    writer = spark.readStream.format("text").load(folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
