"""Documents from a stream into a store, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(batch: DataFrame, *, id_col: str = "id", order: tuple[str, ...] = ("updated_at", "feed_id")) -> DataFrame:
    """The last delivery of every document: by the first of `order`, nulls first, then the next. One aggregation, no sort."""
    rest = [c for c in batch.columns if c != id_col]
    mark = F.struct(*[F.struct(F.col(c).isNotNull().alias("is"), F.col(c).alias("at")) for c in order])
    won = batch.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*rest), mark).alias("r"))
    return won.select(id_col, "r.*")


def ingest_stream(stream: DataFrame, client, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Start feeding a stream of (id, text, metadata, updated_at, feed_id) to a client's store.

    A batch keeps the last delivery of each document and is ingested as a whole.
    A batch that is run again after a failure gives the same rows, since they
    are replaced by key and ids come from hashes.
    """

    def each(batch: DataFrame, number: int) -> None:
        client.ingest(latest(batch.where("text is not null and trim(text) <> ''")))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
