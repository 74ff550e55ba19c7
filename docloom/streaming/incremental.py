"""Structured Streaming forms of the incremental operators (extensions: the batch forms define the semantics)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "conv_id long, message_count long, last_turn long, title string"


def conversation_state(messages: DataFrame, title_chars: int = 80) -> DataFrame:
    """Running message count, last turn and title of each conversation; state is three values a conversation."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, first_user, title = state.get if state.exists else (0, -1, -1, "")
        for b in batches:
            n += len(b)
            last = max(last, int(b["turn"].max()))
            users = b[b["role"] == "user"]
            if len(users) and (first_user < 0 or users["turn"].min() < first_user):
                row = users.loc[users["turn"].idxmin()]
                first_user, title = int(row["turn"]), str(row["text"])[:title_chars]
        state.update((n, last, first_user, title))
        yield pd.DataFrame({"conv_id": [key[0]], "message_count": [n], "last_turn": [last], "title": [title]})

    return messages.groupBy("conv_id").applyInPandasWithState(update, STATE, "n long, last long, first_user long, title string", "update", GroupStateTimeout.NoTimeout)


def upsert_documents(stream: DataFrame, target: str, checkpoint: str, key: str = "source_path", buckets: int = 64):
    """Takes all files that are there, and lets the newest row of each key replace the stored one in a new table version.

    Only the buckets of the keys in a micro-batch are written.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        from docloom.operators.index import VersionedIndex, bucket_of

        index = VersionedIndex(batch.sparkSession, target)
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "seen").alias("r")).select("r.*")
        if index.version() is None:
            index.replace({"documents": newest}, key, buckets)
            return
        touched = sorted(r[0] for r in newest.select(bucket_of(key, buckets)).distinct().collect())  # at most that many numbers
        if touched:
            kept = index.read("documents", touched).join(newest.select(key), key, "left_anti").select(newest.columns)
            index.replace({"documents": kept.unionByName(newest)}, key, buckets, touched)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type over tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
