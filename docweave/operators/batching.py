"""Greedy batches: an order-dependent fold over each group's rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 2500


def greedy_batches(rows: DataFrame, group: str, order: str, length: str, most: int = MOST) -> DataFrame:
    """group, order, length and batch (from 0): a batch is closed when it isn't empty and the next row would take it over
    `most`, so one row may exceed it. Rows are sorted within partitions and folded as they come, so what a task holds
    is an Arrow batch, however long a group is. A null length counts as 0."""

    def fold(batches):
        own, size, batch = object(), 0, 0
        for rows in batches:
            out = []
            for g, n in zip(rows["g"].to_pylist(), rows["l"].to_pylist(), strict=True):
                n = n or 0
                if g != own:
                    own, size, batch = g, 0, 0
                if size and size + n > most:
                    size, batch = 0, batch + 1
                size += n
                out.append(batch)
            yield pa.record_batch([rows["g"], rows["o"], rows["l"], pa.array(out, pa.int32())], ["g", "o", "l", "batch"])

    ready = rows.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(length).cast("long").alias("l"))
    kind = ready.schema["g"].dataType.simpleString()
    done = ready.repartition("g").sortWithinPartitions("g", "o", "l").mapInArrow(fold, f"g {kind}, o long, l long, batch int")
    return done.select(F.col("g").alias(group), F.col("o").alias(order), F.col("l").alias(length), "batch")
