"""Append-only ledgers and logs as streams (STM-1 to STM-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "json", files: int | None = None) -> DataFrame:
    """Files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(kind).load(folder)


def process_once(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """STM-1, STM-2: each batch's result goes to its own folder, which a repeated batch overwrites.

    The checkpoint holds what was read; nothing is done twice and no half-written end has to be cut off.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(stream: DataFrame, key: str, *order: str) -> DataFrame:
    """STM-3: the last row per key so far, for update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    top = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return top.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))


def running_counts(stream: DataFrame, group: str, event_time: str | None = None, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """STM-4: counts per group with bounded state; with a time column, per window and up to the watermark."""
    if event_time is None:
        return stream.groupBy(group).agg(F.count("*").alias("n"))
    timed = stream.withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window or late), group).agg(F.count("*").alias("n"))


def reservoir(stream: DataFrame, group: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """STM-4: a uniform sample of ``size`` keys per group in one pass; state is at most ``size`` hashes a group."""
    import pandas as pd

    def step(group_key, frames, state):
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            hashes = pd.util.hash_array((pdf[key].astype(str) + f":{seed}").to_numpy(dtype=object))
            kept = sorted(set(kept) | set(zip((int(h >> 1) for h in hashes), (str(k) for k in pdf[key]), strict=True)))[:size]
        state.update(([k[0] for k in kept], [k[1] for k in kept]))
        yield pd.DataFrame({group: [group_key[0]] * len(kept), key: [k[1] for k in kept]})

    kind = stream.schema[group].dataType.simpleString()
    return stream.groupBy(group).applyInPandasWithState(step, f"{group} {kind}, {key} string", "hashes array<long>, keys array<string>", "update", "NoTimeout")
