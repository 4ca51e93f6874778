"""Streaming forms: micro-batched requests, ordered packing with state, and line sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def files(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """A folder as a stream; ``per_batch`` limits the files of a micro-batch."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def text_lines(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    return spark.readStream.option("pathGlobFilter", glob).text(path)


def serve(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = "500 milliseconds", workers: int = 0) -> StreamingQuery:
    """Micro-batches of requests through ``respond``, appended as JSON. Each row carries its id and parameters, so a
    batch may mix them; a restart resumes from the checkpoint. Without ``every`` all that is there is served once."""

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.repartition(workers) if workers else batch
        respond(rows).write.mode("overwrite").json(f"{out}/batch={number}")  # a repeated batch replaces itself

    writer = requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


PACKED = "key string, pack long, at long, sequence long, ordinal long, keep long"


def stream_pack(rows: DataFrame, key: str, order: str, length: str, capacity: int) -> DataFrame:
    """Greedy packing over a stream: the pack number, fill and sequence of each key are carried from batch to batch.
    Rows of a key are put in order inside a micro-batch; batches must come in order."""
    state = "at long, pack long, sequence long"

    def step(name, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        at, pack, sequence = held.get if held.exists else (0, 0, 0)
        parts = [b for b in batches]
        if not parts:
            return
        new = pd.concat(parts).sort_values(order)
        out = []
        for o, n in zip(new[order].tolist(), new[length].tolist()):
            sequence += 1
            out.append((str(name[0]), pack, at, sequence, o, min(n, capacity - at)))
            at += n
            if at >= capacity:
                at, pack, sequence = 0, pack + 1, 0
        held.update((at, pack, sequence))
        yield pd.DataFrame(out, columns=["key", "pack", "at", "sequence", "ordinal", "keep"])

    return rows.groupBy(key).applyInPandasWithState(step, PACKED, state, "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event time with a bound on lateness; Spark's own addition to what the reference has."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).count()


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now into a table in memory; for tests and small streams."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
