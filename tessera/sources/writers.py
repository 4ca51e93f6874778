"""Sinks. Tasks write files of their own; only summaries and reports are written by one task, row by row."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sampling import batches, contiguous
from tessera.plans.store import table, temporary


def json_lines(df: DataFrame, path: str, subset: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, one folder for each subset; a subset without rows writes nothing."""
    writer = df.write.mode(mode)
    (writer.partitionBy(subset) if subset else writer).json(path)


def equal_shards(df: DataFrame, path: str, order: list[str], n: int = 8) -> None:
    """n Parquet shards (shard=0 ...) of sizes that differ by at most one row, in order."""
    with temporary():
        contiguous(df, order, n, "shard").repartition(n, "shard").write.partitionBy("shard").parquet(path)


def rolling_shards(df: DataFrame, path: str, order: list[str], rows: int = 2000, form: str = "parquet") -> None:
    """Shards (shard=0 ...) of ``rows`` rows each, the last one shorter."""
    with temporary():
        batches(df, order, rows, "shard").repartition("shard").write.partitionBy("shard").format(form).save(path)


def _files(df: DataFrame, folder: str, file: str, order: list[str], form: str) -> DataFrame:
    """Writes the rows of each value of ``file`` to the file of that name, along ``order``, streaming, and gives the written
    (file, rows). A task writes under names of its own and renames when a file is whole, so a repeated task replaces it.
    ``form``: parquet (all other columns), lines (the first of them), bytes (the same, one row a file) or tar (name, content).
    """
    rest = [c for c in df.columns if c != file]

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        parts = ((name, batch.slice(a, b - a)) for batch in rows for name, a, b in _runs(batch.column(0).to_pylist()))
        for name, same in groupby(parts, key=lambda x: x[0]):
            own, n = f"{path}/.{uuid.uuid4().hex}", 0
            with where.open_output_stream(own, compression=None) as out:
                sink = None
                for _, part in same:
                    n += part.num_rows
                    data = part.select(rest)
                    if form == "parquet":
                        sink = sink or parquet.ParquetWriter(out, data.schema)
                        sink.write_batch(data)
                    elif form == "tar":
                        sink = sink or tarfile.open(fileobj=out, mode="w|")
                        for member, content in zip(data.column(0).to_pylist(), data.column(1).to_pylist()):
                            info = tarfile.TarInfo(member)
                            info.size = len(content)
                            sink.addfile(info, io.BytesIO(content))
                    else:
                        for value in data.column(0).to_pylist():
                            out.write(value if form == "bytes" else value.encode() + b"\n")
                if sink is not None:
                    sink.close()
            where.move(own, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64())], names=["file", "rows"])

    dealt = df.select(file, *rest).repartition(file).sortWithinPartitions(file, *order)
    return table(dealt.mapInArrow(write, "file string, rows long"))


def _runs(names: list[str]) -> Iterator[tuple[str, int, int]]:
    at = 0
    for name, same in groupby(names):
        n = sum(1 for _ in same)
        yield name, at, at + n
        at += n


def numbered_shards(df: DataFrame, folder: str, order: list[str], rows: int = 2000) -> DataFrame:
    """Parquet files shard_00000.parquet ... of ``rows`` rows each, the last one shorter; gives (file, rows)."""
    with temporary() as made:
        named = batches(df, order, rows, "_shard").withColumn("_file", F.format_string("shard_%05d.parquet", F.col("_shard"))).drop("_shard")
        written = _files(named, folder, "_file", order, "parquet")
        made.keep(written)
    return written


def request_files(df: DataFrame, folder: str, order: list[str], request: str, most: int = 50_000, stem: str = "requests") -> DataFrame:
    """Files of ``most`` requests (lines) as ``chunk_names`` names them; gives (file, rows)."""
    with temporary() as made:
        written = _files(chunk_names(df, order, most, stem).select("file", request, *order), folder, "file", order, "lines")
        made.keep(written)
    return written


def named_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """A file of the given name and bytes for each row, such as a picture; gives (file, rows)."""
    return _files(df.select(name, content), folder, name, [], "bytes")


def archives(df: DataFrame, folder: str, archive: str, name: str, content: str) -> DataFrame:
    """A tar file of the named contents for each archive, its members in order of name; gives (file, rows)."""
    return _files(df.select(archive, name, content), folder, archive, [name], "tar")


def chunk_names(df: DataFrame, order: list[str], most: int = 50_000, stem: str = "requests") -> DataFrame:
    """Adds file: stem.jsonl, or stem_part_1.jsonl ... if there is more than one chunk."""
    chunked = batches(df, order, most, "_chunk")
    chunks = chunked.agg((F.max("_chunk") + 1).alias("_chunks"))  # one row
    name = F.when(F.col("_chunks") == 1, F.lit(f"{stem}.jsonl")).otherwise(F.concat(F.lit(f"{stem}_part_"), F.col("_chunk") + 1, F.lit(".jsonl")))
    return chunked.join(F.broadcast(chunks)).withColumn("file", name).drop("_chunk", "_chunks")


def delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=sep, header=True, escape='"').csv(path)


def with_summary(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results as JSON lines and a summary, in one file, beside them."""
    results.write.json(f"{path}/results")
    summary.coalesce(1).write.json(f"{path}/summary")


def append_lines(df: DataFrame, path: str) -> None:
    """Adds one text column's values as lines; every call adds files of its own."""
    df.write.mode("append").text(path)


def report(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.text(path)


def ordered_text(df: DataFrame, path: str, order: list[str], text: str) -> None:
    df.orderBy(*order).select(text).write.text(path)


def cleaned_lines(df: DataFrame, whole_line: bool = True, key: str = "key") -> DataFrame:
    """value with "prompts/" and ".txt" removed: in the whole line, or only in the JSON object's key column."""
    gone = lambda c: F.replace(F.replace(c, F.lit("prompts/"), F.lit("")), F.lit(".txt"), F.lit(""))
    return df.withColumn("value", gone(F.col("value"))) if whole_line else df.withColumn(key, gone(F.col(key)))


def versioned(path: str, stamp: str) -> str:
    """A new folder for each run, instead of moving old results away."""
    return f"{path.rstrip('/')}/run={stamp}"
