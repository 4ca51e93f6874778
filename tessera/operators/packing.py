"""Record layouts and greedy packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import masked_prefix
from tessera.plans.store import fresh
from tessera.schemas import CODES, IGNORE_INDEX, TEXT_VOCAB


def layout_text_to_image(text: Column, codes: Column, start: int, end: int, eos: int, mask: bool = True) -> Column:
    """(ids, labels): text, start, codes, end, eos; the text and start are masked."""
    ids = F.concat(text, F.array(F.lit(start)), codes, F.array(F.lit(end), F.lit(eos)))
    return F.struct(ids.alias("ids"), (masked_prefix(ids, F.size(text) + 1) if mask else ids).alias("labels"))


def layout_caption(instruction: Column, caption: Column, codes: Column, start: int, end: int, eos: int, mask: bool = True) -> Column:
    """(ids, labels): start, codes, end, instruction, caption, eos. One caption token more than the prefix is masked."""
    tail = F.concat(caption, F.array(F.lit(eos)))
    ids = F.concat(F.array(F.lit(start)), codes, F.array(F.lit(end)), instruction, tail)
    return F.struct(ids.alias("ids"), (masked_prefix(ids, F.size(ids) - F.size(tail) + 1) if mask else ids).alias("labels"))


def layout_dialogue(turns: Column, codes: Column, start: int, end: int, most: int) -> Column:
    """(ids, labels): start, codes, end and the turns' ids, of which even (human) ones are masked; cut at ``most``."""
    image = F.concat(F.array(F.lit(start)), codes, F.array(F.lit(end)))
    none = lambda x: F.transform(x, lambda _: F.lit(IGNORE_INDEX))
    ids = F.concat(image, F.flatten(turns))
    labels = F.concat(none(image), F.flatten(F.transform(turns, lambda t, i: F.when(i % 2 == 0, none(t)).otherwise(t))))
    return F.struct(F.slice(ids, F.lit(1), F.lit(most)).alias("ids"), F.slice(labels, F.lit(1), F.lit(most)).alias("labels"))


def plan(df: DataFrame, key: str, order: str, length: str, capacity: int) -> DataFrame:
    """Adds pack, at (offset in the pack), sequence (from 1) and keep (tokens that go in) along ``order`` in each key.

    Greedy as rows come: a row that overflows is cut at the capacity, its rest is dropped and the pack closes. A null
    length counts as 0. The state is three numbers, so only lengths are folded, streaming over sorted batches; tokens
    are joined later. A key is folded by one task.
    """
    own = df.select(key, order).schema.fields
    schema = T.StructType([*own, *[T.StructField(c, T.LongType()) for c in ("pack", "at", "sequence", "keep")]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, pack, sequence = None, 0, 0, 0
        for batch in batches:
            out = ([], [], [], [])
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if (k,) != last:
                    last, at, pack, sequence = (k,), 0, 0, 0
                sequence += 1
                for to, v in zip(out, (pack, at, sequence, min(n, capacity - at))):
                    to.append(v)
                at += n
                if at >= capacity:
                    at, pack, sequence = 0, pack + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in out]], names=schema.names)

    lengths = df.select(key, order, F.coalesce(F.col(length), F.lit(0)).cast("long").alias(fresh([key, order], "_length")[0]))
    return lengths.repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, schema)


def packed(planned: DataFrame, key: str, ids: str = "ids", labels: str = "labels") -> DataFrame:
    """One row for each pack: ids, labels, sequence_ids, cu_seqlens, max_length. ``planned`` has pack, sequence, keep
    and the token arrays; a pack is bounded by its capacity."""
    rows = planned.filter("keep > 0").select(
        key, "pack", "sequence", "keep",
        F.struct("sequence", F.slice(F.col(ids), F.lit(1), F.col("keep").cast("int")).alias("ids"), F.slice(F.col(labels), F.lit(1), F.col("keep").cast("int")).alias("labels")).alias("part"),
    )
    found = rows.groupBy(key, "pack").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    lengths = F.transform("parts", lambda p: F.size(p["ids"]))
    return found.select(
        key, "pack",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: p["labels"])).alias("labels"),
        F.flatten(F.transform("parts", lambda p: F.array_repeat(p["sequence"], F.size(p["ids"])))).alias("sequence_ids"),
        cumulative(lengths).alias("cu_seqlens"),
        F.array_max(lengths).alias("max_length"),
    )


def cumulative(lengths: Column) -> Column:
    """0 and the running sums of lengths."""
    sums = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    return F.concat(F.array(F.lit(0)), sums)


def image_placeholder(df: DataFrame, key: list[str], has_image: Column, start: int, vocab: int = TEXT_VOCAB, seed: int = 0) -> DataFrame:
    """Packs without a whole image end in a start mark and one code (by the key's hash), as a sequence of their own."""
    code = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(CODES)) + vocab).cast("int")
    short = lambda c: F.slice(F.col(c), F.lit(1), F.greatest(F.size(c) - 2, F.lit(0)))
    tail = F.array(F.lit(start), code)
    new = F.array_max("sequence_ids") + 1
    swap = lambda c, t: F.when(has_image, F.col(c)).otherwise(F.concat(short(c), t))
    return df.withColumns({"ids": swap("ids", tail), "labels": swap("labels", tail), "sequence_ids": swap("sequence_ids", F.array_repeat(new, 2))})


def segment_lengths(df: DataFrame, key: list[str], sequence: str, length: str) -> DataFrame:
    """Sums of lengths by sequence with their running total, and the longest, within each key."""
    sums = df.groupBy(*key, sequence).agg(F.sum(length).alias("seg_len"))
    up_to = Window.partitionBy(*key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumns({"cu_seqlen": F.sum("seg_len").over(up_to), "max_len": F.max("seg_len").over(Window.partitionBy(*key))})


def tokenised(df: DataFrame, text: str, encode, to: str = "ids", most: int | None = None) -> DataFrame:
    """Token ids by an injected batch function (list of texts to list of id lists)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x[:most] for x in encode([t or "" for t in texts])], dtype=object)

    return df.withColumn(to, run(F.col(text)))
