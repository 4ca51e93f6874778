"""Enrichment through injected functions, with resumable output, and lookups between rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import pad_id, reply, request_id
from tessera.plans.store import fresh


def enrich(df: DataFrame, column: str, fn: Callable[[str], tuple[str, dict]], to: str | None = None, tries: int = 5) -> DataFrame:
    """Passes texts to ``fn`` (text to text and usage) batch by batch; null and empty texts pass by, and a text on which
    every try fails stays as it is. Usage (tokens in, out, total) comes in <column>_usage."""
    to = to or column

    @F.pandas_udf("text string, prompt_tokens long, completion_tokens long, total_tokens long, failed boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text):
            if not text:
                return (text, 0, 0, 0, False)
            for _ in range(tries):
                try:
                    out, usage = fn(text)
                    return (out, *(int(usage.get(k, 0)) for k in ("prompt_tokens", "completion_tokens", "total_tokens")), False)
                except Exception:  # noqa: BLE001  whatever the service raises
                    continue
            return (text, 0, 0, 0, True)

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["text", "prompt_tokens", "completion_tokens", "total_tokens", "failed"])

    found = df.withColumn("_out", run(F.col(column)))
    usage = F.struct("_out.prompt_tokens", "_out.completion_tokens", "_out.total_tokens", "_out.failed")
    return found.withColumn(to, F.col("_out.text")).withColumn(f"{column}_usage", usage).drop("_out")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done: a restart loses and repeats none."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_back(df: DataFrame, id_col: str, columns: list[str], results: DataFrame) -> DataFrame:
    """Cells replaced by results (custom_id, value) of their padded id and column, where there is one, empty or not."""
    per_row = results.select(F.regexp_extract("custom_id", r"^(\d+)_", 1).alias("_id"), F.regexp_extract("custom_id", r"^\d+_(.*)$", 1).alias("_column"), "value")
    wide = per_row.groupBy("_id").pivot("_column", columns).agg(F.first("value"))
    wide = wide.select("_id", *[F.col(f"`{c}`").alias(f"_new_{c}") for c in columns])
    out = df.withColumn("_id", pad_id(F.col(id_col))).join(wide, "_id", "left")
    return out.select(*[F.coalesce(f"_new_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def replies(df: DataFrame, json: str) -> DataFrame:
    """(custom_id, value) of the batch replies that succeeded; errors and malformed lines give no row, so they write
    nothing back."""
    return df.select(reply(F.col(json)).alias("_reply")).filter("_reply is not null").select("_reply.*")


def write_replies(df: DataFrame, id_col: str, columns: list[str], results: DataFrame) -> DataFrame:
    """Cells replaced by results (custom_id, value) of their request id (see ``text.request_id``), where there is one."""
    wanted = df.select(F.col(id_col).alias("_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), request_id(F.col(id_col), c).alias("k")) for c in columns])).alias("_w"))
    found = wanted.select("_id", F.col("_w.c").alias("_column"), F.col("_w.k").alias("custom_id")).join(results, "custom_id")
    wide = found.groupBy("_id").pivot("_column", columns).agg(F.first("value"))
    wide = wide.select("_id", *[F.col(f"`{c}`").alias(f"_new_{c}") for c in columns])
    out = df.join(wide, F.col(id_col) == F.col("_id"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def resolve_references(df: DataFrame, key: str, ref: str, value: str, inline: int | None = None) -> DataFrame:
    """Rows whose ``ref`` is another row's key take that row's value; rows with no number there keep their own; rows
    whose reference leads nowhere go. With ``inline`` only values of more characters than that can be referred to."""
    key_, value_ = fresh(df.columns, "_key", "_value")
    target = df.select(F.col(key).alias(key_), F.col(value).alias(value_))
    target = target if inline is None else target.filter(F.length(value_) > inline)
    found = df.withColumn(key_, F.col(ref).try_cast("bigint")).join(target, key_, "left")
    return found.filter(F.col(key_).isNull() | F.col(value_).isNotNull()).withColumn(value, F.coalesce(value_, F.col(value))).drop(key_, value_)


def correlate(waiting: DataFrame, results: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """Each waiting request with its result, or the default text."""
    return waiting.join(results.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def scored(df: DataFrame, inputs: list[str], fn: Callable[..., str], to: str = "answer", failed: str = "error") -> DataFrame:
    """Adds an injected scorer's answer to each row; what raises gives ``failed``."""

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        def one(row):
            try:
                return fn(*row)
            except Exception:  # noqa: BLE001
                return failed

        return pd.Series([one(r) for r in zip(*columns)], dtype=object)

    return df.withColumn(to, run(*[F.col(c) for c in inputs]))
