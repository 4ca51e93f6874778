"""Scans. All are lazy reads of Spark's own sources, so filters and columns reach the files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.functions.text import longest_value
from tessera.operators.sampling import head_fraction
from tessera.schemas import PATH_SPLIT, TRAIN_SCHEMA

#: Bytes of files that an executor's Python holds at once, or one file that is larger.
AUDITED = 16 << 20


def records(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | None = TRAIN_SCHEMA, split: str | None = None) -> DataFrame:
    """Training records with the declared schema; with ``split`` only that partition of a split column."""
    reader = spark.read.format(form)
    found = (reader.schema(schema) if schema else reader).load(path)
    return found.filter(F.col("split") == split) if split else found


def many_records(spark: SparkSession, paths: str, fractions: list[float], order: list[str], form: str = "parquet", schema: T.StructType | None = TRAIN_SCHEMA) -> DataFrame:
    """Several paths (separated by ^^), of each its head fraction (one fraction counts for all), one after another."""
    each = [p for p in paths.split(PATH_SPLIT) if p]
    fractions = fractions * len(each) if len(fractions) == 1 else fractions
    if len(fractions) != len(each):
        raise ValueError("give one fraction, or one for each path")
    out = None
    for path, f in zip(each, fractions):
        df = records(spark, path, form, schema)
        df = df if f >= 1 else head_fraction(df, order, f)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def json_files(spark: SparkSession, path: str, glob: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, blank lines left out; no file at all is an error."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def checked_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines)."""
    known = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", known, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("_row"))
    bad = F.col("_row._corrupt_record").isNotNull()
    return rows.filter(~bad).select("_row.*").drop("_corrupt_record"), rows.filter(bad).select(F.col("_row._corrupt_record").alias("line"))


def audit(spark: SparkSession, path: str, glob: str = "*.parquet", schema: T.StructType | None = None) -> DataFrame:
    """(path, readable, problem) of each Parquet file. Executors decode every row group, in batches of bounded size; with
    ``schema`` a file must have its columns and types."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, min(AUDITED, own) if (own := _bytes(spark.conf.get(key))) > 0 else AUDITED)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    want = schema and [(f.name, f.dataType.simpleString()) for f in schema.fields]

    @F.pandas_udf(T.StringType())
    def problem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield pd.Series([_problem(c, want) for c in contents], dtype=object)

    return files.select("path", problem.asNondeterministic()("content").alias("problem")).select("path", F.col("problem").isNull().alias("readable"), "problem")


def _bytes(size: str) -> int:
    return int(size.rstrip("bB")) if size.rstrip("bB").lstrip("-").isdigit() else 0


def _problem(content: bytes, want: list[tuple[str, str]] | None) -> str | None:
    """What keeps a Parquet file from being read; None if nothing does."""
    try:
        with parquet.ParquetFile(pa.BufferReader(content), page_checksum_verification=True) as file:
            if want is not None and (has := [(f.name, f.dataType.simpleString()) for f in from_arrow_schema(file.schema_arrow).fields]) != want:
                return f"other columns: {has}"
            rows = sum(batch.num_rows for batch in file.iter_batches(batch_size=1024))
            return None if rows == file.metadata.num_rows else f"{rows} rows of {file.metadata.num_rows}"
    except Exception as e:  # noqa: BLE001  damaged bytes raise errors of many kinds
        return f"{type(e).__name__}: {e}"


def subsets(spark: SparkSession, root: str, names: list[str], form: str = "parquet") -> DataFrame:
    """root/<subset>/ of the named subsets, with a subset column."""
    rows = spark.read.format(form).load([f"{root.rstrip('/')}/{n}" for n in sorted(names)])
    return rows.withColumn("subset", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def image_lines(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """caption and image of header-less tab-separated lines, whose columns are counted from the end: the longest
    value of the JSON captions at -6, and base64 bytes at -3. Lines that don't parse are left out."""
    cells = F.split("value", "\t")
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    at = lambda k: F.try_element_at(cells, F.lit(k))
    rows = lines.select(longest_value(at(-6)).alias("caption"), F.try_to_binary(at(-3), F.lit("base64")).alias("image"))
    return rows.filter("image is not null")


def table_file(spark: SparkSession, path: str, sep: str = "\t", schema: T.StructType | None = None, strings: bool = False) -> DataFrame:
    """A file with a header; quoted cells may span lines. With ``strings`` all columns are strings and never null."""
    reader = spark.read.options(sep=sep, header=True, multiLine=True, escape='"', inferSchema=not (schema or strings))
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.na.fill("") if strings else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of lines that aren't blank; blank lines count in the numbering. A file is one row of its own
    until its lines are split, so prompts and logs are meant, not corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("all"))
    return whole.select("file", F.posexplode("all").alias("line", "text")).filter(F.btrim("text", F.lit(" \t\r\n")) != "")


def whole_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text, origin): the letters that a file's name begins with tell its origin."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.regexp_extract(F.col("_metadata.file_name"), "^([A-Za-z]+)", 1).alias("origin"))


def images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def entropy_log(text: Column) -> Column:
    """(source, n, entropy) of a log line such as "name: n=3 entropy=1.5"; null where it doesn't match."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(part(r"^\s*([^:]+?)\s*:").alias("source"), part(r"n\s*=\s*(\d+)").try_cast("int").alias("n"), part(r"entropy\s*[=:]\s*(-?[\d.]+)").try_cast("double").alias("entropy"))


def checkpoints(spark: SparkSession, base: str) -> DataFrame:
    """(checkpoint, step) of the checkpoint-<step> folders under a path; the path itself if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    status = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(s.getPath().getName() for s in status if s.isDirectory() and s.getPath().getName().startswith("checkpoint-"))
    rows = [(f"{base.rstrip('/')}/{n}", int(n.split("-")[1]) if n.split("-")[1].isdigit() else None) for n in names]
    return spark.createDataFrame(rows or [(base, None)], "checkpoint string, step int")


def warmed(df: DataFrame) -> DataFrame:
    """The table kept in memory (spilling to disk), computed now."""
    kept = df.persist()
    kept.count()
    return kept
