"""Exact deduplication by content sort, with DataFrame functions alone.

Sampled splitters range-partition the normalised text, the external sort places equal texts next to each other,
and the running comparison of neighbours (whole values, byte by byte) keeps the row with the smallest identifier.

Splitters reach the driver, so they are short: the first characters of a text and a hash of all of it. Equal texts
have equal splitter keys and thus one range; inside a range the sort and the comparison take the whole text.

A text that holds over 1/2000 of the rows would fill one range. Such texts are counted first (by the hash, before
the shuffle), salted by identifier into many ranges, and the few minima of the salts are then merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY_KEYS, table

SPACE = r"[\x20\x09-\x0D]+"
#: Characters of a text in its splitter key.
LEAD = 24


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _grouped(df: DataFrame, id_col: str, text_col: str, carry: list) -> DataFrame:
    """Rows with their place among the equal texts of their salt: _at (1: the smallest id), _least and _n."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("_id"), normalised(text).alias("_text"), *carry).withColumn("_hash", F.xxhash64("_text"))
    counted = table(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")))
    least = max(64, (counted.agg(F.sum("_rows")).first()[0] or 0) // HEAVY_KEYS)
    # at most HEAVY_KEYS rows of two numbers
    hot = counted.filter(F.col("_rows") >= least).select("_hash", F.ceil(F.col("_rows") / least).cast("int").alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_salts")), F.lit(-1)).cast("int")
    key = ["_lead", "_hash", "_salt"]
    dealt = (
        rows.join(F.broadcast(hot), "_hash", "left")
        .withColumns({"_salt": salt, "_lead": F.substring("_text", 1, LEAD)})
        .drop("_salts")
        .repartitionByRange(*key)  # without a number: small ranges beside each other become one, and one file
    )
    near = Window.partitionBy(*key, "_text")
    return dealt.withColumns(
        {
            "_at": F.row_number().over(near.orderBy(F.col("_id").asc_nulls_last())),
            "_least": F.min("_id").over(near),
            "_n": F.count(F.lit(1)).over(near),
        }
    )


def _merged(local: DataFrame) -> DataFrame:
    """For each hot text (at most HEAVY_KEYS of them): its smallest id, its rows, and the salt with its first row."""
    first = F.min(F.struct(F.col("_least").isNull().alias("a"), F.col("_least").alias("b"), F.col("_salt").alias("c")))
    firsts = local.filter("_salt >= 0 and _at = 1")
    return firsts.groupBy("text_sha256").agg(F.min("_least").alias("_m"), F.sum("_n").alias("_s"), first["c"].alias("_first"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Null text equals the empty text. A null id sorts last: it stays only if no row of its group has an id. Of
    repeated rows (same id and text) one stays. An empty table gives an empty result. Other columns are not read.
    """
    sha = F.sha2("_text", 256).alias("text_sha256")
    local = table(_grouped(df, id_col, text_col, []).select("_id", "_salt", "_at", "_least", "_n", sha))
    wide = local.join(F.broadcast(_merged(local)), "text_sha256", "left")
    plain = F.col("_salt") < 0
    return wide.select(
        F.col("_id").alias(id_col),
        F.when(plain, F.col("_least")).otherwise(F.col("_m")).alias("keep_id"),
        F.when(plain, F.col("_n")).otherwise(F.col("_s")).cast("long").alias("group_size"),
        ((F.col("_at") == 1) & (plain | (F.col("_salt") == F.col("_first")))).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all their columns; the rows travel with the sort."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    sha = F.sha2("_text", 256).alias("text_sha256")
    local = table(_grouped(df, id_col, text_col, [row]).filter("_at = 1").select("_row", "_salt", "_at", "_least", "_n", sha))
    wide = local.join(F.broadcast(_merged(local)), "text_sha256", "left")
    return wide.filter((F.col("_salt") < 0) | (F.col("_salt") == F.col("_first"))).select("_row.*")
