"""SimHash near-deduplication through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 2 bits, cut into 2 segments of 32 bits, have a segment that differs
in at most 1. So each segment is indexed once as it is and once with each of its bits wildcarded; equal index
keys are candidates, which are then verified. Fingerprints are made distinct first, so copies cost nothing.

A key with two fingerprints is verified from its minimum and maximum, which are aggregated before the shuffle. A
key with more is resolved without pairing its members: each member lists the 65 fingerprints within one bit of
itself, and two members differ in at most 2 bits exactly when their lists meet; all that meet in one are linked
to the smallest. That is exact, and linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, components, fresh, partitions, small_batches, table, temporary

BITS, DIFFER, SEGMENTS = 64, 2, 2
SEED = 42
#: Shingles whose hashes are summed at once; bounds memory for long texts, changes no result.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint. Null, empty and blank texts: 0. Fewer words than a shingle: one shingle of all."""
    found = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, SEED)
    sums, n = np.zeros(BITS, np.int64), len(found) - words + 1
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + words - 1 : to + words - 1])], ">u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` such that exactly those within DIFFER bits are connected
    by the edges, directly or by others within DIFFER bits."""
    half = BITS // SEGMENTS
    wild = F.array(*[F.lit(1 << i) for i in range(half)], F.lit(0))

    def keys(segment: int):
        value = F.shiftrightunsigned("fp", half * segment).bitwiseAND(F.lit((1 << half) - 1))
        return F.transform(wild, lambda w: F.xxhash64(F.lit(segment), w, value.bitwiseAND(F.bitwise_not(w))))

    # dealt out anew: few files hold the fingerprints, but each gives 66 keys, of which a task keeps a table
    dealt = prints.select("fp").repartition(max(2, partitions(prints.sparkSession)), "fp")
    index = dealt.select("fp", F.explode(F.concat(*map(keys, range(SEGMENTS)))).alias("key"))
    # A key is the hash of (segment, wildcard, rest): a chance clash only adds a candidate, which is verified.
    met = table(index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DIFFER
    pairs = met.filter("n = 2").filter(close).select("u", "v").distinct()
    crowded = table(met.filter("n > 2").select("key", "n"))  # few beside the keys, which then needn't be shuffled again
    if crowded.isEmpty():
        return pairs
    members = table(attach(index, crowded, "key", "n", merge=False).select("fp").distinct().hint("rebalance"))  # few, in few files
    ball = F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit((1 << i) - (1 << BITS if i == BITS - 1 else 0)).cast("long") for i in range(BITS)]))
    around = members.select("fp", F.explode(ball).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("near"))
    centres = table(around.groupBy("near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    stars = attach(around, centres, "near", "n").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def _groups(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Each row's _id, fp and ``more``, and of its component: component_id, root (a fingerprint that names it) and rows."""
    small_batches(df.sparkSession)
    with temporary() as made:
        docs = table(df.select(F.col(id_col).alias("_id"), _fingerprints(F.col(text_col)).alias("fp"), *more))
        prints = table(docs.groupBy("fp").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")))
        rooted = components(links(prints))
        known = table(prints.join(rooted, prints.fp == rooted.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
        roots = table(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("rows")))
        named = table(attach(known, roots, "root", "members").select("fp", "component_id", "root", "rows", "n"))
        made.keep(docs, named)
    return attach(docs, named, "fp", "n")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    Null and blank texts have fingerprint zero and link like any other. Null ids are not candidates for
    component_id, which is null only where a group has no id at all. Repeated rows give repeated rows. An empty
    table gives an empty result. Other columns are not read.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _groups(df, id_col, text_col).select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which each component keeps one: that with the smallest id, a null one last, and of rows with
    that id the one whose text has the smallest hash. Rows of equal id and text share their fate."""
    with temporary() as made:
        rows = _groups(df, id_col, text_col, F.xxhash64(text_col).alias("_text"))
        among = table(rows.filter("rows > 1").select("_id", "_text", "root", "rows", F.col("_id").eqNullSafe(F.col("component_id")).alias("_least")))
        stays = table(among.filter("_least").groupBy("root").agg(F.min("_text").alias("_stays"), F.max("rows").alias("_rows")))
        goes = ~(F.col("_least") & (F.col("_text") == F.col("_stays")))
        id_, text_ = fresh(df.columns, "_gone_id", "_gone_text")
        # the few rows that go: Spark sends them out if they are under its broadcast threshold, and else moves the texts
        gone = table(attach(among.drop("rows"), stays, "root", "_rows").filter(goes).select(F.col("_id").alias(id_), F.col("_text").alias(text_)).distinct())
        made.keep(gone)
    return df.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(text_)), "left_anti")
