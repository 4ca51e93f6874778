"""What the operators of this subpackage share: written tables, joins that stand hot keys, ranks and components.

Nothing here collects rows of an unbounded number, and nothing is kept on one machine's disk: intermediate
tables go to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.store import discard, fresh, partitions, shared_dir, spread, table, temporary

__all__ = ["attach", "components", "discard", "fresh", "partitions", "ranked", "read", "shared_dir", "small_batches", "spread", "table", "temporary"]

#: At most so many keys can each hold this share of all rows, so a table of such keys may be broadcast.
HEAVY_KEYS = 2000


#: Of texts on their way to Python at once. Texts can be long, so bytes count too; a session's lower setting stays.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to a size of which Python workers can hold a few copies."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not own or not 0 < int(own[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, merge: bool = True) -> DataFrame:
    """Inner join of ``rows`` to the one row that ``groups`` has for each ``key`` (never null), however skewed.

    ``size`` is the column of ``groups`` with the number of rows of the key. A key with over 1/HEAVY_KEYS of the
    rows is joined by broadcast (there are at most HEAVY_KEYS of these, of fixed width), the others by a sort-merge
    join in which no key can weigh; without ``merge`` Spark may send them out too if their written size is under its
    broadcast threshold. ``rows`` is read twice, so it should be cheap to read. Drops ``size``.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(64, total // HEAVY_KEYS)
    heavy, light = groups.filter(F.col(size) >= least).drop(size), groups.filter(F.col(size) < least).drop(size)
    few = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(few.join(light.hint("merge") if merge else light, key))


def ranked(df: DataFrame, by: list[str], order: list[str], to: str) -> DataFrame:
    """Adds the gapless 0-based rank of each row among those with equal ``by``, along ``order`` (unique in ``by``).

    ``by`` takes a bounded number of values. Rows are dealt out by ranges of (by, order), so a value that holds
    most rows spreads over many tasks; each range counts its rows and the offsets of ranges are summed.
    """
    range_, n, before_, at = fresh([*df.columns, to], "_range", "_n", "_before", "_at")
    # without a number: small ranges beside each other become one, and one file
    dealt = table(df.repartitionByRange(*by, *order).withColumn(range_, F.spark_partition_id()))
    counts = dealt.groupBy(*by, range_).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*by).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before_, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    here = Window.partitionBy(*by, range_).orderBy(*order)
    # ranges are cut along (by, order): there are no more offsets than ranges plus values of `by`
    return (
        dealt.withColumn(at, F.row_number().over(here) - 1)
        .join(F.broadcast(offsets), [*by, range_])
        .withColumn(to, (F.col(at) + F.col(before_)).cast("long"))
        .drop(at, before_, range_)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node that links reach.

    Alternates large and small stars until each node hangs from its root. Minima are aggregated before they are
    shuffled and hubs are joined by ``attach``; every half round is a written table.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    edges = table(edges.distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = attach(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.distinct())
        discard(edges, least)
        least = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        moved = attach(large, least, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(large, least)
        tops = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if tops.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
