"""Written intermediate tables and distributed ordinals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def table(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the lineage ends here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    found._written = path
    for block in _blocks:
        block.tables.append(found)
    return found


class _Block:
    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: list[str] = []

    def keep(self, *tables: DataFrame) -> None:
        self.kept += [t._written for t in tables]


_blocks: list[_Block] = []


@contextmanager
def temporary() -> Iterator[_Block]:
    """Within it, tables are written that nothing reads afterwards: at its end they are deleted, but for those that its
    ``keep`` was given and those already gone."""
    block = _Block()
    _blocks.append(block)
    try:
        yield block
    finally:
        _blocks.remove(block)
        discard(*[t for t in block.tables if t._written not in block.kept])


def discard(*tables: DataFrame) -> None:
    """Deletes what ``table`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain file scan dealt out to all cores if its files give it fewer partitions than there are cores, as a table
    of one file does; scans of many files stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with marks in front that keep them apart from ``columns`` in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ordinal(df: DataFrame, order: list[str | Column], to: str = "ordinal", start: int = 0) -> DataFrame:
    """Adds each row's global position along ``order`` (a unique key), in place of a column so named, without a single
    task that sees all rows.

    Rows are dealt out by sampled ranges and written once; each range counts its rows, and a row's position is its
    range's offset plus its position in the range.
    """
    range_, inside, before_, n = fresh([*df.columns, to], "_range", "_in_range", "_before", "_n")
    dealt = table(df.repartitionByRange(max(2, partitions(df.sparkSession)), *order).withColumn(range_, F.spark_partition_id()))
    before = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(range_).agg(F.count(F.lit(1)).alias(n))  # a row for each range
    offsets = sizes.withColumn(before_, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    here = F.row_number().over(Window.partitionBy(range_).orderBy(*order))
    placed = dealt.withColumn(inside, here).join(F.broadcast(offsets), range_)
    return placed.withColumn(to, (F.col(inside) + F.col(before_) - 1 + start).cast("long")).drop(inside, before_, range_)


def beside(df: DataFrame, order: list[str], values: dict[str, str], later: bool = True) -> DataFrame:
    """Adds (name: column) the values of the next row along a unique order, or with ``later`` off of the row before; null
    at the end. Rows are dealt out by ranges and written once; only the row over each border is carried, by broadcast."""
    range_, at, end, edge = fresh([*df.columns, *values], "_range", "_beside", "_end", "_edge")
    dealt = table(df.repartitionByRange(max(2, partitions(df.sparkSession)), *order).withColumn(range_, F.spark_partition_id()))
    held, key = F.struct(*[F.col(c).alias(to) for to, c in values.items()]), F.struct(*order)
    step = F.lead if later else F.lag
    here = Window.partitionBy(range_).orderBy(*order)
    nearest = dealt.groupBy(range_).agg((F.min_by if later else F.max_by)(held, key).alias(edge))  # a row for each range
    borders = nearest.select(range_, step(edge).over(Window.orderBy(range_)).alias(edge))
    rows = dealt.withColumns({at: step(held).over(here), end: step(F.lit(1)).over(here).isNull()}).join(F.broadcast(borders), range_)
    found = F.when(F.col(end), F.col(edge)).otherwise(F.col(at))
    return rows.select(*[F.col(c) for c in df.columns if c not in values], *[found[to].alias(to) for to in values])


def running(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str], itself: bool = True) -> DataFrame:
    """Adds sums (name: column) over the rows of each group before a row, and with ``itself`` over the row too, along an
    order that is unique in a group. Nulls are left out of sums; a sum over nothing is null; null is a group like others.

    A group may hold any share of the rows: rows are dealt out by sampled ranges of (by, order) and written once, and a
    range that goes on with the group of the range before it adds that group's sums so far. There are fewer of these
    offsets than ranges, so they are broadcast.
    """
    known = [*df.columns, *sums]
    range_, to_, earlier = fresh(known, "_range", "_to", "_earlier")
    all_, before_, here_ = (dict(zip(sums, fresh(known, *[f"{mark}{k}" for k in range(len(sums))]))) for mark in ("_all_", "_before_", "_here_"))
    keys = dict(zip(by, fresh(known, *[f"_by_{k}" for k in range(len(by))])))
    dealt = table(df.repartitionByRange(max(2, partitions(df.sparkSession)), *by, *order).withColumn(range_, F.spark_partition_id()))
    parts = dealt.groupBy(*by, range_).agg(*[F.sum(c).alias(all_[to]) for to, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    carried = parts.withColumns({before_[to]: F.sum(all_[to]).over(before) for to in sums} | {earlier: F.count(F.lit(1)).over(before)})
    offsets = carried.filter(F.col(earlier) > 0).select(F.col(range_).alias(to_), *[F.col(b).alias(keys[b]) for b in by], *before_.values())
    here = Window.partitionBy(*by, range_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    same = F.col(range_) == F.col(to_)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(keys[b]))
    rows = dealt.withColumns({here_[to]: F.sum(c).over(here) for to, c in sums.items()}).join(F.broadcast(offsets), same, "left")
    total = lambda to: F.coalesce(F.col(here_[to]) + F.col(before_[to]), F.col(here_[to]), F.col(before_[to]))
    own = [F.col(c) for c in df.columns if c not in sums]
    return rows.select(*own, *[total(to).alias(to) for to in sums])
