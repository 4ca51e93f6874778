"""Codebooks, similarities and multi-level averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import cosine
from tessera.plans.store import discard, ordinal, table

#: Entries of a codebook that are sent to every task at once, and distances that a task holds at once.
CODEBOOK, DISTANCES = 1 << 16, 1 << 22


def nearest_code(df: DataFrame, vec: str, codebook: DataFrame, code: str = "code_id", code_vec: str = "code_vec") -> DataFrame:
    """Adds code_id and code_dist (squared) of the nearest entry; the smallest id of equals. Vectors without finite
    numbers or of another length get null. A codebook of more than CODEBOOK entries is sent out in blocks of so many, in
    order of id; between blocks the rows are written with the nearest entry so far."""
    entries = codebook.select(code, code_vec)
    first = entries.orderBy(code).limit(CODEBOOK + 1).collect()
    if len(first) <= CODEBOOK:
        found = _nearer(df, vec, first, None)
    else:
        del first
        placed = table(ordinal(entries, [code], "_at"))
        n, found, written = placed.count(), df, None
        for a in range(0, n, CODEBOOK):
            block = placed.filter((F.col("_at") >= a) & (F.col("_at") < a + CODEBOOK)).orderBy("_at").select(code, code_vec).collect()
            found = _nearer(found, vec, block, "_code" if a else None)
            if a + CODEBOOK < n:
                found = table(found)
                if written is not None:
                    discard(written)
                written = found
        discard(placed)
    return found.select(*[F.col(c) for c in df.columns], "_code.*")


def _nearer(df: DataFrame, vec: str, entries: list, so_far: str | None) -> DataFrame:
    """``df`` with _code, the nearest of ``entries``, which are in order of id, and of the one in ``so_far``."""
    ids = np.array([e[0] for e in entries], np.int64)
    book = np.array([e[1] for e in entries], np.float64).reshape(len(ids), -1)
    sent = df.sparkSession.sparkContext.broadcast((ids, book, (book * book).sum(axis=1)))

    @F.pandas_udf("code_id long, code_dist double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ids, book, norms = sent.value
        step = max(1, min(1024, DISTANCES // max(1, len(ids))))
        for vecs, known, dist in batches:
            known, dist = [None if pd.isna(x) else i for i, x in zip(known, dist)], dist.tolist()
            at = [i for i, v in enumerate(vecs) if v is not None and len(v) == book.shape[1] and np.isfinite(np.asarray(v, np.float64)).all()]
            for a in range(0, len(at), step) if len(ids) else ():
                x = np.array([vecs.iloc[i] for i in at[a : a + step]], np.float64)
                d = norms - 2 * x @ book.T
                # what rounding can't tell apart is measured again, term by term
                near = d <= d.min(axis=1, keepdims=True) + 1e-9
                for k, i in enumerate(at[a : a + step]):
                    c = np.flatnonzero(near[k])
                    exact = ((x[k] - book[c]) ** 2).sum(axis=1)
                    if known[i] is None or exact.min() < dist[i]:
                        known[i], dist[i] = int(ids[c[exact.argmin()]]), exact.min()
            yield pd.DataFrame({"code_id": pd.array(known, "Int64"), "code_dist": [None if i is None else x for i, x in zip(known, dist)]})

    # ids come without nulls, which would make them floats
    before = (F.coalesce(f"{so_far}.code_id", F.lit(0)), F.col(f"{so_far}.code_dist")) if so_far else (F.lit(0).cast("long"), F.lit(None).cast("double"))
    return df.withColumn("_code", run(F.col(vec), *before))


def gather_codes(df: DataFrame, code: str, codebook: DataFrame, book_code: str = "code_id", code_vec: str = "code_vec") -> DataFrame:
    return df.join(codebook.select(F.col(book_code).alias(code), code_vec), code)


def remap(df: DataFrame, code: str, used: DataFrame, unknown: int, old: str = "code_id", new: str = "new_id") -> DataFrame:
    """Adds new_id: the used set's number for the code, or ``unknown``."""
    return df.join(used.select(F.col(old).alias(code), F.col(new)), code, "left").withColumn(new, F.coalesce(new, F.lit(unknown)))


def unmap(df: DataFrame, code: str, used: DataFrame, old: str = "code_id", new: str = "new_id") -> DataFrame:
    """The inverse; a number beyond the used set counts as 0."""
    inverse = used.select(F.col(new).alias(code), F.col(old))
    known = df.join(inverse.select(code), code, "left_semi").join(inverse, code)
    other = df.join(inverse.select(code), code, "left_anti").withColumn("_zero", F.lit(0).cast(df.schema[code].dataType))
    return known.unionByName(other.join(F.broadcast(inverse.filter(F.col(code) == 0).select(F.col(code).alias("_zero"), old)), "_zero", "left").drop("_zero"))


def mean_vector(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """Element-wise means in long form (by, pos, value), and as arrays."""
    long = df.select(*by, F.posexplode(vec).alias("pos", "value")).groupBy(*by, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("mean_vec"))


def adjusted_similarity(pairs: DataFrame, baseline: DataFrame, name: str, a: str, b: str, base: str = "base") -> DataFrame:
    """Cosine similarity of each pair less the baseline of the same name."""
    return pairs.withColumn("raw", cosine(F.col(a), F.col(b))).join(baseline, name).withColumn("adjusted", F.col("raw") - F.col(base))


def level_averages(df: DataFrame, group: str, checkpoint: str, layer: str, value: str) -> DataFrame:
    """Means by (group, layer), (checkpoint, layer), (layer) and (checkpoint, group) in one pass."""
    g, c, y = (F.col(x) for x in (group, checkpoint, layer))
    return df.groupingSets([[g, y], [c, y], [y], [c, g]], g, c, y).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.grouping_id().alias("level"))


def in_both(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    return ours.join(theirs.select(*keys).distinct(), keys, "left_semi")


def lead_over(df: DataFrame, by: list[str], order: list[str], column: str, to: str, k: int = 1) -> DataFrame:
    """Adds the column's value k rows later in the group, null past its end. Rows are matched by their place in the
    table's order by (by, order), which is unique, so a group of any size is spread."""
    placed = ordinal(df, [*by, *order], "_at")
    later = placed.select((F.col("_at") - k).alias("_ahead"), *[F.col(b).alias(f"_by_{b}") for b in by], F.col(column).alias("_later"))
    same = F.col("_at") == F.col("_ahead")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return placed.join(later, same, "left").select(*[F.col(c) for c in df.columns if c != to], F.col("_later").alias(to))


def visible_pairs(df: DataFrame, sequence: str, position: str, modality: str, real: str) -> DataFrame:
    """(sequence, n_pairs): ordered pairs of real positions of one modality, the key not after the query.

    Counted from ranks (a position sees itself and those before it of its modality), so no pair is made.
    """
    counts = df.filter(F.col(real)).groupBy(sequence, modality).agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy(sequence).agg(F.sum(F.col("k") * (F.col("k") + 1) / 2).cast("long").alias("n_pairs"))


def routed(df: DataFrame, mask: str, yes, no) -> DataFrame:
    """Rows to one of two transforms by a predicate, with all rows back in one table."""
    return yes(df.filter(F.col(mask))).unionByName(no(df.filter(~F.coalesce(F.col(mask), F.lit(False)))))
