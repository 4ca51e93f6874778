"""Token statistics and n-gram entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.store import fresh, ordinal, running


def words_of(text: Column) -> Column:
    """White-space tokens."""
    return F.array_remove(F.split(text, r"\s+"), "")


def _grams(df: DataFrame, tokens: str, n: int, by: list[str]) -> tuple[DataFrame, list[str]]:
    """(by, c) and a column for each token of an n-gram, whose names are given too: counts of n-grams inside each row's tokens."""
    if not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    t, parts = F.col(tokens), fresh([*by, "c"], *[f"_token_{i}" for i in range(n)])
    beside = F.arrays_zip(*[F.slice(t, F.lit(i + 1), F.size(t) - n + 1) for i in range(n)])
    rows = df.filter(F.size(t) >= n).select(*by, F.inline(beside).alias(*parts))
    return rows.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("c")), parts


def ngram_counts(df: DataFrame, tokens: str, n: int, by: list[str]) -> DataFrame:
    """(by, gram, c): counts of n-grams inside each row's tokens."""
    grams, parts = _grams(df, tokens, n, by)
    return grams.select(*by, F.array(*parts).alias("gram"), "c")


def conditional_entropy(df: DataFrame, tokens: str, n: int, by: list[str], cross: list[str] | None = None) -> DataFrame:
    """(by, n_grams, h): bits of the n-th token given the n-1 before it; for n = 1 the entropy of tokens.

    With c counts of n-grams and p sums of c over equal prefixes, h = (sum p log2 p - sum c log2 c) / sum c: two
    aggregations with partial sums and no join. ``cross``: a unique order along which n-grams also run over the
    ends of rows.
    """
    rows = crossing(df, tokens, n, cross) if cross and n > 1 else df
    grams, parts = _grams(rows, tokens, n, by)
    c = F.col("c").cast("double")
    prefixes = grams.groupBy(*by, *parts[:-1]).agg(F.sum("c").alias("p"), F.sum(c * F.log2(c)).alias("s"))
    p = F.col("p").cast("double")
    return prefixes.groupBy(*by).agg(F.sum("p").alias("n_grams"), (F.sum(p * F.log2(p) - F.col("s")) / F.sum(p)).alias("h"))


def crossing(df: DataFrame, tokens: str, n: int, order: list[str]) -> DataFrame:
    """Each row's tokens followed by the first n-1 tokens after its end, from as many following rows as needed."""
    placed = ordinal(df.filter(F.size(tokens) > 0), order, "_at")
    heads = placed.select("_at", F.slice(F.col(tokens), F.lit(1), F.lit(n - 1)).alias("_head"))
    ahead = heads.select(F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("_k"), "_at", "_head").select((F.col("_at") - F.col("_k")).alias("_at"), "_k", "_head")
    tails = ahead.groupBy("_at").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_head"))), lambda x: x["_head"])), F.lit(1), F.lit(n - 1)).alias("_tail"))
    joined = placed.join(tails, "_at", "left")
    return joined.withColumn(tokens, F.concat(F.col(tokens), F.coalesce("_tail", F.slice(F.col(tokens), F.lit(1), F.lit(0))))).drop("_tail", "_at")


def modality_totals(df: DataFrame, tokens: Column, vision: Column, by: list[str] = ()) -> DataFrame:
    """Sums of text and vision tokens, samples, and the vision share."""
    text = F.sum(tokens - vision)
    out = df.groupBy(*by) if by else df.groupBy()
    return out.agg(text.alias("text_tokens"), F.sum(vision).alias("vision_tokens"), F.count(F.lit(1)).alias("samples"), F.coalesce(F.try_divide(F.sum(vision), F.sum(tokens)), F.lit(0.0)).alias("vision_share"))


def usage_totals(df: DataFrame, usage: str, keys: list[str]) -> DataFrame:
    return df.agg(*[F.sum(F.coalesce(F.col(usage)[k], F.lit(0))).alias(k) for k in keys])


def running_totals(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Sums of columns up to and with each row of its group, along an order that is unique in the group."""
    return running(df, by, order, {f"{c}_so_far": c for c in columns})


def summary_json(df: DataFrame, columns: list[str], to: str = "summary") -> DataFrame:
    """Each row's columns as one JSON object."""
    return df.select(F.to_json(F.struct(*columns)).alias(to))
