"""Scores of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import category_levels
from tessera.plans.store import beside, fresh


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_report(df: DataFrame, truth: str, prediction: str, by: list[str] = (), positive: str = "yes", negative: str = "no") -> DataFrame:
    """Accuracy over valid predictions, and precision, recall and F1 of the positive label (0 where undefined)."""
    t, p = F.col(truth), F.col(prediction)
    n = lambda c: F.count_if(c).cast("double")
    rows = df.filter(p.isin(positive, negative))
    found = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(t == p).alias("_ok"), n((t == positive) & (p == positive)).alias("_tp"), n((t != positive) & (p == positive)).alias("_fp"), n((t == positive) & (p != positive)).alias("_fn")
    )
    precision, recall = ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    return found.select(*by, "n", ratio(F.col("_ok"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def paired(df: DataFrame, order: str, correct: str, to: str = "pair_correct") -> DataFrame:
    """Rows with whether they and the next row along ``order`` are both correct, for rows at even values of it."""
    after = fresh([*df.columns, to], "_next")[0]
    both = F.coalesce(F.col(correct) & F.col(after), F.lit(False))
    return beside(df, [order], {after: correct}).withColumn(to, F.when(F.col(order) % 2 == 0, both).otherwise(False)).drop(after)


def category_scores(df: DataFrame, category: str, correct: str, pair: str | None = None) -> DataFrame:
    """By category: n, acc, and with ``pair`` acc_plus = right pairs / (n / 2). Null answers don't count in acc."""
    aggregates = [F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("acc")]
    if pair:
        aggregates.append((F.count_if(F.col(pair)) / (F.count(F.lit(1)) / 2.0)).alias("acc_plus"))
    return df.groupBy(category).agg(*aggregates)


def macro(scores: DataFrame, columns: list[str]) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(c) for c in columns])


def perception(scores: DataFrame, category: str, listed: list[str]) -> DataFrame:
    """100 * the sum of acc and acc_plus over the listed categories, whatever their case."""
    return scores.filter(F.lower(category).isin([x.lower() for x in listed])).agg((100 * F.sum(F.col("acc") + F.col("acc_plus"))).alias("perception"))


def accuracy(df: DataFrame, correct: str, by: list[str] = ()) -> DataFrame:
    """Share of rows that are correct; null counts as wrong."""
    return df.groupBy(*by).agg(F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def all_rotations(df: DataFrame, key: str, correct: str) -> DataFrame:
    return df.groupBy(key).agg(F.every(F.coalesce(F.col(correct), F.lit(False))).alias("passed"))


def gated(questions: Column) -> Column:
    """Of an array of (qid, parents, score) in file order: [(qid, score)], a score being 0 once a parent's is.

    A parent gates with the score that it has when the walk comes to the child: its gated score if it stands before
    the child, its own if it stands after. Parent 0 is the root. Null if a question has a parent that isn't among
    the questions.
    """
    known = F.transform(questions, lambda q: q["qid"])
    whole = F.forall(questions, lambda q: F.forall(q["parents"], lambda p: (p == 0) | F.array_contains(known, p)))
    start = F.transform(F.slice(questions, F.lit(1), F.lit(0)), lambda q: F.struct(q["qid"].alias("qid"), q["score"].cast("double").alias("score")))

    def step(done: Column, q: Column) -> Column:
        shut = F.exists(done, lambda d: (d["score"] == 0) & F.array_contains(q["parents"], d["qid"]))
        later = F.exists(questions, lambda o: F.array_contains(q["parents"], o["qid"]) & (o["score"] == 0) & ~F.exists(done, lambda d: d["qid"] == o["qid"]))
        return F.concat(done, F.array(F.struct(q["qid"].alias("qid"), F.when(shut | later, 0.0).otherwise(q["score"].cast("double")).alias("score"))))

    return F.when(whole, F.aggregate(questions, start, step))


def gate_scores(df: DataFrame, item: str, qid: str, parents: str, score: str, order: str | None = None) -> DataFrame:
    """(item, n, raw, gated): means of question scores before and after gating, along ``order`` (by default qid). An
    item's questions are few."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order or qid).alias("order"), F.col(qid).alias("qid"), F.col(parents).alias("parents"), F.col(score).alias("score"))))
    rows = df.groupBy(item).agg(each.alias("_q")).withColumn("_g", gated(F.col("_q")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, q: s + q["score"].cast("double")) / F.size(a)
    return rows.filter("_g is not null").select(item, F.size("_q").alias("n"), mean(F.col("_q")).alias("raw"), mean(F.col("_g")).alias("gated"))


def nested_mean(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean of means: over the last level first, then outwards."""
    out = df
    for k in range(len(levels), 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg(value).alias(value))
    return out.agg(F.avg(value).alias(value))


def category_rollup(df: DataFrame, first: str, second: str, score: str) -> DataFrame:
    """Means by (first, second), by first and over all."""
    return df.rollup(first, second).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def last_runs(df: DataFrame, order: str, key: str) -> DataFrame:
    """Rows of each key's last run of consecutive rows along ``order``; earlier runs of a key are overwritten.

    A run starts where the row before has another key. Starts are joined back by key, of which there is one row each.
    """
    before, has, start, own = fresh(df.columns, "_before", "_has", "_from", "_key")
    marked = beside(df.withColumn(has, F.lit(True)), [order], {before: key, start: has}, later=False)
    starts = marked.filter(F.col(start).isNull() | ~F.col(key).eqNullSafe(F.col(before)))
    last = starts.groupBy(F.col(key).alias(own)).agg(F.max(order).alias(start))
    return df.join(last, F.col(key).eqNullSafe(F.col(own))).filter(F.col(order) >= F.col(start)).select(*df.columns)


def with_category(results: DataFrame, questions: DataFrame, key: str, category: str) -> DataFrame:
    """Results with the category of their question, or null; keys are compared as numbers."""
    asked = questions.select(F.col(key).try_cast("double").alias("_asked"), category)
    return results.join(asked, F.col(key).try_cast("double") == F.col("_asked"), "left").drop("_asked")


def levels(df: DataFrame, label: str) -> DataFrame:
    """Adds first and second level of a category label."""
    first, second = category_levels(F.col(label))
    return df.withColumns({"first": first, "second": second})


def category_counts(df: DataFrame, item: str, category: str) -> DataFrame:
    """(category, n, items): questions, and items that have any."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(item)).alias("items"))


def gathered_mean(df: DataFrame, rank: str, value: str) -> DataFrame:
    """(ranks, n, mean): over the values that ranks hold; a rank's part is a sum and a count, not a list."""
    parts = df.groupBy(rank).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    return parts.agg(F.count(F.lit(1)).alias("ranks"), F.sum("k").alias("n"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean"))


def ceiling(a: Column, b: int) -> Column:
    """a / b rounded up, for whole numbers."""
    return F.floor((a + (b - 1)) / b).cast("long")


def backoff(attempt: Column, base: float = 1.0) -> Column:
    """Seconds to wait before a try: base doubled by each earlier one."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt)
