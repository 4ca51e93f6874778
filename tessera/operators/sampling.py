"""Filters, deterministic samples, orders and splits. All chance comes from hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import picked, unit_hash
from tessera.plans.store import fresh, ordinal, running
from tessera.schemas import MISSING, UNCONDITIONAL


def usable_text(text: Column) -> Column:
    return text.isNotNull() & ~text.isin("", MISSING)


def drop_missing(df: DataFrame, columns: list[str], to: str = "dropped") -> DataFrame:
    """Rows with a value in every column; the number of others is observed under ``to``."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    return df.observe(to, F.count_if(~full).alias("rows")).filter(full)


def head_fraction(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """The first floor(n * fraction) rows along a unique order. Only keys are ranked; rows are kept by the key at the cut."""
    at, n_, cut = fresh(df.columns, "_ordinal", "_n", "_cut")
    keys = ordinal(df.select(*order), order, at)
    n = keys.agg(F.count(F.lit(1)).alias(n_))  # one row
    last = keys.join(F.broadcast(n), F.col(at) == F.floor(F.col(n_) * F.lit(fraction)) - 1).select(F.struct(*order).alias(cut))  # at most one row
    return df.join(F.broadcast(last), F.struct(*order) <= F.col(cut)).select(*df.columns)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hash_shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A total order that depends on key and seed alone; seed 0 leaves the order as it is."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key) if seed else df


def mixed(parts: list[tuple[DataFrame, float]], order: list[str]) -> DataFrame:
    """The head fractions of several tables, one after another, missing columns being null."""
    taken = [df if f >= 1 else head_fraction(df, order, f) for df, f in parts]
    out = taken[0]
    for df in taken[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def layout(key: Column | str, to_image: float, seed: int = 0) -> Column:
    """t2i with the given probability, else i2t."""
    return F.when(unit_hash(key, seed=seed) < to_image, "t2i").otherwise("i2t")


def with_unconditional(prompt: Column, key: Column | str, share: float = 0.1, seed: int = 1) -> Column:
    return F.when(unit_hash(key, seed=seed) < share, UNCONDITIONAL).otherwise(prompt)


def prompt_from(prompts: list[str], key: Column | str, seed: int = 2) -> Column:
    return picked(prompts, key, seed=seed)


def halves(key: Column | str, seed: int = 3) -> Column:
    """0 or 1."""
    return (unit_hash(key, seed=seed) >= 0.5).cast("int")


def _placed(df: DataFrame, order: list[str], at: str | None) -> tuple[DataFrame, str]:
    """Rows with their ordinal, which ``at`` names if they have one already."""
    name = at or fresh(df.columns, "_ordinal")[0]
    return (df if at else ordinal(df, order, name)), name


def contiguous(df: DataFrame, order: list[str], k: int, to: str = "shard", at: str | None = None) -> DataFrame:
    """k runs of rows along a unique order, the first n mod k of them one longer. ``at``: a column that holds ordinals."""
    placed, name = _placed(df, order, at)
    n = fresh([*placed.columns, to], "_n")[0]
    rows = placed.join(F.broadcast(placed.agg(F.count(F.lit(1)).alias(n))))  # one row
    small, more, i = F.floor(F.col(n) / k), F.col(n) % k, F.col(name)
    edge = more * (small + 1)
    shard = F.when(i < edge, F.floor(i / (small + 1))).otherwise(more + F.floor((i - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn(to, shard.cast("int")).drop(n, *([] if at else [name]))


def round_robin(df: DataFrame, order: list[str], k: int, to: str = "shard", at: str | None = None) -> DataFrame:
    placed, name = _placed(df, order, at)
    return placed.withColumn(to, F.pmod(name, F.lit(k)).cast("int")).drop(*([] if at else [name]))


def proportional(df: DataFrame, order: list[str], k: int, to: str = "shard") -> DataFrame:
    """Slice r holds ordinals from round(r*n/k) to round((r+1)*n/k), halves rounding to even."""
    placed, name = _placed(df, order, None)
    n = fresh([*placed.columns, to], "_n")[0]
    rows = placed.join(F.broadcast(placed.agg(F.count(F.lit(1)).alias(n))))  # one row
    shard = F.lit(0)
    for r in range(1, k):
        shard = shard + (F.col(name) >= F.bround(F.lit(float(r)) * F.col(n) / k)).cast("int")
    return rows.withColumn(to, shard).drop(name, n)


def batches(df: DataFrame, order: list[str], size: int, to: str = "batch", at: str | None = None) -> DataFrame:
    """Runs of ``size`` rows along a unique order."""
    placed, name = _placed(df, order, at)
    return placed.withColumn(to, F.floor(F.col(name) / size).cast("int")).drop(*([] if at else [name]))


def every_kth(df: DataFrame, order: list[str], k: int) -> DataFrame:
    placed, name = _placed(df, order, None)
    return placed.filter(F.col(name) % k == 0).drop(name)


def top_k_with_ties(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Rows whose value is at least the k-th largest of their group. Spark limits each task's rows of a group by rank
    before it shuffles them, so only ties weigh."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))).filter(F.col("_rank") <= k).drop("_rank")


def nucleus(df: DataFrame, by: list[str], p: str, order: list[str], most: float) -> DataFrame:
    """Rows by falling probability until their sum has passed ``most``; the row that passes it stays."""
    summed = running(df, by, [F.desc(p), *order], {"_before": p}, itself=False)
    return summed.filter(F.coalesce("_before", F.lit(0.0)) <= most).drop("_before")


def softmax(df: DataFrame, by: list[str], x: str, temperature: float = 1.0, to: str = "p") -> DataFrame:
    """Adds softmax(x / temperature) within groups, of which null is one like others; a null x has a null result and no
    share. Maxima and sums are aggregated before they are joined, by keys that nulls equal."""
    names = fresh([*df.columns, to], "_top", "_sum", *[f"_by_{k}" for k in range(len(by))])
    top, total, keys = names[0], names[1], names[2:]
    scaled, same = F.col(x) / F.lit(temperature), F.lit(True)
    for b, k in zip(by, keys):
        same = same & F.col(b).eqNullSafe(F.col(k))
    renamed = lambda groups: groups.withColumnsRenamed(dict(zip(by, keys)))
    tops = renamed(df.groupBy(*by).agg(F.max(scaled).alias(top)))
    lifted = df.join(tops, same, "left")
    sums = lifted.groupBy(*keys, top).agg(F.sum(F.exp(scaled - F.col(top))).alias(total))
    return df.join(sums, same, "left").withColumn(to, F.exp(scaled - F.col(top)) / F.col(total)).drop(top, total, *keys)


def sampled_choice(df: DataFrame, by: list[str], p: str, order: list[str], seed: int = 4) -> DataFrame:
    """One row of each group, drawn with its probability by the group's hash."""
    drawn = unit_hash(*by, seed=seed)
    rows = running(df, by, order, {"_cdf": p}).filter(F.col("_cdf") > drawn * F.lit(1 - 1e-9))
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_cdf", *order))).filter("_at = 1").drop("_at", "_cdf")


def layer_range(df: DataFrame, layer: str, total: int, first: int, last: int) -> DataFrame:
    """Layers without the first and the last few."""
    return df.filter((F.col(layer) >= first) & (F.col(layer) < total - last))


def named_any(df: DataFrame, name: str, keywords: list[str]) -> DataFrame:
    """Rows whose name holds one of the keywords."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.col(name).contains(k)
    return df.filter(found)


def consistent_groups(df: DataFrame, order: list[str], size: int, key: str) -> DataFrame:
    """Runs of ``size`` rows along a unique order, as (group, key, n); a run of several keys is an error."""
    runs = ordinal(df, order, "_ordinal").groupBy(F.floor(F.col("_ordinal") / size).alias("group"))
    found = runs.agg(F.min(key).alias(key), F.max(key).alias("_last"), F.count(F.lit(1)).alias("n"))
    return found.withColumn(key, F.when(F.col(key) == F.col("_last"), F.col(key)).otherwise(F.raise_error(F.lit("a group has several keys")).cast(df.schema[key].dataType))).drop("_last")


def allowed_scores(scores: Column, allowed: list[int]) -> Column:
    """Scores of a small vocabulary, those of ids that aren't allowed being minus infinity."""
    ids = F.array(*map(F.lit, allowed))
    return F.transform(scores, lambda x, i: F.when(F.array_contains(ids, i), x.cast("double")).otherwise(F.lit(float("-inf"))))


def forced_separator(scores: Column, position: Column, every: int, separator: int) -> Column:
    """After each run of ``every`` ids only the separator may follow, elsewhere it may not."""
    due = F.pmod(position, F.lit(every + 1)) == every
    return F.transform(scores, lambda x, i: F.when(due == (i == separator), x.cast("double")).otherwise(F.lit(float("-inf"))))


def modal_scores(scores: Column, position: Column, vocab: int, kind: str, separator: int = -1, every: int = 32) -> Column:
    """Scores of a small vocabulary when only text (ids below ``vocab``) or only image codes may follow. In images a
    separator, if there is one, is forced with score 0 at each (every + 1)-th position, counted from 0."""
    if kind not in ("text", "image"):
        raise ValueError("kind must be text or image")
    low = F.lit(float("-inf"))
    if kind == "text":
        return F.transform(scores, lambda x, i: F.when(i < vocab, x.cast("double")).otherwise(low))
    due = F.pmod(position + 1, F.lit(every + 1)) == 0 if separator >= 0 else F.lit(False)
    plain = lambda x, i: F.when(i >= vocab, x.cast("double")).otherwise(low)
    return F.transform(scores, lambda x, i: F.when(due, F.when(i == separator, F.lit(0.0)).otherwise(low)).otherwise(plain(x, i)))


def allow_mask(ids: list[int], vocab: int) -> Column:
    """For each id of a small vocabulary whether it is allowed."""
    allowed = F.array(*map(F.lit, ids)).cast("array<int>")
    return F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda i: F.array_contains(allowed, i))
