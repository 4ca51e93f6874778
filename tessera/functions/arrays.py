"""Array columns: token ids, masks, vectors and small vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import CODES, IGNORE_INDEX, TEXT_VOCAB


def masked_prefix(ids: Column, n: Column | int) -> Column:
    """ids with the first n replaced by the label that is ignored."""
    return F.transform(ids, lambda x, i: F.when(i < n, F.lit(IGNORE_INDEX)).otherwise(x))


def is_vision(ids: Column, vocab: int = TEXT_VOCAB, start: int | None = None, separators: list[int] = ()) -> Column:
    """For each id whether it is an image code, the start mark or a separator."""
    also = F.array(*[F.lit(x) for x in [*([] if start is None else [start]), *separators]]).cast("array<bigint>")
    return F.transform(ids, lambda x: (x >= vocab) | F.array_contains(also, x.cast("bigint")))


def code_ids(codes: Column, vocab: int = TEXT_VOCAB) -> Column:
    return F.transform(codes, lambda x: x + vocab)


def ids_code(ids: Column, vocab: int = TEXT_VOCAB) -> Column:
    return F.transform(ids, lambda x: F.greatest(F.lit(0), F.least(F.lit(CODES - 1), x - vocab)))


def insert_separators(ids: Column, every: int, separator: int) -> Column:
    """A separator after each run of ``every`` ids, whose number it must divide."""
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(ids) / every).cast("int") - 1), lambda i: F.concat(F.slice(ids, i * every + 1, F.lit(every)), F.array(F.lit(separator))))
    return F.when(F.size(ids) % every != 0, F.raise_error(F.lit(f"length is not a multiple of {every}"))).when(F.size(ids) == 0, ids).otherwise(F.flatten(runs))


def rotated(items: Column, by: Column) -> Column:
    return F.concat(F.slice(items, by + 1, F.size(items)), F.slice(items, F.lit(1), by))


def until(ids: Column, end: int) -> Column:
    """ids before the first ``end``, or all."""
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int") - 1)).otherwise(ids)


def left_padded(ids: Column, width: Column | int, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.lit(width) - F.size(ids)), ids)


def attention(ids: Column, width: Column | int) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.lit(width) - F.size(ids)), F.array_repeat(F.lit(1), F.size(ids)))


def selected(items: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(items.alias("x"), mask.alias("m")), lambda z: z["m"]), lambda z: z["x"])


def scattered(items: Column, mask: Column, values: Column) -> Column:
    """items with those under the mask replaced by ``values`` in order; the inverse of ``selected``."""
    before = lambda i: F.size(F.filter(F.slice(mask, F.lit(1), i + 1), lambda m: m))
    return F.transform(items, lambda x, i: F.when(F.element_at(mask, i + 1), F.try_element_at(values, before(i))).otherwise(x))


def chosen(mask: Column, a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(mask.alias("m"), a.alias("a"), b.alias("b")), lambda z: F.when(z["m"], z["a"]).otherwise(z["b"]))


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    """Classifier-free guidance: u + (c - u) * scale."""
    return F.zip_with(unconditional, conditional, lambda u, c: u + (c - u) * scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine similarity; null if a norm is zero (and eps is)."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), F.greatest(norms, F.lit(eps)) if eps else norms)


def unit_hash(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and seed alone."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003


def picked(items: list[str], *key: Column | str, seed: int = 0) -> Column:
    """One of the items, by the key's hash."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(len(items))) + 1).cast("int"))
