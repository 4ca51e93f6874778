"""Best-fit packing of token pieces by patterns.

All that decides is the histogram of piece lengths, which has at most ``capacity`` bars whatever the input. Patterns
of a few lengths that fill a sequence are enumerated for every length, dearest first by what the fit so far leaves
over; non-negative least squares fits how often each is repeated; the counts are rounded within what there is, and
what rounding leaves is fitted again; best fit packs the residual histogram, again by patterns with repeat counts.
Rows then find their place by their rank among the pieces of their length, so no row's place depends on another task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ranked, small_batches, table, temporary

CAPACITY = 2048
#: Members of a pattern, rounds in which patterns are priced and added, and steps of a fit. They bound the driver's work;
#: whatever the fit leaves over is packed by best fit.
MEMBERS, ROUNDS, STEPS = 5, 4, 60
#: Tokens of 2048 that patterns may leave free, the fullest patterns first. Of what is left, a fit that packs no more
#: than the share AGAIN isn't repeated. Fitted counts below LEAST are none.
WASTE, AGAIN, LEAST = (0, 2, 16, 128), 0.05, 0.02


# ---------------------------------------------------------------- tokens
@cache
def _full(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@cache
def _fast(ranks_path: str):
    """A faster coder of the same vocabulary, for texts on which the two agree by rule."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Outside these (letters, marks and signs that every Unicode version classes alike) the JSON tokenizer itself is used.
_BEYOND = regex.compile(r"[^\x00-\x1b\x20-˿Ͱ-ͷΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞]|<\|")


def encode(texts: list[str], json_path: str, ranks_path: str | None = None) -> Iterator[np.ndarray]:
    """Ids of each text, as the JSON tokenizer gives them without special tokens added."""
    for t in texts:
        if ranks_path and not _BEYOND.search(t):
            yield np.array(_fast(ranks_path).encode_ordinary(t), "<u4")
        else:
            yield np.array(_full(json_path).encode(t, add_special_tokens=False).ids, "<u4")


def pieces(df: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and a final 0. Only documents longer than
    ``capacity`` are cut; all pieces but the first then have that length."""
    small_batches(df.sparkSession)
    schema = T.StructType(
        [T.StructField("_id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch.column(0), ([], [], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, ids in enumerate(encode(texts, json_path, ranks_path)):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for to, v in zip(rows, (k, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        to.append(v)
            arrays = [own.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, schema)


# ---------------------------------------------------------------- plan
def _fullest(price: np.ndarray, have: np.ndarray, capacity: int, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``most`` lengths out of ``have``: the greatest sum of prices with which so many of them sum to exactly
    s, the last length of such a sum, and the largest sum up to s that there is (-1: none)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(most):
        best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
        if not k:
            best[have], last[have] = price[have], have
        else:
            for n in have.tolist():
                sums = out[-1][0][: capacity + 1 - n] + price[n]
                if len(at := np.flatnonzero(sums > best[n:])):
                    best[n + at], last[n + at] = sums[at], n
        out.append((best, last, np.maximum.accumulate(np.where(np.isfinite(best), np.arange(capacity + 1), -1))))
    return out


def patterns(price: np.ndarray, left: np.ndarray, capacity: int, waste: int, most: int = MEMBERS) -> np.ndarray:
    """For each length and each number of further members (up to ``most`` in all) the fullest pattern that it begins,
    the dearest of equally full ones, if it leaves no more than ``waste`` free and ``left`` has its lengths."""
    have, found = np.flatnonzero(left), []
    waste = max(waste, int(have[0]) - 1)  # what no length fits into is no waste
    for k, (_, _, full) in enumerate(sums := _fullest(price, have, capacity, most - 1)):
        to = full[capacity - have]
        at = (to >= 0) & (capacity - have - to <= waste)
        first, rest = have[at], to[at]
        made = np.zeros((len(first), most), np.int64)
        made[:, 0] = first
        for j in range(k, -1, -1):
            made[:, k - j + 1] = n = sums[j][1][rest]
            rest = rest - n
        found.append(made)
    alone = have[capacity - have <= waste]
    found.append(np.pad(alone[:, None], ((0, 0), (0, most - 1))))
    made = -np.sort(-np.concatenate(found), axis=1)
    times = (made[:, :, None] == made[:, None, :]).sum(axis=2)
    return made[((times <= left[made]) | (made == 0)).all(axis=1)]


def _lengths(made: np.ndarray, repeats: np.ndarray, capacity: int) -> np.ndarray:
    """How often patterns so repeated use each length."""
    out = np.bincount(made.ravel(), np.repeat(repeats, made.shape[1]), capacity + 1)
    out[0] = 0
    return out


def fit(made: np.ndarray, counts: np.ndarray, rounds: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram in least squares, by
    multiplicative steps, of which none raises the error."""
    wanted = counts.astype(float)
    wanted[0] = 0
    aim, x = wanted[made].sum(axis=1), np.ones(len(made))
    for _ in range(rounds):
        x = x * aim / np.maximum(_lengths(made, x, len(counts) - 1)[made].sum(axis=1), 1e-12)
    return x


def fitted(left: np.ndarray, capacity: int, waste: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Patterns with their repeat counts: priced by what the fit so far leaves over, added, and all fitted anew, until
    ROUNDS are over or no pattern is new. ``rng`` keeps equal prices from always choosing the same lengths."""
    made, x, rest = np.zeros((0, MEMBERS), np.int64), np.zeros(0), left.astype(float)
    for _ in range(ROUNDS):
        price = np.maximum(rest, 0) * (1 + rng.random(capacity + 1))
        more = np.unique(np.concatenate([made, patterns(price, left, capacity, waste)]), axis=0)
        if len(more) == len(made):
            break
        made = more
        x = fit(made, left)
        rest = left - _lengths(made, x, capacity)
    return made, x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together use each length exactly counts[length] times; no pattern exceeds the capacity."""
    by_fit, residual = split_plan(counts, capacity)
    return by_fit + residual


def split_plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], list[tuple[tuple[int, ...], int]]]:
    """What the fitted patterns pack, and what best fit packs of the rest.

    Rounded counts can't use up every length, so what they leave is fitted again, with patterns that may leave
    ever more free, for as long as that packs a good part of it.
    """
    left, out, rng = counts.astype(np.int64).copy(), [], np.random.default_rng(0)
    for waste in WASTE:
        waste = capacity * waste // CAPACITY
        while left.any():
            made, x = fitted(left, capacity, waste, rng)
            before = int(left.sum())
            for k in np.argsort(-x, kind="stable").tolist():
                if x[k] < LEAST:
                    break
                at, n = np.unique(made[k][made[k] > 0], return_counts=True)
                if take := int(min(max(1, np.floor(x[k] + 0.5)), (left[at] // n).min())):
                    left[at] -= take * n
                    out.append((tuple(made[k][made[k] > 0].tolist()), take))
            if before - int(left.sum()) <= AGAIN * before:
                break
    return out, best_fit(left, capacity)


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats for a residual histogram: the largest first, then what fits best, over and over."""
    left, out = counts.astype(np.int64).copy(), []
    have = np.flatnonzero(left).tolist()
    while have:
        p, room, used = [], capacity, {}
        while True:
            i = bisect_right(have, room) - 1
            while i >= 0 and left[have[i]] <= used.get(have[i], 0):
                i -= 1
            if i < 0:
                break
            n = have[i]
            if p and room - n and (pair := _exact(have, left, used, room)):
                for y in pair:
                    used[y] = used.get(y, 0) + 1
                p += pair
                break
            used[n] = used.get(n, 0) + 1
            p.append(n)
            room -= n
        take = int(min(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= take * k
            if not left[n]:
                have.remove(n)
        out.append((tuple(p), take))
    return out


def _exact(have: list[int], left: np.ndarray, used: dict[int, int], room: int) -> list[int] | None:
    """Two remaining lengths that fill the room exactly, if there are any."""
    for a in have:
        b = room - a
        if b < a:
            return None
        if left[b] > used.get(b, 0) and left[a] > used.get(a, 0) and (a != b or left[a] > used.get(a, 0) + 1):
            return [b, a]
    return None


def _slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which runs begin, and each run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for p, n in packed:
        offset = 0
        for length in p:
            insort(runs.setdefault(length, []), (used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length", order: list[str] = ("_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset, in place of columns so named, to rows with a ``length`` of 1 to ``capacity``."""
    # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in parts.groupBy(length).count().collect():
        counts[n] = k
    slots = parts.sparkSession.sparkContext.broadcast(_slots(plan(counts, capacity)))  # bounded by the patterns

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            at = np.flatnonzero(n == x)
            starts, firsts, offsets = slots.value[int(x)]
            k = np.searchsorted(starts, r[at], side="right") - 1
            sequence[at] = firsts[k] + r[at] - starts[k]
            offset[at] = offsets[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    own = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    tie, rank, found = fresh(own, "_tie", "_rank", "_place")
    dealt = ranked(parts.select(*own, F.monotonically_increasing_id().alias(tie)), [length], [*order, tie], rank)
    return dealt.withColumn(found, place(length, rank)).select(*own, f"{found}.*")


def pack_documents(df: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one token. Null and repeated ids are packed like others. An empty table
    gives an empty result. Other columns are not read.
    """
    with temporary() as made:
        packed = pack(table(pieces(df, json_path, ranks_path, capacity, id_col, text_col)), capacity)
        made.keep(made.tables[-1])  # the pieces dealt out for their places
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
