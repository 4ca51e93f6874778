"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features: each turn fits one shallow tree to the residuals over that feature's bins and adds
its (shrunken) values to the feature's lookup table. The pairs with the largest remaining gain then get tables of
their own in the same way. A score is the sum of a few looked-up numbers; no label, language, source or id is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: By default the model is fitted on about so many labelled documents: those whose hash of id falls under their share.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS = 48, 10, 12
FEATURES = (
    "log_chars", "log_words", "log_lines", "upper", "digit", "punct", "space", "other", "bang", "bar", "word_mean", "word_std", "word_max", "distinct", "top_word", "top5", "bigram_repeat",
    "line_mean", "line_repeat", "line_repeat_chars", "short_lines", "ended_lines", "long_words", "one_letter", "question", "dots", "symbols", "hash_tags", "links", "caps_words", "non_ascii", "entropy",
)


@cache
def _classes() -> np.ndarray:
    """Of each code point: 0 lower-case or other letter, 1 upper, 2 digit, 3 punctuation or symbol, 4 space, 5 other."""
    out = np.full(0x110000, 5, np.uint8)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            out[c] = x.isupper()
        elif x.isdigit():
            out[c] = 2
        elif x.isspace():
            out[c] = 4
        elif x.isprintable():
            out[c] = 3
    return out


def features(text: str | None) -> np.ndarray:
    """Numbers in the order of FEATURES. Null counts as empty."""
    text = text or ""
    n = max(1, len(text))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_classes()[points], minlength=6) / n
    low = np.bincount(points[points < 128], minlength=128)
    share = low[low > 0] / n
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    common = [c for _, c in Counter(words).most_common(5)] or [0]
    pairs = max(1, len(words) - 1)
    lines = [x for x in text.split("\n") if x]
    seen = Counter(lines)
    line_sizes = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    repeats = sum((c - 1) * len(x) for x, c in seen.items())
    return np.array(
        [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], low[33] / m, low[124] / m,
            sizes.mean(), sizes.std(), min(sizes.max(), 200), len(set(words)) / m, common[0] / m, sum(common) / m, 1 - len(set(zip(words, words[1:]))) / pairs if len(words) > 1 else 0,
            np.log1p(line_sizes.mean()), 1 - len(seen) / max(1, len(lines)), repeats / n, (line_sizes < 40).mean(), np.mean([x.rstrip()[-1:] in ".!?:;\"'" for x in lines]) if lines else 0,
            (sizes > 20).mean(), (sizes == 1).mean(), low[63] / m, text.count("...") / m, (low[60] + low[62] + low[123] + low[125] + low[61] + low[95]) / n, low[35] / m,
            (text.count("http") + text.count("www.")) / m, sum(map(str.isupper, words)) / m, (len(text) - low.sum()) / n, float(-(share * np.log(share)).sum()),
        ]
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tree(g: np.ndarray, h: np.ndarray, leaves: int, weight: float) -> np.ndarray:
    """Values of a best-first tree over ordered bins, from sums of gradients and hessians: one per bin."""
    gain = lambda a, b: a * a / (b + weight)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        lg, lh = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
        rg, rh = cg[b] - cg[a + 1 : b], ch[b] - ch[a + 1 : b]
        x = np.where((lh > 1) & (rh > 1), gain(lg, lh) + gain(rg, rh) - gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
        k = int(x.argmax())
        return float(x[k]), a + 1 + k

    parts = [(0, len(g))]
    while len(parts) < leaves:
        (top, cut), k = max((best(*p), i) for i, p in enumerate(parts))
        if top <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + weight)
    return out


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.08, weight: float = 3.0) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        mean = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return
        bins, coarse = self.bins(x)
        f = np.full(len(y), self.bias)
        for _ in range(rounds):
            for j, table in enumerate(self.tables):
                p = sigmoid(f)
                step = rate * tree(np.bincount(bins[j], p - y, len(table)), np.bincount(bins[j], p * (1 - p), len(table)), 3, weight)
                table += step
                f += step[bins[j]]
        p = sigmoid(f)
        gains = {}
        for a, b in combinations(range(len(self.tables)), 2):
            cell = coarse[a] * (len(self.coarse[b]) + 1) + coarse[b]
            g, h = np.bincount(cell, p - y), np.bincount(cell, p * (1 - p))
            gains[a, b] = float((g * g / (h + 4 * weight)).sum())
        for a, b in sorted(gains, key=lambda k: -gains[k])[:PAIRS]:
            self.pairs[a, b] = np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))
        for _ in range(rounds // 4):
            for (a, b), table in self.pairs.items():
                p = sigmoid(f)
                cell = coarse[a] * table.shape[1] + coarse[b]
                g = np.bincount(cell, p - y, table.size).reshape(table.shape)
                h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                step = rate * self.tree2(g, h, 2 * weight)
                table += step
                f += step[coarse[a], coarse[b]]

    @staticmethod
    def tree2(g: np.ndarray, h: np.ndarray, weight: float) -> np.ndarray:
        """A tree that first cuts the one axis, then each part along the other."""
        options = []
        for turn in (False, True):
            a, b = (g.T, h.T) if turn else (g, h)
            first = tree(a.sum(1), b.sum(1), 2, weight)
            out = np.zeros_like(a)
            for v in np.unique(first):
                rows = first == v
                out[rows] = tree(a[rows].sum(0), b[rows].sum(0), 2, weight)
            out = out.T if turn else out
            options.append((float((g * out + 0.5 * h * out * out).sum()), turn, out))
        return min(options, key=lambda o: o[:2])[2]

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return ([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], [np.searchsorted(c, v, side="right") for c, v in zip(self.coarse, x.T)])

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self.bins(x)
        f = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            f += table[bins[j]]
        for (a, b), table in self.pairs.items():
            f += table[coarse[a], coarse[b]]
        return sigmoid(f)


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(matrix(texts.tolist())), dtype=object)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: str = "true", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` labelled documents (never over four times that) where ``learn`` (a predicate on doc_id) holds.
    Only features of their texts reach the driver. An id with several labels counts as its highest; rows without an id or a
    label teach nothing; repeated documents count each."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter(learn).filter("y is not null and doc_id is not null")
    n = max(1, known.count())
    at = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    # about `sample` rows of two numbers
    picked = known.filter(at < min(1 << 30, (sample << 30) // n)).groupBy("doc_id").agg(F.max("y").alias("y")).limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").limit(4 * sample)
    found = rows.select("doc_id", "y", _features("text").alias("x")).collect()  # numbers of a bounded sample
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    return Model(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found]))


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 if score >= threshold), in place of columns so named.

    Null text is scored as the empty text; ids play no part, and repeated rows are scored each. An empty table gives an empty result. If there was
    nothing to learn from, every score is the smoothed share of label 1.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(matrix(texts.tolist())), dtype=float)

    # nondeterministic: so that a filter on the result isn't pushed below it and doesn't run it twice
    return docs.withColumn("score", run.asNondeterministic()(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
