"""Language identification of mixed text.

Script ranges narrow the candidate languages of each word to those that use its script; letter trigrams score the word
in these alone; Viterbi over the words, with a penalty for switching, labels spans. Everything is computed in numpy over
many texts at once: the Viterbi recursion steps through the words of all texts of a block in parallel. Executors count
the trigrams of the sample, so that the driver gets numbers and no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: By default the model is fitted on about so many documents of each language, and on at most so many languages.
SAMPLE, LANGUAGES = 1500, 200
BUCKETS = 1 << 17
#: Nats that a change of language costs, and the score of a word in a language that is no candidate for it.
SWITCH, BARRED = 12.0, -1e9
#: A language uses a script that holds this share of its letters.
SHARE = 0.02
#: Characters of texts that are scored at once, and that Viterbi goes through at once; they bound memory and change no result.
BLOCK, GROUP = 400_000, 4_000_000

# First code points of script ranges and the script's name. Letters before the first are Latin.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
]
NAMES = sorted({n for _, n in SCRIPTS})


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0: no letter), and its script."""
    low, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        if (x := chr(c)).isalpha():
            low[c] = ord(y) if len(y := x.lower()) == 1 else c
    low[0x30000:0x323B0] = np.arange(0x30000, 0x323B0)
    for (a, name), b in zip(SCRIPTS, [a for a, _ in SCRIPTS[1:]] + [0x110000]):
        script[a:b] = NAMES.index(name)
    return low, script


class Words:
    """The words (runs of letters) of a block of texts: text, first and last character, trigram buckets, script."""

    def __init__(self, texts: list[str]) -> None:
        low, script = _tables()
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([[0], low[points], [0]]).astype(np.uint64)
        is_letter = letters[1:-1] > 0
        mixed = letters[:-2] * np.uint64(0x9E3779B97F4A7C15) + letters[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + letters[2:] * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(is_letter)
        self.buckets = (mixed[at] >> np.uint64(64 - 17)).astype(np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.length = self.end - self.start
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]  # in buckets
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.script = script[points[self.start]] if len(self.start) else np.zeros(0, np.uint8)


def tally(texts: list[str]) -> np.ndarray:
    """How often texts have each trigram bucket, and after these their letters in each script."""
    counts = np.zeros(BUCKETS + len(NAMES))
    for block in blocks(texts):
        words = Words(block)
        counts[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
        counts[BUCKETS:] += np.bincount(words.script, words.length, minlength=len(NAMES))
    return counts


class Model:
    """Trigram log-probabilities and scripts of each language."""

    def __init__(self, langs: list[str], texts: list[list[str]] = (), counts: np.ndarray | None = None) -> None:
        """Fits on texts by language, or on their tallies (language by column)."""
        self.langs = langs
        if counts is None:
            counts = np.array([tally(t) for t in texts]).reshape(len(langs), -1).T if langs else np.zeros((BUCKETS + len(NAMES), 0))
        smoothed, scripts = counts[:BUCKETS] + 0.05, counts[BUCKETS:]
        self.logs = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
        uses = scripts >= SHARE * np.maximum(1, scripts.sum(axis=0))
        #: of each script, the languages that use it; all if none does
        self.candidates = [tuple(np.flatnonzero(u if u.any() else ~u).tolist()) for u in uses]
        self.narrow: dict[tuple[int, ...], np.ndarray] = {}

    def words(self, words: Words) -> np.ndarray:
        """Scores (word, language), for candidates only; a word with one candidate needs none."""
        out = np.full((len(words.start), len(self.langs)), BARRED, np.float32)
        for s in np.unique(words.script).tolist():
            own, among = words.script == s, self.candidates[s]
            if len(among) < 2:
                out[np.ix_(own, among)] = 0
                continue
            if (logs := self.narrow.get(among)) is None:
                logs = self.narrow[among] = self.logs if len(among) == len(self.langs) else np.ascontiguousarray(self.logs[:, among])
            if own.all():
                buckets, first = words.buckets, words.first
            else:
                buckets, first = words.buckets[np.repeat(own, words.length)], np.cumsum(words.length[own]) - words.length[own]
            out[np.ix_(own, among)] = np.add.reduceat(logs[buckets], first, axis=0)
        return out


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; words are in order and ``text`` tells whose they are."""
    n_words, k = scores.shape
    path = np.zeros(n_words, np.int64)
    if not n_words or k < 2:
        return path
    counts = np.bincount(text, minlength=n_texts)
    order = np.argsort(-counts, kind="stable")
    counts, starts = counts[order], (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")  # texts that have a word at step t
    stay, top_of = np.zeros((n_words, k), bool), np.zeros(n_words, np.int16)
    end = np.zeros(n_texts, np.int64)
    v = scores[starts[: active[0]]].astype(np.float64)
    for t in range(1, len(active)):
        n = active[t]
        if n < len(v):
            end[n : len(v)] = v[n:].argmax(axis=1)
            v = v[:n]
        at = starts[:n] + t
        top = v.argmax(axis=1)
        high = (v[np.arange(n), top] - switch)[:, None]
        keep = v >= high
        stay[at], top_of[at] = keep, top
        v = np.where(keep, v, high) + scores[at]
    end[: len(v)] = v.argmax(axis=1)
    state = end
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        now = state[:n]
        path[at] = now
        if t:
            state[:n] = np.where(stay[at, now], now, top_of[at])
    return path


def label(model: Model, texts: list[str], switch: float = SWITCH) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, the language of each (index), and the words' scores."""
    words = Words(texts)
    scores = model.words(words)
    return words, viterbi(scores, words.text, len(texts), switch), scores


def spans(model: Model, text: str, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """(start, end, language) of maximal stretches of one language, in code points."""
    words, path, _ = label(model, [text], switch)
    out: list[tuple[int, int, str]] = []
    for a, b, k in zip(words.start.tolist(), words.end.tolist(), path.tolist()):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, model.langs[k]))
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language with most letters in the labelled spans of each text, and its share of the letters."""
    langs, shares = np.full(len(texts), "und", object), np.zeros(len(texts))
    k, order = max(1, len(model.langs)), sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))  # long texts step together
    at = 0
    for group in blocks([texts[i] or "" for i in order], GROUP):
        scores, text, length, n = [], [], [], 0
        for block in blocks(group):
            words = Words(block)
            scores.append(model.words(words))
            text.append(words.text + n)
            length.append(words.length)
            n += len(block)
        text = np.concatenate(text)
        path = viterbi(np.concatenate(scores), text, n)
        held = np.bincount(text * k + path, np.concatenate(length), minlength=n * k).reshape(-1, k)
        total = held.sum(axis=1)
        top = held.argmax(axis=1)
        for i, letters in enumerate(total):
            if letters and model.langs:
                langs[order[at + i]], shares[order[at + i]] = model.langs[top[i]], held[i, top[i]] / letters
        at += n
    return langs.tolist(), shares


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: str = "true", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` documents of each language where ``learn``, a predicate on doc_id, holds: those whose hash
    of id falls under the language's share. Null texts and languages teach nothing; repeated rows count each.

    Languages are counted first; more than LANGUAGES are an error. Executors count trigrams, so that at most BUCKETS
    numbers a language reach the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.filter(learn).filter("lang is not null and text is not null")
    langs = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()}
    if len(langs) > LANGUAGES:
        raise ValueError(f"the model holds {LANGUAGES} languages, and {lang_col} has more values")
    at = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    chosen = F.lit(False)
    for x, n in langs.items():
        chosen = chosen | ((F.col("lang") == x) & (at < min(1 << 30, (sample << 30) // n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            own, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for x in dict.fromkeys(own.tolist()):
                held[x] = held.get(x, 0) + tally([texts[i] for i in np.flatnonzero(own == x)])
        for x, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.float64())], names=["lang", "bucket", "n"])

    names = sorted(langs)
    parts = known.filter(chosen).select("lang", "text").mapInArrow(count, "lang string, bucket long, n double")
    found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS + len(NAMES), len(names)))
    place = {x: k for k, x in enumerate(names)}
    counts[found["bucket"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return Model(names, counts=counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (share of letters in spans of that language), in place of columns so named.

    Null texts and texts without a letter: ``und`` and 0, as are all texts if nothing could be learned. Null and
    repeated ids stay as they are; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, shares = predict(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": shares})

    # nondeterministic: so that a filter on the result isn't pushed below it and doesn't run it twice
    found = docs.withColumn("__language", run.asNondeterministic()(F.col(text_col)))
    return found.withColumns({"lang_pred": F.col("__language.lang_pred"), "score": F.col("__language.score")}).drop("__language")


def held_out(id_col: str, parts: int, part: int):
    return (F.crc32(F.col(id_col).cast("string")) % parts) == part
