"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file compiles to three machines: the normaliser (character map, white space, prefix), the pieces, and byte
fallback for characters that no piece has. Composed with an input they give a lattice whose states are (position, last
piece); encoding is its shortest path in the tropical semiring, which one function finds for all models.

What differs is the weight of an arc. A unigram model weighs a piece by its score. A BPE model merges by rank, which no
sum of piece scores yields; but a sequence of pieces is the BPE result exactly when each two neighbours are the BPE
result of their own concatenation. So there an arc weighs 0 between such neighbours and is otherwise absent. Sums are
those of doubles; the original adds single-precision numbers, so it may take another of two paths that are nearly equal.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MARK = "▁"
#: Words in each of the two tables of remembered paths in a process; a bound on memory that changes no result.
REMEMBERED = 450_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def character_map(data: bytes) -> dict[str, str]:
    """Input and output of each arc sequence of a compiled character map: a double array of 32-bit units, then strings."""
    size = int.from_bytes(data[:4], "little") if data else 0
    units, texts = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    labels, out = np.arange(1, 256), {}
    work = [(b"", int(offset(units[0])))] if len(units) else []
    while work:
        read, node = work.pop()
        at = node ^ labels
        at = at[at < len(units)]
        for k in at[(units[at] & 0x800000FF) == (at ^ node)].tolist():
            unit, key = int(units[k]), read + bytes([k ^ node])
            after = k ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[after]) & 0x7FFFFFFF
                out[key] = texts[start : texts.index(b"\0", start)]
            work.append((key, after))
    return {k.decode(): v.decode() for k, v in out.items()}


class Normaliser:
    """A functional transducer from text to text: at each place the longest known input is replaced, others stay."""

    def __init__(self, data: bytes, kept: list[str] = ()) -> None:
        known = character_map(data) | {k: k for k in kept}
        self.single = str.maketrans({k: v for k, v in known.items() if len(k) == 1})
        self.longer = {k: v for k, v in known.items() if len(k) > 1}
        by_first: dict[str, list[str]] = {}
        for k in [*sorted(kept, key=len, reverse=True), *sorted(set(self.longer) - set(kept), key=len, reverse=True)]:
            by_first.setdefault(k[0], []).append(re.escape(k[1:]))
        self.find = re.compile("|".join(f"{re.escape(c)}(?:{'|'.join(v)})" for c, v in by_first.items())) if self.longer else None

    def __call__(self, text: str) -> str:
        if self.find is None:
            return text.translate(self.single) if self.single else text
        out, at = [], 0
        for m in self.find.finditer(text):
            out += [text[at : m.start()].translate(self.single), self.longer.get(m.group(), m.group())]
            at = m.end()
        return "".join([*out, text[at:].translate(self.single)])


class Transducer:
    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe, self.prefix, self.squeeze = spec.model_type == 2, norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.suffix, self.mark = spec.treat_whitespace_as_suffix, MARK if norm.escape_whitespaces else " "
        own = [p.piece for p in model.pieces if p.type == USER]
        self.map, self.unmap = Normaliser(norm.precompiled_charsmap, own), Normaliser(model.denormalizer_spec.precompiled_charsmap)
        merging = (NORMAL, UNUSED) if self.bpe else (NORMAL, USER)
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in merging}
        self.names = [p.piece for p in model.pieces]
        self.unused = {i for i, p in enumerate(model.pieces) if p.type == UNUSED}
        self.size = len(self.names)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        # the pieces read from their ends: each suffix of a piece, with the piece that it is or -1
        self.endings = {p[k:]: -1 for p in self.pieces for k in range(len(p))} | {p: i for p, (i, _) in self.pieces.items()}
        scores = [p.score for p in model.pieces if p.type == NORMAL]
        low, high = min(scores, default=0.0), max(scores, default=0.0)
        # Weights of arcs: of falling back, and in a unigram model of pieces; the model's own are chosen wherever they fit.
        self.fall = 1.0 if self.bpe else 10 - low
        self.weights = [0.1 - len(p.piece.encode()) * high if p.type == USER else -p.score for p in model.pieces]
        text = {NORMAL: lambda p: p.piece.encode(), UNUSED: lambda p: p.piece.encode(), USER: lambda p: p.piece.encode(), BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), UNKNOWN: lambda p: spec.unk_surface.encode()}
        self.surfaces = [text.get(p.type, lambda p: b"")(p) for p in model.pieces]
        # Where no piece crosses from another character to a mark, paths part there; they always part at characters that no piece has.
        parts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        line = "\n" not in "".join(self.pieces)
        words = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if parts and line else f"{MARK}*[^{MARK}]+|{MARK}+" if parts else r"(?s).+"
        self.words = re.compile(words)
        # a BPE model never merges its user's pieces with what stands beside them
        self.own = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own and self.bpe else None
        self.ids = {p: i for i, p in enumerate(self.names)}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # ------------------------------------------------------------ machines
    def normalise(self, text: str) -> str:
        text = self.map(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = text.replace(" ", self.mark)
        if self.squeeze:
            text = text.rstrip(self.mark)
        mark = self.mark if self.prefix else ""
        return text + mark if self.suffix else mark + text

    def merged(self, s: str) -> tuple[list[str], tuple[str, str]]:
        """The BPE result of a short string, and its last merge: the best-ranked neighbours merge first, the leftmost of equals."""
        parts, last = list(s), ("", "")
        while len(parts) > 1:
            best = max(((self.pieces[x][1], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.pieces), default=None)
            if best is None:
                break
            i = -best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def merge(self, s: str) -> list[int]:
        return [self.pieces[p][0] if p in self.pieces else -1 for p in self.merged(s)[0]]

    def allowed(self, last: int, piece: int) -> bool:
        """Whether the BPE machine has an arc for ``piece`` from the state whose last piece is ``last`` (-1: none)."""
        key = (last + 1) * self.size + piece
        if (found := self.fits.get(key)) is None:
            own = self.names[piece]
            found = self.fits[key] = self.merge(own) == [piece] if last < 0 else self.merge(self.names[last] + own) == [last, piece]
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
        return found

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def used(self, piece: int) -> list[int]:
        """A piece, or for one that must not be used those that it was merged from."""
        if piece not in self.unused or not self.bpe:
            return [piece]
        halves = self.merged(self.names[piece])[1]
        return [i for h in halves if h for i in (self.used(self.pieces[h][0]) if h in self.pieces else self.fallback(h))] or self.fallback(self.names[piece])

    def shortest(self, word: str) -> list[int]:
        """The output of the path with the least sum of weights for one normalised word; of equals that with the longer
        last piece. Arcs end at each position in turn and are read backwards from it."""
        ending, fits, weights, size, n = self.endings.get, self.fits if self.bpe else None, self.weights, self.size, len(word)
        cost, last, begin = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            best, piece = float("inf"), ending(word[e - 1])
            if piece is None or piece < 0:
                best, begin[e] = cost[e - 1] + self.fall, e - 1  # falls back; no later arc depends on what came before
            b = e - 1
            while piece is not None:
                if piece >= 0:
                    if fits is None:
                        if (sum_ := cost[b] + weights[piece]) <= best:
                            best, last[e], begin[e] = sum_, piece, b
                    else:
                        if (fit := fits.get((last[b] + 1) * size + piece)) is None:
                            fit = self.allowed(last[b], piece)
                        if fit:  # weighs nothing, so no path to here is shorter
                            best, last[e], begin[e] = cost[b], piece, b
                            break
                if not b:
                    break
                b -= 1
                piece = ending(word[b:e])
            cost[e] = best
        out, e = [], n
        while e:
            out.append((last[e],) if last[e] >= 0 else self.fallback(word[e - 1]))
            e = begin[e]
        return [i for x in reversed(out) for i in x]

    def path(self, word: str) -> list[int]:
        ids = self.shortest(word)
        if self.bpe and self.unused:
            ids = [i for x in ids for i in self.used(x)]
        if not self.bytes:  # neighbouring unknown characters are one unknown piece
            ids = [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != self.unknown]
        return ids

    # ------------------------------------------------------------ use
    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        whole = self.normalise(text)
        if self.own is None:
            return self._coded(whole)
        return b"".join(pack("<I", self.ids[part]) if k % 2 else self._coded(part) for k, part in enumerate(self.own.split(whole)))

    def _coded(self, normal: str) -> bytes:
        out, known = [], self.known
        for word in self.words.findall(normal):
            if (ids := known.get(word)) is None:
                if (ids := self.older.get(word)) is None:
                    path = self.path(word)
                    ids = pack(f"<{len(path)}I", *path)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:  # words in use move on to the younger table, the others are forgotten with the older
                        self.older, self.known = known, {}
                        known = self.known
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.surfaces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(MARK, " ")
        if (self.prefix or self.squeeze) and not self.suffix and text.startswith(" "):
            text = text[1:]
        return self.unmap(text)


@cache
def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


CODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``df``: id, n_ids, ids_crc32, decoded_crc32, exact (the decoded text equals the text, a
    literal white-space mark counting as a space); with ``keep`` also ids (array) and decoded.

    ``model_path`` is a file that every executor has. Null and empty texts have no ids and decode to the empty text.
    Null and repeated ids stay as they are; an empty table gives an empty result. Other columns are not read.
    """
    small_batches(df.sparkSession)
    fields = [("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("decoded_crc32", T.LongType()), ("exact", T.BooleanType())]
    fields += [("ids", T.ArrayType(T.LongType())), ("decoded", T.StringType())] if keep else []

    @F.pandas_udf(T.StructType([T.StructField(*f) for f in fields]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                ids = model.encode(t)
                back = model.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == t.replace(MARK, " "), *((np.frombuffer(ids, "<u4").astype(np.int64), back) if keep else ())))
            yield pd.DataFrame(rows, columns=[f for f, _ in fields])

    return df.select(F.col(id_col).alias("_id"), run(F.col(text_col)).alias("_found")).select(F.col("_id").alias(id_col), "_found.*")
