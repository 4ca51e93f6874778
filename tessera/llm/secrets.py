"""Secret scans with a recursive decoding worklist.

Each text is a first layer. A layer is scanned, then unwrapped: percent codes, Unicode escapes, character references
and text in two bytes a character are decoded in place (so a keyword and an encoded value still stand together), base64 runs and compressed data in them give layers
of their own. Layers are unwrapped until none is new; a layer seen before is not entered again, so cycles end.
Every character of a layer knows the span of the text it came from, and findings are reported there.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# Fixed patterns: letters of keywords in either case (ASCII), lengths are checked after matching.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]{1,8}\})|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
ONE_ESCAPE = re.compile(r"\\[uxU]\{?([0-9A-Fa-f]+)\}?|&#(?:([0-9]+)|[xX]([0-9A-Fa-f]+));")
#: Text in two bytes a character, in a layer in which a byte is a character.
WIDE = re.compile(r"(?:[\x01-\xff]\0){6,}|(?:\0[\x01-\xff]){6,}")
#: A run may be wrapped: lines that end and begin with its characters are one run.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+|[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++)={0,2}")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: base64 characters of the shortest finding, token=abcdef.
LEAST = 16
#: What a decoded layer needs for a finding or a further layer; bytes that are no text have it by chance only.
WORTH = re.compile(r"[A-Za-z0-9+/_.=-]{6}|(?:[!-~]\0){6}|&#|[A-Za-z0-9+/_-][ \t]*\r?\n|%[0-9A-Fa-f]{2}|\\[uxU]")
#: Where compressed data may begin; a frame that zstd skips may stand before it.
SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18", re.S)
ZLIB = [bytes((a, b)) for a in range(0x08, 0x88, 16) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 32]
MAGIC = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18|\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd|" + b"|".join(map(re.escape, ZLIB)), re.S)
#: Bytes that a compressed blob may expand to at once; a larger one is scanned as a stream.
EXPANDED = 64 << 20
#: Bytes taken in and given out at once; a zstd block of 4 bytes may hold 128 KiB.
STEP, ZSTD_STEP, UNPACKED = 1 << 16, 1 << 8, 1 << 20
#: Characters of a piece of a stream, and where one may end: no finding, code or base64 run goes over these.
PIECE = 4 << 20
APART = re.compile(r"[^A-Za-z0-9+/_.=:%\\'\"\x20\t\r\n{}&#;\0-]|(?<=\0)\0|(?<=[g-zG-Z])\x20(?=[A-Za-z0-9])")


def base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain findings, leftmost and non-overlapping per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


class Map:
    """Spans in the text of each character of a layer; None: the layer is the text."""

    def __init__(self, starts=None, ends=None) -> None:
        self.starts, self.ends = starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a:b].min()), int(self.ends[a:b].max()))

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(a, b), np.arange(a + 1, b + 1)) if self.starts is None else (self.starts[a:b], self.ends[a:b])


def _in_place(text: str, where: Map, pattern: re.Pattern, decode) -> tuple[str, Map] | None:
    """The layer with each match decoded; decode(match) gives characters with their spans in the match, or None."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        if not (found := decode(m.group())):
            continue
        a, b = where.of(at, m.start())
        s, e = zip(*(where.span(m.start() + x, m.start() + y) for _, x, y in found))
        parts += [text[at : m.start()], "".join(c for c, _, _ in found)]
        starts += [a, np.array(s)]
        ends += [b, np.array(e)]
        at = m.end()
    if not parts:
        return None
    a, b = where.of(at, len(text))
    return "".join([*parts, text[at:]]), Map(np.concatenate([*starts, a]), np.concatenate([*ends, b]))


def _percent(code: str) -> list[tuple[str, int, int]] | None:
    """The characters of a run of percent codes; bytes that aren't UTF-8 stay as their codes."""
    out, at = [], 0
    for c in bytes.fromhex(code.replace("%", "")).decode("utf-8", "surrogateescape"):
        stays = "\udc80" <= c <= "\udcff"
        n = 3 if stays else 3 * len(c.encode())
        out += [(x, i, i + 1) for i, x in enumerate(code[at : at + n], at)] if stays else [(c, at, at + n)]
        at += n
    return out if any(b - a > 1 for _, a, b in out) else None


def _escape(code: str) -> list[tuple[str, int, int]] | None:
    out, pending = [], None
    for m in ONE_ESCAPE.finditer(code):
        v = int(m[2]) if m[2] else int(m[1] or m[3], 16)
        if 0xD800 <= v < 0xDC00:
            pending = (v, m.start())
            continue
        if 0xDC00 <= v < 0xE000:
            if pending is None:
                continue
            v, start = 0x10000 + ((pending[0] - 0xD800) << 10) + v - 0xDC00, pending[1]
        else:
            start = m.start()
        pending = None
        if v < 0x110000:
            out.append((chr(v), start, m.end()))
    return out or None


def _narrow(code: str) -> list[tuple[str, int, int]]:
    """The characters of text in two bytes a character, in either order."""
    k = int(code[0] == "\0")
    return [(code[i + k], i, i + 2) for i in range(0, len(code), 2)]


class _Input:
    """The bytes of an iterator of pieces. ``rest`` was taken from it and isn't used yet; ``used`` bytes are. Members
    stand in the first ``end`` bytes, and those of them that are whole in the first ``closed``."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest, self.used, self.end, self.closed = pieces, b"", 0, 0, 0

    def fill(self, n: int) -> bool:
        while len(self.rest) < n and (piece := next(self.pieces, None)) is not None:
            self.rest += piece
        return len(self.rest) >= n

    def take(self, n: int) -> bytes:
        piece, self.rest = self.rest[:n], self.rest[n:]
        self.used += len(piece)
        return piece

    def give_back(self, piece: bytes) -> None:
        self.rest = piece + self.rest
        self.used -= len(piece)


def _coder(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[:2] in ZLIB:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _member(coder, data: _Input) -> Iterator[bytes]:
    """What one member unpacks to, in pieces of bounded size; at a fault or the end of the data it ends."""
    zstd, full = isinstance(coder, type(zstandard.ZstdDecompressor().decompressobj())), False
    try:
        while not coder.eof:
            if not getattr(coder, "needs_input", True):
                piece = b""
            elif data.fill(1):
                piece = data.take(ZSTD_STEP if zstd else STEP)
            elif full:
                piece = b""
            else:
                return
            out = coder.decompress(piece) if zstd else coder.decompress(piece, UNPACKED)
            data.give_back(coder.unused_data if coder.eof else getattr(coder, "unconsumed_tail", b""))
            full = len(out) >= UNPACKED
            if out:
                yield out
            elif not piece and not coder.eof:
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


def _unpacked(data: _Input) -> Iterator[bytes]:
    """What all members of ``data`` unpack to, one after another; nothing if it isn't compressed."""
    while data.fill(6) or data.rest:
        if SKIPPED.match(data.rest) and data.fill(8):
            left = 8 + int.from_bytes(data.rest[4:8], "little")
            while left and data.fill(1):
                left -= len(data.take(left))
            data.end = data.used
            continue
        if (coder := _coder(data.rest)) is None:
            return
        yield from _member(coder, data)
        data.end = data.used
        if not coder.eof:
            return
        data.closed = data.used
        while data.fill(1) and not data.rest[0]:  # padding
            data.take(len(data.rest) - len(data.rest.lstrip(b"\0")))


def _pieces(data) -> Iterator[bytes]:
    return (bytes(data[i : i + STEP]) for i in range(0, len(data), STEP))


def _packed_size(data) -> tuple[int, int]:
    """The numbers of bytes that the members of ``data`` and its whole members stand in."""
    source = _Input(_pieces(data))
    for _ in _unpacked(source):
        pass
    return source.end, source.closed


class Unpacked(bytes):
    """Unpacked data, and the numbers of bytes that its members and its whole members stood in."""

    size = (0, 0)


def expand(data) -> bytes | None:
    """What all members of ``data`` are the compressed form of; None if it isn't compressed. OverflowError: it is over EXPANDED."""
    source, out, size = _Input(_pieces(data)), [], 0
    for piece in _unpacked(source):
        out.append(piece)
        if (size := size + len(piece)) > EXPANDED:
            raise OverflowError
    if not out:
        return None
    made = Unpacked(b"".join(out))
    made.size = source.end, source.closed
    return made


def _streamed(data) -> Iterator[str]:
    """What ``data`` unpacks to, then what that unpacks to and so on, in overlapping pieces: what a finding or a layer
    in them begins with lies in the same piece as its end. Only a stretch without a place to cut makes a long piece."""
    for depth in count(1):
        source, text, most = _pieces(data), "", PIECE
        for _ in range(depth):
            source = _unpacked(_Input(source))
        empty = True
        for piece in source:
            empty = False
            text += piece.decode("latin-1")
            if len(text) >= most:
                cut = 0
                for back in (1 << 12, len(text)):
                    for m in APART.finditer(text, max(0, len(text) - back)):
                        cut = m.end()
                    if cut:
                        yield text
                        break
                text = text[cut:]
                most = PIECE + 2 * len(text)
        if empty:
            return
        yield text


def _layer(data: bytes, a: np.ndarray, b: np.ndarray, where: Map) -> tuple[str, Map]:
    """``data``, whose bytes came from [a, b) of the layer that ``where`` maps; a byte is a character, text or not."""
    return data.decode("latin-1"), Map(a, b) if where.starts is None else Map(where.starts[a], where.ends[b - 1])


def _blobs(text: str, where: Map) -> Iterator[tuple[str, Map]]:
    """The layers in base64 runs. A run may begin or end with characters that aren't of the code, so it is decoded from
    each of its first four characters, and compressed data may begin at any byte."""
    for m in BASE64.finditer(text):
        code = np.frombuffer(m.group().rstrip("=").encode(), np.uint8)
        at = np.flatnonzero(code > 32)
        code, at = code[at].tobytes().translate(URL_SAFE), at + m.start()
        for k in range(4):
            n = len(code) - k - ((len(code) - k) % 4 == 1)
            if n < LEAST:
                continue
            data = base64.b64decode(code[k : k + n] + b"=" * (-n % 4))
            if WORTH.search(data.decode("latin-1")):
                i = np.arange(len(data) + 1) * 8
                yield _layer(data, at[k + i[:-1] // 6], at[k - (-i[1:] // 6) - 1] + 1, where)
            whole, done = memoryview(data), 0
            for g in MAGIC.finditer(data):
                if g.start() < done:
                    continue
                packed, seen, size = whole[g.start() :], set(), None
                try:
                    while (inner := expand(packed)) is not None and (key := hashlib.sha256(inner).digest()) not in seen:
                        seen.add(key)
                        size = size or getattr(inner, "size", (len(packed), 0))
                        packed = inner
                    if not seen:
                        continue
                    layers = [str(packed, "latin-1")]
                except OverflowError:
                    size = size or _packed_size(packed)
                    layers = _streamed(packed)
                end, done = g.start() + size[0], g.start() + size[1]
                stop = m.end() if end >= len(data) else int(at[k - (-end * 8 // 6) - 1]) + 1
                span = where.span(int(at[k + g.start() * 8 // 6]), stop)
                for layer in layers:
                    yield layer, Map(*(np.broadcast_to(np.int64(x), len(layer)) for x in span))  # one number each, however long the layer


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(plain findings, all findings) as sorted (start, kind, end); spans count code points, ends are exclusive."""
    text = text or ""
    order = lambda x: (x[0], KINDS.index(x[1]), x[2])
    plain = sorted(base(text), key=order)
    found, seen, work = set(plain), set(), [iter([(text, Map())])]
    while work:
        layer, where = next(work[-1], (None, None))
        if not layer:
            if layer is None:
                work.pop()
            continue
        if where.starts is not None:
            key = hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest()
            if key + bytes(str(where.span(0, len(layer))), "ascii") in seen:
                continue
            seen.add(key + bytes(str(where.span(0, len(layer))), "ascii"))
            for a, kind, b in base(layer):
                s, e = where.span(a, b)
                found.add((s, kind, e))
        if "%" in layer and (got := _in_place(layer, where, PERCENT, _percent)):
            work.append(iter([got]))
        if ("\\" in layer or "&#" in layer) and (got := _in_place(layer, where, ESCAPE, _escape)):
            work.append(iter([got]))
        if "\0" in layer and (got := _in_place(layer, where, WIDE, _narrow)):
            work.append(iter([got]))
        work.append(_blobs(layer, where))
    return plain, sorted(found, key=order)


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


FOUND = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.pandas_udf(FOUND)
def _scans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            plain, every = scan(t)
            counts = [sum(k == kind for _, k, _ in plain) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(_join(plain).encode()).hexdigest(), _join(every)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty and has no findings. Ids may be null or repeat. An empty table gives an empty
    result. Other columns are not read.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("_id"), _scans(F.col(text_col)).alias("_found")).select(F.col("_id").alias(id_col), "_found.*")


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each stretch that findings cover replaced by ``mark``."""
    if text is None:
        return None
    out, at, covered = [], 0, 0
    for a, _, b in scan(text)[1]:
        if a >= covered:
            out += [text[at:a], mark]
        at = covered = max(covered, b)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([redact(t) for t in texts], dtype=object)


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of its text column masked; all rows, repeated ones too, and other columns stay. Null text
    stays null; an empty table gives an empty result."""
    small_batches(df.sparkSession)
    return df.withColumn(text_col, _redacted(F.col(text_col)))
