"""Pixels in numpy: blending, scaling of values, squares, grids, and PNG files. Batch functions for injected use."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed value: the colour beside an image that is pasted into a square.
BESIDE = (122, 116, 104)


def on_white(image: np.ndarray) -> np.ndarray:
    """RGB of an (h, w, 3 or 4) image, transparent pixels blended with white; fractions are cut off."""
    if image.shape[2] == 3 or (image[:, :, 3] == 255).all():
        return image[:, :, :3].astype(np.uint8)
    alpha = image[:, :, 3:].astype(np.float64) / 255
    return (255 * (1 - alpha) + alpha * image[:, :, :3]).astype(np.uint8)


def scaled(image: np.ndarray) -> np.ndarray:
    """Values from 0..255 to -1..1, channels first."""
    return np.moveaxis(image / 255.0 * 2 - 1, 2, 0).astype(np.float32)


def unscaled(values: np.ndarray) -> np.ndarray:
    """The inverse; values beyond the range are clamped, fractions cut off."""
    return ((np.moveaxis(np.clip(values, -1, 1), 0, 2) + 1) / 2 * 255).astype(np.uint8)


def square(image: np.ndarray, colour: Sequence[int] = BESIDE) -> np.ndarray:
    """The image in the middle of a square of its longer side."""
    h, w = image.shape[:2]
    side = max(h, w)
    out = np.empty((side, side, 3), np.uint8)
    out[:] = colour
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = image
    return out


def grid(images: Sequence[np.ndarray], columns: int) -> np.ndarray:
    """Equal images in rows of ``columns``; cells without one stay black."""
    h, w = images[0].shape[:2]
    out = np.zeros((-(-len(images) // columns) * h, columns * w, 3), np.uint8)
    for i, x in enumerate(images):
        top, left = i // columns * h, i % columns * w
        out[top : top + h, left : left + w] = x
    return out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(image: np.ndarray) -> bytes:
    """A PNG file of an (h, w, 3 or 4) image of bytes."""
    h, w, channels = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, w * channels)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The image of a PNG file of bytes with 3 or 4 channels, not interlaced; other files raise ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head, packed = (body if kind == b"IHDR" else head), [*packed, *([body] if kind == b"IDAT" else [])]
        at += n + 12
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (2, 6) or interlaced:
        raise ValueError("only plain 8-bit colour is read")
    step = {2: 3, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.zeros((h, w * step), np.int64), np.zeros(w * step, np.int64)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(w * step):
                left, corner = (int(line[x - step]), int(above[x - step])) if x >= step else (0, 0)
                up = int(above[x])
                nearest = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
                line[x] = (line[x] + {1: left, 3: (left + up) // 2, 4: nearest}[kind]) & 255
        above = out[y] = line & 255
    return out.reshape(h, w, step).astype(np.uint8)
