"""PNG images as arrays and back, without an image library; boxes are painted over. Other formats need a plug-in that makes PNGs of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MARK = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MAX_PIXELS = 50_000_000


def _chunks(content: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], len(MARK)
    while at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        out.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise ValueError("truncated image")


def read_png(content: bytes) -> tuple[np.ndarray, list[str]]:
    """(rows, columns, channels) of 8-bit samples, palettes resolved, and warnings; metadata is left behind."""
    if not content.startswith(MARK):
        raise ValueError("not a PNG image")
    chunks = _chunks(content)
    head = dict(chunks).get(b"IHDR", b"").ljust(13, b"\0")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head[:13])
    if not width or not height or width * height > MAX_PIXELS:
        raise ValueError("image size")
    if depth != 8 or kind not in CHANNELS or interlaced:
        raise ValueError("image layout not supported")
    n = CHANNELS[kind]
    stride = width * n
    raw = zlib.decompressobj().decompress(b"".join(b for k, b in chunks if k == b"IDAT"), height * (stride + 1))
    if len(raw) != height * (stride + 1):
        raise ValueError("truncated image")
    lines, out = np.frombuffer(raw, np.uint8).reshape(height, stride + 1), np.zeros((height + 1, stride + n), np.uint8)
    for y in range(height):
        out[y + 1, n:] = _line(int(lines[y, 0]), lines[y, 1:], out[y], n)
    pixels = out[1:, n:].reshape(height, width, n)
    if kind == 3:
        palette = np.frombuffer(dict(chunks).get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if len(palette) <= int(pixels.max()):
            raise ValueError("damaged palette")
        pixels = palette[pixels[:, :, 0]]
    return pixels, ["MULTI_FRAME_IMAGE"] if any(k == b"acTL" for k, _ in chunks) else []


def _line(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line without its filter; above has n zeros in front."""
    up = above[n:].astype(np.int32)
    if kind == 0:
        return line
    if kind == 2:
        return (line + up).astype(np.uint8)
    if kind == 1:  # running sums of each channel
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.int64).astype(np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out, corner = np.zeros(len(line) + n, np.int32), above.astype(np.int32)
    for i in range(len(line)):
        left, top, diagonal = int(out[i]), int(up[i]), int(corner[i])
        if kind == 3:
            guess = (left + top) // 2
        else:
            guess = min((left, top, diagonal), key=lambda v: abs(left + top - diagonal - v))
        out[i + n] = (int(line[i]) + guess) & 255
    return out[n:].astype(np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    height, width, n = pixels.shape
    kind = {v: k for k, v in CHANNELS.items() if k != 3}[n]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    raw = np.zeros((height, width * n + 1), np.uint8)
    raw[:, 1:] = pixels.reshape(height, -1)
    return MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def painted(pixels: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Boxes (x, y, width, height) in black, whole pixels outwards; transparency is kept opaque there."""
    out = pixels.copy()
    colours = pixels.shape[2] - (pixels.shape[2] in (2, 4))
    for x, y, w, h in boxes:
        area = out[max(0, int(np.floor(y))) : max(0, int(np.ceil(y + h))), max(0, int(np.floor(x))) : max(0, int(np.ceil(x + w)))]
        area[:, :, :colours] = 0
        area[:, :, colours:] = 255
    return out
