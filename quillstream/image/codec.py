"""Images as bytes: PNG of eight bits a channel both ways, and binary PNM read."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type: gray, colour, gray with alpha, colour with alpha.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class ImageError(ValueError):
    """Bytes that are no image of a kind that is read here."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(image: np.ndarray) -> bytes:
    """A gray image (height x width) or one of three channels in blue, green, red order."""
    rows = image if image.ndim == 2 else image[..., ::-1]
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    # each row begins with the number of its filter, 0 for none
    body = np.pad(rows.reshape(len(rows), -1).astype(np.uint8), ((0, 0), (1, 0)))
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows that begin with a filter's number; step is the bytes of a pixel."""
    out = np.zeros((len(raw) + 1, raw.shape[1] - 1), np.uint8)
    for y, (kind, line) in enumerate(zip(raw[:, 0], raw[:, 1:]), 1):
        above = out[y - 1]
        if kind in (0, 2):
            out[y] = line + above if kind == 2 else line
        elif kind == 1:
            out[y] = line.reshape(-1, step).cumsum(0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            done, up = [0] * step + line.tolist(), [0] * step + above.tolist()
            for i in range(step, len(done)):
                a, b, c = done[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                done[i] = (done[i] + guess) & 255
            out[y] = done[step:]
        else:
            raise ImageError(f"unknown filter {kind}")
    return out[1:]


def read(data: bytes) -> np.ndarray:
    """The image in data: height x width, or with three channels in blue, green, red order. An alpha channel is dropped."""
    if data.startswith(PNG):
        at, head, body = len(PNG), None, []
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            elif kind == b"IDAT":
                body.append(data[at + 8 : at + 8 + size])
            at += size + 12
        if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
            raise ImageError("only PNGs of eight bits a channel, without palette and not interlaced, are read")
        width, height, channels = head[0], head[1], CHANNELS[head[3]]
        try:
            raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
        except (zlib.error, ValueError) as error:
            raise ImageError(f"a broken PNG: {error}") from error
        pixels = _unfiltered(raw, channels).reshape(height, width, channels)
    elif found := re.match(rb"(P[56])(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+255\s", data):
        width, height, channels = int(found[2]), int(found[3]), 1 if found[1] == b"P5" else 3
        body = data[found.end() : found.end() + width * height * channels]
        if len(body) < width * height * channels:
            raise ImageError("a PNM that is cut off")
        pixels = np.frombuffer(body, np.uint8).reshape(height, width, channels)
    else:
        raise ImageError("neither a PNG nor a binary PNM of eight bits")
    return pixels[..., 0] if pixels.shape[2] < 3 else pixels[..., 2::-1]
