"""What an image's bytes tell: type, size, and for PNG and BMP its pixels' spread, colours and perceptual hash."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SAMPLE, MOST_COLOURS, HASH_SIDE = 64, 256, 16


def kind_of(data: bytes) -> str | None:
    for magic, kind in ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff")):
        if data.startswith(magic):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return "emf" if data[40:44] == b" EMF" else None


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header."""
    try:
        kind = kind_of(data)
        if kind == "png":
            return struct.unpack(">II", data[16:24])
        if kind == "gif":
            return struct.unpack("<HH", data[6:10])
        if kind == "bmp":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if kind == "jpeg":
            at = 2
            while at < len(data) - 9:
                if data[at] != 0xFF:
                    at += 1
                    continue
                marker = data[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 if marker == 0xFF or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == "tiff":
            order = "<" if data[:2] == b"II" else ">"
            (at,) = struct.unpack(order + "I", data[4:8])
            (n,) = struct.unpack(order + "H", data[at : at + 2])
            found = {}
            for i in range(n):
                tag, form = struct.unpack(order + "HH", data[at + 2 + 12 * i : at + 6 + 12 * i])
                found[tag] = struct.unpack(order + ("H" if form == 3 else "I"), data[at + 10 + 12 * i : at + (12 if form == 3 else 14) + 12 * i])[0]
            return found[256], found[257]
        if kind == "webp":
            if data[12:16] == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return (bits & 16383) + 1, (bits >> 14 & 16383) + 1
            w, h = struct.unpack("<HH", data[26:30])
            return w & 16383, h & 16383
    except (struct.error, KeyError, IndexError):
        pass
    return None


def tiff_frames(data: bytes) -> list[bytes]:
    """A TIFF of each frame of a TIFF: the same bytes, of which the header points at that frame's directory and this at none after it. At most 65535 frames; one that is damaged ends them."""
    order = "<" if data[:2] == b"II" else ">"
    out: list[bytes] = []
    seen: set[int] = set()
    (at,) = struct.unpack(order + "I", data[4:8]) if len(data) > 7 else (0,)
    while at and at not in seen and at + 2 <= len(data) and len(out) < 65535:
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        end = at + 2 + 12 * n
        if end + 4 > len(data):
            break
        one = bytearray(data)
        one[4:8] = struct.pack(order + "I", at)
        one[end : end + 4] = b"\0" * 4
        out.append(bytes(one))
        (at,) = struct.unpack(order + "I", data[end : end + 4])
    return out


def png_of(scanlines: bytes, width: int, height: int, channels: int) -> bytes:
    """A PNG of 8-bit grey (1 channel) or RGB (3) pixels; scanlines: compressed, each behind its filter's number."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", scanlines) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray | None:
    """(height, width, 3) of a PNG with 8 bits a channel that isn't interlaced."""
    at, body, palette, header = 8, b"", None, None
    while at + 8 <= len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += part
        at += 12 + n
    if not header or header[2] != 8 or header[6]:
        return None
    w, h, kind = header[0], header[1], header[3]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w, channels), np.uint8)
    above = np.zeros((w, channels), np.int32)
    for y in range(h):
        line, f = raw[y, 1:].reshape(w, channels).astype(np.int32), raw[y, 0]
        if f == 1:
            line = np.cumsum(line, axis=0)
        elif f == 2:
            line = line + above
        elif f in (3, 4):
            left, corner = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for x in range(w):
                up = above[x]
                if f == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        above = line & 255
        out[y] = above
    if kind == 3:
        return palette[out[:, :, 0]]
    return out[:, :, :3] if channels > 2 else np.repeat(out[:, :, :1], 3, axis=2)


def bmp_pixels(data: bytes) -> np.ndarray | None:
    start, w, h = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26])
    (bits,) = struct.unpack("<H", data[28:30])
    if bits not in (24, 32):
        return None
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


def _nearest(x: np.ndarray, side: int) -> np.ndarray:
    h, w = x.shape[:2]
    return x[((np.arange(side) + 0.5) * h / side).astype(int)][:, ((np.arange(side) + 0.5) * w / side).astype(int)]


def perceptual_hash(pixels: np.ndarray) -> list[int]:
    """256 bits as four signed 64-bit words: which low cosine coefficients of the grey picture exceed their median."""
    side = HASH_SIDE * 4
    grey = pixels @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    ys, xs = (np.arange(side + 1) * h / side).astype(int), (np.arange(side + 1) * w / side).astype(int)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    y0, y1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1)
    x0, x1 = xs[:-1], np.maximum(xs[1:], xs[:-1] + 1)
    mean = (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / np.outer(y1 - y0, x1 - x0)
    k = np.cos(np.pi * (2 * np.arange(side) + 1)[None, :] * np.arange(HASH_SIDE)[:, None] / (2 * side))
    low = k @ mean @ k.T
    return np.packbits(low > np.median(low)).view(">i8").tolist()


def features(data: bytes) -> dict:
    """width, height, decoded, colour_range, colours, phash; the last three are NULL for types whose pixels aren't read here."""
    out = {"width": None, "height": None, "decoded": False, "colour_range": None, "colours": None, "phash": None}
    size = size_of(data)
    if not size:
        return out
    out |= {"width": int(size[0]), "height": int(size[1]), "decoded": True}
    try:
        pixels = {"png": png_pixels, "bmp": bmp_pixels}.get(kind_of(data), lambda _: None)(data)
    except (zlib.error, ValueError, KeyError, struct.error, TypeError):
        return out | {"decoded": False}
    if pixels is None or not pixels.size:
        return out
    sample = _nearest(pixels, SAMPLE).reshape(-1, 3)
    n = len(np.unique(sample, axis=0))
    return out | {"colour_range": int((sample.max(0).astype(int) - sample.min(0)).max()), "colours": n if n <= MOST_COLOURS else MOST_COLOURS + 1, "phash": perceptual_hash(pixels)}
