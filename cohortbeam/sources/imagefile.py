"""Image file contents to pixels, inside the task that scores them.

Workers need no image library. PNG: every bit depth, colour type and interlacing;
row filters are undone for whole diagonals at once. JPEG: baseline and
progressive Huffman files. What a file claims is checked against its bytes: the
signature, chunk checksums, the end mark, the size of the pixel data.
"""
from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np

from ..constants import MSG_FORMAT, MSG_UNREADABLE, SIGNATURES

MAX_PIXELS = 178_956_970  # larger files are refused before memory is taken

UNKNOWN, TRUNCATED, BROKEN = "cannot identify image file", "image file is truncated", "broken image file"


class ImageError(ValueError):
    """A file that is no readable PNG or JPEG; the text is the row's message."""


def unreadable(what: str) -> ImageError:
    return ImageError(MSG_UNREADABLE.format(what))


def image_format(data: bytes) -> str | None:
    """The format that the signature names, None for no known image."""
    head = bytes(data[:12])
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "WEBP"
    return next((name for name, mark in SIGNATURES if head.startswith(bytes.fromhex(mark))), None)


def decode_image(data: bytes | None) -> np.ndarray:
    """(height, width, 3) uint8, or ImageError."""
    data = bytes(data or b"")
    kind = image_format(data)
    if kind is None:
        raise unreadable(UNKNOWN)
    if kind not in ("PNG", "JPEG"):
        raise ImageError(MSG_FORMAT.format(kind))
    try:
        return _png(data) if kind == "PNG" else _Jpeg(data).rgb()
    except ImageError:
        raise
    except (IndexError, struct.error) as e:
        raise unreadable(TRUNCATED) from e
    except (ValueError, KeyError, TypeError, zlib.error, OverflowError) as e:
        raise unreadable(BROKEN) from e


def _checked_size(width: int, height: int) -> None:
    if not width or not height:
        raise unreadable(BROKEN)
    if width * height > MAX_PIXELS:
        raise unreadable(f"{width} x {height} pixels are too many")


# ------------------------------------------------------------------- PNG
#: Colour type -> samples a pixel (fixed by the format).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven interlace passes (fixed by the format).
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _unfiltered(rows: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of ``rows`` (height, bytes): a byte is predicted from
    those ``step`` bytes to the left (a), above (b) and above left (c)."""
    if filters.max(initial=0) > 4:
        raise unreadable(BROKEN)
    height, width = rows.shape
    if not filters.any():
        return rows
    columns = -(-width // step)
    x = np.zeros((height, columns * step), dtype=np.int32)
    x[:, :width] = rows
    x = x.reshape(height, columns, step)
    out = np.zeros((height + 1, columns + 1, step), dtype=np.int32)  # row 0 and column 0: outside
    kind = filters[:, None]
    for t in range(height + columns - 1):  # pixels of a diagonal depend on the two diagonals before only
        y = np.arange(max(0, t - columns + 1), min(height, t + 1))
        i = t - y
        a, b, c = out[y + 1, i], out[y, i + 1], out[y, i]
        p = a + b - c
        pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        f = kind[y]
        guess = np.where(f == 1, a, np.where(f == 2, b, np.where(f == 3, (a + b) >> 1, np.where(f == 4, paeth, 0))))
        out[y + 1, i + 1] = (x[y, i] + guess) & 255
    return out[1:, 1:].reshape(height, -1)[:, :width].astype(np.uint8)


def _samples(rows: np.ndarray, width: int, depth: int, n: int) -> np.ndarray:
    """(height, width, n) samples; 16-bit samples by their high byte."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return rows[:, :width * n].reshape(len(rows), width, n)


def _png(data: bytes) -> np.ndarray:
    at, pixels, palette, header, ended = 8, [], None, None, False
    while not ended:
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + size]
        if len(data) < at + 12 + size:
            raise unreadable(TRUNCATED)
        if kind[:1].isupper() and struct.unpack(">I", data[at + 8 + size:at + 12 + size])[0] != zlib.crc32(kind + body):
            raise unreadable(BROKEN)
        at += 12 + size
        if header is None and kind != b"IHDR":
            raise unreadable(BROKEN)
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            pixels.append(body)
        ended = kind == b"IEND"
    width, height, depth, color, _, _, interlaced = header
    _checked_size(width, height)
    n = SAMPLES[color]
    parts = PASSES if interlaced else [(0, 0, 1, 1)]
    shapes = [(-(-(height - y0) // dy), -(-(width - x0) // dx)) for x0, y0, dx, dy in parts]
    sizes = [h * (1 + (w * n * depth + 7) // 8) if w > 0 and h > 0 else 0 for h, w in shapes]
    raw = zlib.decompressobj().decompress(b"".join(pixels), sum(sizes))
    if len(raw) < sum(sizes):
        raise unreadable(TRUNCATED)
    out, at = np.zeros((height, width, n), dtype=np.uint8), 0
    for (x0, y0, dx, dy), (h, w), size in zip(parts, shapes, sizes):
        if size:
            rows = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(h, -1)
            plain = _unfiltered(rows[:, 1:], rows[:, 0], max(1, n * depth // 8))
            out[y0::dy, x0::dx] = _samples(plain, w, depth, n)
            at += size
    if color == 3:
        full = np.zeros((256, 3), dtype=np.uint8)
        full[:len(palette)] = palette
        return full[out[:, :, 0]]
    if depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    return out[:, :, :3] if n >= 3 else np.repeat(out[:, :, :1], 3, axis=2)


# ------------------------------------------------------------------ JPEG
#: Place of the k-th coefficient of a block: diagonals in turn, up and down.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_END = re.compile(rb"\xff+[^\xff\x00\xd0-\xd7]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


def _huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that follow: code length << 8 | symbol, 0 for no code."""
    table, at, used = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for length, count in enumerate(counts, 1):
        for s in symbols[used:used + count]:
            span = 1 << (16 - length)
            table[at:at + span] = length << 8 | s
            at += span
        used += count
    return table.tolist()


class _Bits:
    """The bits of one restart interval."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(8), dtype=np.uint8).astype(np.uint32)
        self.words = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
        self.at, self.end = 0, 8 * (len(raw) - 8)

    def symbol(self, table: list[int]) -> int:
        found = table[self.words[self.at >> 3] >> (16 - (self.at & 7)) & 0xFFFF]
        self.at += found >> 8
        if not found or self.at > self.end + 16:
            raise unreadable(TRUNCATED if self.at >= self.end - 16 else BROKEN)
        return found & 255

    def take(self, n: int) -> int:
        v = self.words[self.at >> 3] >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return v

    def number(self, n: int) -> int:
        """A value of n bits; those that begin with 0 are negative."""
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Jpeg:
    def __init__(self, data: bytes):
        self.quant, self.tables, self.parts, self.restart, self.adobe = {}, {}, [], 0, None
        self.progressive, at, scans = False, 2, 0
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise unreadable(TRUNCATED)
            mark = data[at + 1]
            if mark in (0x00, 0xFF) or 0xD0 <= mark <= 0xD8:
                at += 1
                continue
            if mark == 0xD9:
                break
            size = struct.unpack(">H", data[at + 2:at + 4])[0]
            body = data[at + 4:at + 2 + size]
            if len(data) < at + 2 + size:
                raise unreadable(TRUNCATED)
            at += 2 + size
            if mark in (0xC0, 0xC1, 0xC2):
                self._frame(body, mark == 0xC2)
            elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise unreadable("unsupported JPEG coding")
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _huffman(body[1:17], body[17:17 + n])
                    body = body[17 + n:]
            elif mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    values = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=1)
                    table = np.zeros(64)
                    table[ZIGZAG] = values
                    self.quant[body[0] & 15] = table
                    body = body[65 + 64 * bool(wide):]
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif mark == 0xDA:
                end = _END.search(data, at)
                if not end:
                    raise unreadable(TRUNCATED)
                self._scan(body, data[at:end.start()])
                at, scans = end.start(), scans + 1
        if not scans:
            raise unreadable(TRUNCATED)

    def _frame(self, body: bytes, progressive: bool) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if body[0] != 8 or self.parts:
            raise unreadable("unsupported JPEG coding")
        _checked_size(self.width, self.height)
        self.progressive = progressive
        fields = [body[6 + 3 * i:9 + 3 * i] for i in range(n)]
        self.h, self.v = max(f[1] >> 4 for f in fields), max(f[1] & 15 for f in fields)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for name, sampling, quant in fields:
            h, v = sampling >> 4, sampling & 15
            self.parts.append({"id": name, "h": h, "v": v, "q": quant, "stride": self.across * h,
                               "w": -(-(-(-self.width * h // self.h)) // 8), "rows": -(-(-(-self.height * v // self.v)) // 8),
                               "data": [0] * (64 * self.across * h * self.down * v)})

    def _scan(self, body: bytes, coded: bytes) -> None:
        n = body[0]
        chosen = []
        for i in range(n):
            part = {p["id"]: p for p in self.parts}[body[1 + 2 * i]]
            tables = body[2 + 2 * i]
            chosen.append((part, self.tables.get((0, tables >> 4)), self.tables.get((1, tables & 15))))
        lo, hi, shifts = body[1 + 2 * n:4 + 2 * n]
        high, low = shifts >> 4, shifts & 15
        if not self.progressive:
            block = self._baseline
        elif lo == 0:
            block = self._dc_more if high else self._dc_first
        else:
            block = self._ac_more if high else self._ac_first
        if n == 1:  # a part on its own: only the blocks that hold pixels
            part, dc, ac = chosen[0]
            units = [[(part, dc, ac, 64 * (y * part["stride"] + x))] for y in range(part["rows"]) for x in range(part["w"])]
        else:
            units = [[(p, dc, ac, 64 * ((my * p["v"] + y) * p["stride"] + mx * p["h"] + x))
                      for p, dc, ac in chosen for y in range(p["v"]) for x in range(p["h"])]
                     for my in range(self.down) for mx in range(self.across)]
        pieces = _RESTART.split(coded) if self.restart else [coded]
        step = self.restart or len(units)
        if len(pieces) < -(-len(units) // step):
            raise unreadable(TRUNCATED)
        for k in range(0, len(units), step):
            bits = _Bits(pieces[k // step])
            self.run = 0
            for p in self.parts:
                p["last"] = 0
            for unit in units[k:k + step]:
                for part, dc, ac, at in unit:
                    block(bits, part, dc, ac, at, lo, hi, high, low)
            if bits.at > bits.end + 16:
                raise unreadable(TRUNCATED)

    def _dc_first(self, bits, part, dc, ac, at, lo, hi, high, low) -> None:
        part["last"] += bits.number(bits.symbol(dc))
        part["data"][at] = part["last"] << low

    def _dc_more(self, bits, part, dc, ac, at, lo, hi, high, low) -> None:
        part["data"][at] |= bits.take(1) << low

    def _baseline(self, bits, part, dc, ac, at, lo, hi, high, low) -> None:
        self._dc_first(bits, part, dc, ac, at, 0, 63, 0, 0)
        data, k = part["data"], 1
        while k < 64:
            s = bits.symbol(ac)
            if s & 15:
                k += s >> 4
                data[at + ZIGZAG[k]] = bits.number(s & 15)
            elif s != 0xF0:
                break
            else:
                k += 15
            k += 1

    def _ac_first(self, bits, part, dc, ac, at, lo, hi, high, low) -> None:
        if self.run:
            self.run -= 1
            return
        data, k = part["data"], lo
        while k <= hi:
            s = bits.symbol(ac)
            if s & 15:
                k += s >> 4
                data[at + ZIGZAG[k]] = bits.number(s & 15) * (1 << low)
            elif s != 0xF0:
                self.run = (1 << (s >> 4)) - 1 + (bits.take(s >> 4) if s >> 4 else 0)
                break
            else:
                k += 15
            k += 1

    def _ac_more(self, bits, part, dc, ac, at, lo, hi, high, low) -> None:
        data, k, one = part["data"], lo, 1 << low

        def correct(i: int) -> None:
            if bits.take(1) and not abs(data[i]) & one:
                data[i] += one if data[i] > 0 else -one

        if not self.run:
            while k <= hi:
                s = bits.symbol(ac)
                skip, value = s >> 4, 0
                if s & 15:
                    value = one if bits.take(1) else -one
                elif skip < 15:
                    self.run = (1 << skip) + (bits.take(skip) if skip else 0)
                    break
                while k <= hi:  # old coefficients are corrected on the way to the new one's place
                    i = at + ZIGZAG[k]
                    if data[i]:
                        correct(i)
                    elif skip:
                        skip -= 1
                    else:
                        data[i] = value
                        break
                    k += 1
                k += 1
        if self.run:
            for k in range(k, hi + 1):
                if data[at + ZIGZAG[k]]:
                    correct(at + ZIGZAG[k])
            self.run -= 1

    def _plane(self, part: dict) -> np.ndarray:
        """Samples of one part, scaled up to the image's size."""
        c = _cosines()
        rows = len(part["data"]) // 64 // part["stride"]
        blocks = (np.array(part["data"], dtype=np.float64).reshape(-1, 64) * self.quant[part["q"]]).reshape(-1, 8, 8)
        x = np.clip(np.round(c.T @ blocks @ c + 128), 0, 255)
        x = x.reshape(rows, part["stride"], 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, -1)
        x = x[:-(-self.height * part["v"] // self.v), :-(-self.width * part["h"] // self.h)]
        for axis, times in ((0, self.v // part["v"]), (1, self.h // part["h"])):
            x = _doubled(x, axis) if times == 2 else np.repeat(x, times, axis=axis)
        return x[:self.height, :self.width]

    def rgb(self) -> np.ndarray:
        planes = [self._plane(p) for p in self.parts]
        if len(planes) == 1:
            return np.repeat(np.round(planes[0]).astype(np.uint8)[:, :, None], 3, axis=2)
        if len(planes) not in (3, 4):
            raise unreadable("unsupported JPEG coding")
        named_rgb = [p["id"] for p in self.parts[:3]] == list(b"RGB")
        if self.adobe != 0 and not named_rgb and not (len(planes) == 4 and self.adobe is None):
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes[:3] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
        if len(planes) == 4:  # four inks, stored inverted where the Adobe mark stands
            ink = [p if self.adobe is not None else 255 - p for p in planes]
            planes = [p * ink[3] / 255 for p in ink[:3]]
        return np.clip(np.round(np.stack(planes[:3], axis=2)), 0, 255).astype(np.uint8)


def _doubled(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice the samples along an axis, three parts of the near one and one of the next."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.stack([3 * x + before, 3 * x + after], axis=1).reshape(-1, *x.shape[1:]) / 4
    return np.moveaxis(out, 0, axis)
