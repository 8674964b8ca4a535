"""Minimal PNG encoder (8-bit gray or RGB) used to materialize image files
from table rows inside Spark tasks."""
from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)


def encode_png(pixels: np.ndarray) -> bytes:
    """``pixels``: uint8 array (h, w) gray or (h, w, 3) RGB."""
    px = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = px.shape[:2]
    color = 0 if px.ndim == 2 else 2
    rows = px.reshape(h, -1)
    raw = b"".join(b"\x00" + rows[r].tobytes() for r in range(h))
    ihdr = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")
