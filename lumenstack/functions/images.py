"""Pixels to image files: PNG encoding and box-filtered thumbnails (sinks of FN-28, FN-29, FN-47, CTX-18, CTX-20)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLOR_TYPES = {1: 0, 3: 2, 4: 6}


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of an 8-bit array (rows, columns, channels 1, 3 or 4)."""
    rows, columns, channels = pixels.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((rows, 1), np.uint8), pixels.astype(np.uint8).reshape(rows, -1)], axis=1)
    head = struct.pack(">IIBBBBB", columns, rows, 8, COLOR_TYPES[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of a PNG that encode_png wrote (8 bits, no filter, not interlaced)."""
    columns, rows, depth, color = struct.unpack_from(">IIBB", data, 16)
    channels = {v: k for k, v in COLOR_TYPES.items()}[color]
    at, body = 33, b""
    while data[at + 4 : at + 8] != b"IEND":
        (n,) = struct.unpack_from(">I", data, at)
        body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, 1 + columns * channels)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("filtered or not 8 bits")
    return lines[:, 1:].reshape(rows, columns, channels)


def box_filter(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area mean of the stored pixels under each pixel of a smaller grid, by fractional coverage; never enlarges."""
    h, w = pixels.shape[:2]
    rows, columns = min(rows, h), min(columns, w)

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        low, high = edges[:-1, None], edges[1:, None]
        i = np.arange(n)[None, :]
        cover = np.clip(np.minimum(high, i + 1) - np.maximum(low, i), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    out = np.einsum("ri,ijc,kj->rkc", weights(h, rows), pixels.astype(float), weights(w, columns))
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def png_images(frames: DataFrame, key: list[str], thumbnail: bool = False) -> DataFrame:
    """(key, png) of frames with `pixels` (flat array<int>), rows, columns, channels; thumbnails take width and height columns too."""
    cols = [*key, "pixels", "rows", "columns", "channels", *(["height", "width"] if thumbnail else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(cols[len(key) :]).to_pylist():
                x = np.array(r["pixels"], np.uint8).reshape(r["rows"], r["columns"], r["channels"])
                out.append(encode_png(box_filter(x, r["height"], r["width"]) if thumbnail else x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(out, pa.binary())], names=[*key, "png"])

    kinds = dict(frames.dtypes)
    return frames.select(*cols).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", png binary")
