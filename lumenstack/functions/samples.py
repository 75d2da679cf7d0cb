"""Stored frames to sample arrays, and their digests (FN-33, FN-39 to FN-45, FN-50, FN-78, AGG-12, AGG-26).

Byte-level work that no built-in expression covers: numpy inside Arrow functions. `decode_frames` is the
DataFrame form; the others are its parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RLE_HEADER, RLE_SEGMENTS = 64, 15


class Undecodable(ValueError):
    pass


def sample_type(bits: int, signed: bool, kind: str = "integer", big: bool = False) -> np.dtype:
    order = ">" if big else "<"
    if kind == "float32" and bits == 32:
        return np.dtype(order + "f4")
    if kind == "float64" and bits == 64:
        return np.dtype(order + "f8")
    if kind != "integer" or bits not in (1, 8, 16, 32) or (bits == 1 and signed):
        raise Undecodable(f"unsupported samples: {kind}, {bits} bits, signed {signed}")
    return np.dtype(order + ("i" if signed else "u") + str(max(1, bits // 8)))


def numeric_samples(data: bytes, bits: int, signed: bool, kind: str = "integer", big: bool = False) -> np.ndarray:
    """All whole samples of a frame as doubles; 1-bit frames come unpacked, one byte a sample."""
    t = sample_type(bits, signed, kind, big)
    return np.frombuffer(data, t, len(data) // t.itemsize).astype(float)


def unpack_bits(data: bytes, frame: int, count: int) -> np.ndarray:
    """One frame of a 1-bit value, lowest bit first; frames follow each other without padding."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    own = bits[frame * count : (frame + 1) * count]
    if len(own) != count:
        raise Undecodable("frame beyond the end")
    return own


def stored_field(x: np.ndarray, bits_stored: int, high_bit: int, signed: bool) -> np.ndarray:
    """Integer samples reduced to their stored bits, shifted down and sign-extended."""
    v = (x.astype(np.int64) >> (high_bit + 1 - bits_stored)) & ((1 << bits_stored) - 1)
    return np.where(v >> (bits_stored - 1) & 1, v - (1 << bits_stored), v) if signed else v


def interleaved(data: bytes, pixels: int, channels: int, width: int, planar: int) -> bytes:
    if len(data) != pixels * channels * width:
        raise Undecodable("wrong length")
    if planar == 0:
        return data
    return np.frombuffer(data, np.uint8).reshape(channels, pixels, width).transpose(1, 0, 2).tobytes()


def expand_422(data: bytes, rows: int, columns: int) -> bytes:
    """Pairs (y1, y2, cb, cr) to two full pixels; an odd column count can't be."""
    if columns % 2 or len(data) != rows * columns * 2:
        raise Undecodable("not a 4:2:2 frame")
    q = np.frombuffer(data, np.uint8).reshape(-1, 4)
    return q[:, [0, 2, 3, 1, 2, 3]].tobytes()


def swap_pairs(data: bytes) -> bytes:
    """The bytes of every 16-bit word exchanged; an odd last byte stays."""
    even = len(data) & ~1
    return np.frombuffer(data[:even], np.uint8).reshape(-1, 2)[:, ::-1].tobytes() + data[even:]


def packbits(data: bytes, expected: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < expected and at < len(data):
        control = data[at]
        at += 1
        if control < 128:
            if at + control + 1 > len(data):
                raise Undecodable("truncated literal run")
            out += data[at : at + control + 1]
            at += control + 1
        elif control > 128:
            if at >= len(data):
                raise Undecodable("truncated repeat run")
            out += data[at : at + 1] * (257 - control)
            at += 1
    if len(out) != expected:
        raise Undecodable("wrong run length")
    return bytes(out)


def rle_frame(data: bytes, rows: int, columns: int, samples: int, bits: int) -> bytes:
    """One RLE fragment to interleaved little-endian samples; segments hold byte planes, highest first."""
    if len(data) < RLE_HEADER or bits not in (8, 16) or not rows * columns * samples:
        raise Undecodable("invalid layout")
    width, pixels = bits // 8, rows * columns
    n, *offsets = struct.unpack_from("<16I", data)
    if n != samples * width or n > RLE_SEGMENTS or any(offsets[n:]) or offsets[0] != RLE_HEADER:
        raise Undecodable("invalid segments")
    ends = [*offsets[1:n], len(data)]
    if any(a >= b for a, b in zip(offsets[:n], ends)):
        raise Undecodable("segments out of order")
    planes = [np.frombuffer(packbits(data[a:b], pixels), np.uint8) for a, b in zip(offsets[:n], ends)]
    out = np.stack([planes[s * width + width - 1 - k] for s in range(samples) for k in range(width)], axis=1)
    return out.tobytes()


def deflated_frame(data: bytes, pixels: int) -> np.ndarray:
    """A deflated 1-bit frame: raw deflate, lowest bit first, no more than the frame needs."""
    inflate = zlib.decompressobj(-15)
    raw = inflate.decompress(data, (pixels + 7) // 8 + 1)
    return unpack_bits(raw, 0, pixels)


# BLAKE3, from its published specification.

#: Initial state words and the message permutation of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK = 1024


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Compression of many blocks at once: cv (n, 8), block (n, 16); gives (n, 8)."""
    v = np.empty((16, len(cv)), np.uint32)
    v[:8] = cv.T
    v[8:12] = np.array(IV[:4], np.uint32)[:, None]
    v[12], v[13], v[14], v[15] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    m = block.T.copy()

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x >> np.uint32(n)) | (x << np.uint32(32 - n))

    def mix(a: list, b: list, c: list, d: list, x: np.ndarray, y: np.ndarray) -> None:
        v[a] = v[a] + v[b] + x
        v[d] = turn(v[d] ^ v[a], 16)
        v[c] = v[c] + v[d]
        v[b] = turn(v[b] ^ v[c], 12)
        v[a] = v[a] + v[b] + y
        v[d] = turn(v[d] ^ v[a], 8)
        v[c] = v[c] + v[d]
        v[b] = turn(v[b] ^ v[c], 7)

    for _ in range(7):
        mix([0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15], m[0:8:2], m[1:8:2])
        mix([0, 1, 2, 3], [5, 6, 7, 4], [10, 11, 8, 9], [15, 12, 13, 14], m[8:16:2], m[9:16:2])
        m = m[PERMUTATION]
    return (v[:8] ^ v[8:]).T


def blake3(data: bytes) -> str:
    """Hex digest (32 bytes). All chunks of a level are compressed together."""
    n = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").reshape(n, 16, 16)
    sizes = np.full(n, CHUNK)
    sizes[-1] = len(data) - (n - 1) * CHUNK
    blocks = np.maximum(1, -(-sizes // 64))
    cv = np.tile(np.array(IV, np.uint32), (n, 1))
    for b in range(16):
        live = np.flatnonzero(blocks > b)
        if not len(live):
            break
        last = blocks[live] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * last + ROOT * (last & (n == 1))
        size = np.minimum(64, sizes[live] - b * 64)
        cv[live] = _compress(cv[live], words[live, b], live.astype(np.uint64), size.astype(np.uint32), flags.astype(np.uint32))
    while n > 1:
        # complete pairs meet; an odd last node goes up as it is, which gives the left-full tree
        pairs = n // 2
        both = np.concatenate([cv[0 : 2 * pairs : 2], cv[1 : 2 * pairs : 2]], axis=1)
        flags = np.full(pairs, PARENT + ROOT * (n == 2), np.uint32)
        up = _compress(np.tile(np.array(IV, np.uint32), (pairs, 1)), both, np.zeros(pairs, np.uint64), np.full(pairs, 64, np.uint32), flags)
        cv = np.concatenate([up, cv[2 * pairs :]])
        n = len(cv)
    return cv[0].astype("<u4").tobytes().hex()


def pixel_digest(rows: int, columns: int, samples: int, bits: int, form: int, data: bytes) -> str | None:
    """Digest of a 24-byte layout header and interleaved little-endian samples; None if they don't fit together.

    The header is six little-endian words: rows, columns, samples a pixel, bits a sample (8, 16, 32 or 64), the
    samples' form (0 unsigned, 1 signed, 2 floating point) and 0, for interleaved.
    """
    size = rows * columns * samples * (bits // 8)
    if bits not in (8, 16, 32, 64) or not size or len(data) != size:
        return None
    return blake3(struct.pack("<6I", rows, columns, samples, bits, form, 0) + data)


def file_digests(files: DataFrame) -> DataFrame:
    """(path, length, b3, s2) of files read as binary: BLAKE3 in an Arrow function, SHA-256 built in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([blake3(c.as_py()) for c in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, batch.column(3)], names=["path", "length", "b3", "s2"])

    return files.select("path", "length", "content", F.sha2("content", 256).alias("s2")).mapInArrow(run, "path string, length bigint, b3 string, s2 string")


def decode_frames(frames: DataFrame) -> DataFrame:
    """(file_index, frame_index, samples, error) from stored frames.

    frames: file_index, frame_index, data, encoding (native, rle, deflated), rows, columns, samples, bits,
    bits_stored, high_bit, signed, kind, planar, big_endian, photometric.
    """

    def one(r: dict) -> np.ndarray:
        data, pixels, width = r["data"], r["rows"] * r["columns"], max(1, r["bits"] // 8)
        if r["encoding"] == "deflated":
            return deflated_frame(data, pixels).astype(float)
        if r["encoding"] == "rle":
            data = rle_frame(data, r["rows"], r["columns"], r["samples"], r["bits"])
        elif r["bits"] == 1:
            return unpack_bits(data, 0, pixels).astype(float)
        elif r["photometric"] == "YBR_FULL_422":
            data = expand_422(data, r["rows"], r["columns"])
        else:
            data = interleaved(data, pixels, r["samples"], width, r["planar"] or 0)
        x = numeric_samples(data, r["bits"], r["signed"], r["kind"] or "integer", bool(r["big_endian"]) and r["encoding"] == "native")
        if (r["kind"] or "integer") == "integer" and r["bits_stored"] and r["bits_stored"] < r["bits"]:
            x = stored_field(x, r["bits_stored"], r["high_bit"], r["signed"]).astype(float)
        return x

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for r in batch.to_pylist():
                try:
                    values.append(one(r))
                    errors.append(None)
                except (Undecodable, struct.error, zlib.error) as e:
                    values.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("file_index"), batch.column("frame_index"), pa.array(values, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["file_index", "frame_index", "samples", "error"])

    kinds = dict(frames.dtypes)
    return frames.mapInArrow(run, f"file_index {kinds['file_index']}, frame_index {kinds['frame_index']}, samples array<double>, error string")


def long_form(frames: DataFrame, columns: str = "columns") -> DataFrame:
    """One row a sample: file_index, frame_index, row, column, value."""
    flat = frames.select("file_index", "frame_index", F.col(columns).alias("_c"), F.posexplode("samples").alias("_i", "value"))
    return flat.select("file_index", "frame_index", F.floor(F.col("_i") / F.col("_c")).cast("int").alias("row"), (F.col("_i") % F.col("_c")).cast("int").alias("column"), "value")


def pixel_probe(frames: DataFrame, row: int, column: int, samples: str = "samples_per_pixel", columns: str = "columns", rows: str = "rows") -> DataFrame:
    """The samples of one pixel of each frame, in colour order; null outside."""
    inside = (F.lit(row) >= 0) & (F.lit(column) >= 0) & (F.lit(row) < F.col(rows)) & (F.lit(column) < F.col(columns))
    at = (F.lit(row) * F.col(columns) + F.lit(column)) * F.col(samples)
    return frames.withColumn("pixel", F.when(inside, F.slice("samples", at + 1, F.col(samples))))
