"""Bounded reader of Part 10 headers, from the public standard (SRC-6, SRC-7, SRC-10, CTX-56).

Values beyond VALUE_CAP bytes are skipped, nesting beyond DEPTH_CAP and deflated sets beyond INFLATE_CAP
are errors. Reading stops at the pixel data. Nested sequences are read where asked for.
"""

from __future__ import annotations

import struct
import zlib

VALUE_CAP, DEPTH_CAP, INFLATE_CAP, ITEM_CAP = 1 << 20, 16, 256 << 20, 4096
MEDIA_DIRECTORY = "1.2.840.10008.1.3.10"
EXPLICIT, IMPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
LONG_FORM = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
PIXELS = {(0x7FE0, 0x0010): "integer", (0x7FE0, 0x0008): "float32", (0x7FE0, 0x0009): "float64"}
UNDEFINED = 0xFFFFFFFF

#: Catalog columns and their tags; of a multi-valued element the first value.
TEXTS = {
    "transfer_syntax_uid": (0x0002, 0x0010),
    "sop_class_uid": (0x0008, 0x0016),
    "sop_instance_uid": (0x0008, 0x0018),
    "study_date": (0x0008, 0x0020),
    "modality": (0x0008, 0x0060),
    "study_description": (0x0008, 0x1030),
    "series_description": (0x0008, 0x103E),
    "patient_name": (0x0010, 0x0010),
    "patient_id": (0x0010, 0x0020),
    "study_instance_uid": (0x0020, 0x000D),
    "series_instance_uid": (0x0020, 0x000E),
    "series_number": (0x0020, 0x0011),
    "instance_number": (0x0020, 0x0013),
    "frame_of_reference_uid": (0x0020, 0x0052),
    "concatenation_uid": (0x0020, 0x9161),
    "photometric_interpretation": (0x0028, 0x0004),
    "container_identifier": (0x0040, 0x0512),
    "pyramid_uid": (0x0008, 0x0019),
    "pixel_kind": (0x7FE0, 0x0010),
}
INTEGERS = {
    "samples_per_pixel": (0x0028, 0x0002),
    "planar_configuration": (0x0028, 0x0006),
    "frame_count": (0x0028, 0x0008),
    "rows": (0x0028, 0x0010),
    "columns": (0x0028, 0x0011),
    "bits_allocated": (0x0028, 0x0100),
    "bits_stored": (0x0028, 0x0101),
    "high_bit": (0x0028, 0x0102),
    "pixel_representation": (0x0028, 0x0103),
    "matrix_columns": (0x0048, 0x0006),
    "matrix_rows": (0x0048, 0x0007),
    "concatenation_offset": (0x0020, 0x9228),
    "in_concatenation_number": (0x0020, 0x9162),
}
DOUBLES = {"rescale_intercept": (0x0028, 0x1052), "rescale_slope": (0x0028, 0x1053), "window_center": (0x0028, 0x1050), "window_width": (0x0028, 0x1051)}
VECTORS = {"position": (0x0020, 0x0032), "orientation": (0x0020, 0x0037), "spacing": (0x0028, 0x0030), "offsets": (0x3004, 0x000C)}
IMAGE_TYPE = (0x0008, 0x0008)
DEFAULTS = {"samples_per_pixel": 1, "planar_configuration": 0, "frame_count": 1, "bits_allocated": 8, "pixel_representation": 0, "rescale_intercept": 0.0, "rescale_slope": 1.0, "photometric_interpretation": "MONOCHROME2"}


class Malformed(ValueError):
    pass


class Reader:
    def __init__(self, data: bytes, at: int, explicit: bool, big: bool):
        self.data, self.at, self.explicit, self.order = data, at, explicit, ">" if big else "<"

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise Malformed("truncated element")
        out = struct.unpack_from(self.order + form, self.data, self.at)
        self.at += size
        return out

    def element(self) -> tuple[tuple[int, int], bytes, int]:
        tag = self.take("HH")
        if tag[0] == 0xFFFE or not self.explicit:
            return tag, b"", self.take("I")[0]
        vr = self.data[self.at : self.at + 2]
        self.at += 2
        if vr in LONG_FORM:
            self.at += 2
            return tag, vr, self.take("I")[0]
        return tag, vr, self.take("H")[0]

    def items(self, length: int, depth: int) -> list[dict]:
        """The items of a sequence, each a data set."""
        if depth > DEPTH_CAP:
            raise Malformed("nested too deep")
        end, out = (len(self.data) if length == UNDEFINED else self.at + length), []
        while self.at < end:
            tag, _, n = self.element()
            if tag == (0xFFFE, 0xE0DD):
                break
            if tag != (0xFFFE, 0xE000):
                raise Malformed("item expected")
            own = self.data_set(None if n == UNDEFINED else self.at + n, depth + 1)
            if len(out) < ITEM_CAP:
                out.append(own)
        return out

    def data_set(self, end: int | None = None, depth: int = 0) -> dict:
        """tag -> (vr, bytes or list of data sets, length)."""
        out: dict = {}
        while self.at < (len(self.data) if end is None else end):
            start = self.at
            tag, vr, length = self.element()
            if tag == (0xFFFE, 0xE00D):
                break
            if tag in PIXELS and depth == 0:
                out[tag] = (vr, PIXELS[tag].encode(), len(self.data) - self.at if length == UNDEFINED else length)
                out["encapsulated"] = length == UNDEFINED
                out["pixels_at"] = self.at
                break
            if vr == b"SQ" or length == UNDEFINED or (not self.explicit and self.data[self.at : self.at + 4] == struct.pack(self.order + "HH", 0xFFFE, 0xE000)):
                out[tag] = (b"SQ", self.items(length, depth), length)
                continue
            if self.at + length > len(self.data):
                raise Malformed("value beyond the end")
            if self.at + length <= start:
                raise Malformed("no progress")
            out[tag] = (vr, self.data[self.at : self.at + length] if length <= VALUE_CAP else b"", length)
            self.at += length
        return out


def parse(data: bytes) -> tuple[dict, dict, str]:
    """(file meta, data set, transfer syntax)."""
    if data[128:132] != b"DICM":
        raise Malformed("no preamble")
    meta_reader = Reader(data, 132, True, False)
    meta: dict = {}
    while data[meta_reader.at : meta_reader.at + 2] == b"\x02\x00":
        tag, vr, length = meta_reader.element()
        if meta_reader.at + length > len(data):
            raise Malformed("truncated file meta")
        meta[tag] = (vr, data[meta_reader.at : meta_reader.at + length], length)
        meta_reader.at += length
    syntax = text(meta.get((0x0002, 0x0010))) or IMPLICIT
    body, at = data, meta_reader.at
    if syntax == DEFLATED:
        inflate = zlib.decompressobj(-15)
        body, at = inflate.decompress(data[at:], INFLATE_CAP), 0
        if inflate.unconsumed_tail:
            raise Malformed("inflated beyond the cap")
    return meta, Reader(body, at, syntax != IMPLICIT, syntax == BIG).data_set(), syntax


def text(e: tuple | None, encoding: str = "latin-1") -> str | None:
    if e is None or isinstance(e[1], list):
        return None
    return e[1].decode(encoding, "replace").split("\\")[0].rstrip("\0").strip()


def texts(e: tuple | None) -> list[str]:
    return [] if e is None or isinstance(e[1], list) else [t.strip(" \0") for t in e[1].decode("latin-1").split("\\")]


def numbers(e: tuple | None, big: bool = False) -> list[float]:
    """All values that parse, whatever the representation: binary by VR, text split at backslashes."""
    if e is None or isinstance(e[1], list):
        return []
    form = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}.get(e[0])
    if form is None and e[0] == b"":
        form = "H" if len(e[1]) == 2 else None
    if form:
        n = len(e[1]) // struct.calcsize(form)
        return list(struct.unpack((">" if big else "<") + form * n, e[1][: n * struct.calcsize(form)]))
    out = []
    for t in texts(e):
        try:
            out.append(float(t))
        except ValueError:
            pass
    return out


def lookup_table(item: dict, big: bool = False) -> dict | None:
    """struct(first, bits, entries) of a table item: count 0 means 65,536; bits 8 or 16; too few entries give none."""
    d, e = numbers(item.get((0x0028, 0x3002)), big), item.get((0x0028, 0x3006))
    if len(d) != 3 or e is None or int(d[2]) not in (8, 16):
        return None
    count = int(d[0]) or 65_536
    wide = int(d[2]) == 16 or len(e[1]) >= 2 * count
    n = len(e[1]) // (2 if wide else 1)
    values = struct.unpack((">" if big else "<") + ("H" if wide else "B") * n, e[1][: n * (2 if wide else 1)])
    return {"first": int(d[1]), "bits": int(d[2]), "entries": list(values[:count])} if n >= count else None


def read_header(data: bytes) -> dict:
    """Catalog columns of one object; `error` if it can't be parsed."""
    try:
        meta, ds, syntax = parse(data)
    except (Malformed, struct.error, zlib.error, RecursionError) as e:
        return {"error": str(e) or type(e).__name__}
    big = syntax == BIG
    charset = text(ds.get((0x0008, 0x0005))) or ""
    encoding = "utf-8" if charset.endswith("192") else "latin-1"
    out: dict = {"transfer_syntax_uid": syntax, "error": None}
    for name, tag in TEXTS.items():
        if name not in ("transfer_syntax_uid", "pixel_kind"):
            out[name] = text(ds.get(tag), encoding)
    out["sop_class_uid"] = out["sop_class_uid"] or text(meta.get((0x0002, 0x0002)))
    for table, cast in ((INTEGERS, int), (DOUBLES, float)):
        for name, tag in table.items():
            own = numbers(ds.get(tag), big)
            out[name] = cast(own[0]) if own else DEFAULTS.get(name)
    out["samples_per_pixel"] = max(1, out["samples_per_pixel"])
    out["photometric_interpretation"] = out["photometric_interpretation"] or DEFAULTS["photometric_interpretation"]
    for name, tag in VECTORS.items():
        out[name] = numbers(ds.get(tag), big) or None
    out["image_type"] = texts(ds.get(IMAGE_TYPE))
    pixels = next((t for t in PIXELS if t in ds), None)
    out["has_pixels"] = pixels is not None
    out["pixel_kind"] = PIXELS.get(pixels)
    out["pixel_length"] = ds[pixels][2] if pixels else None
    return out
