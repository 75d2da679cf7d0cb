"""Headers and metadata trees of PNG, JPEG, TIFF and WebP, from the public formats (SRC-11, SRC-24)."""

from __future__ import annotations

import struct

TREE_CAP = 4096


def _png(d: bytes) -> tuple[int, int, int, int]:
    w, h, depth, color = struct.unpack_from(">IIBB", d, 16)
    return h, w, depth, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]


def _jpeg(d: bytes) -> tuple[int, int, int, int]:
    for marker, at, _ in jpeg_segments(d):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            depth, h, w, n = struct.unpack_from(">BHHB", d, at)
            return h, w, depth, n
    raise ValueError("no frame header")


def jpeg_segments(d: bytes):
    """(marker, start of the payload, its length) up to the scan."""
    at = 2
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            raise ValueError("marker expected")
        marker = d[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        (length,) = struct.unpack_from(">H", d, at + 2)
        yield marker, at + 4, length - 2
        at += 2 + length


def tiff_entries(d: bytes, start: int = 0):
    """(page, tag, kind, count, values or None) of every directory entry; values of number and text kinds only."""
    order = "<" if d[start : start + 2] == b"II" else ">"
    big = struct.unpack_from(order + "H", d, start + 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), d, start + (8 if big else 4))[0]
    size = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
    seen, page = set(), 0
    while at and at not in seen and page < TREE_CAP:
        seen.add(at)
        (n,) = struct.unpack_from(order + ("Q" if big else "H"), d, start + at)
        p, step = start + at + (8 if big else 2), 20 if big else 12
        for i in range(min(n, TREE_CAP)):
            q = p + i * step
            tag, kind = struct.unpack_from(order + "HH", d, q)
            (count,) = struct.unpack_from(order + ("Q" if big else "I"), d, q + 4)
            values = None
            if kind in size and count <= 1024:
                width = struct.calcsize(size[kind]) * count
                inline = 8 if big else 4
                v = q + (12 if big else 8)
                if width > inline:
                    v = start + struct.unpack_from(order + ("Q" if big else "I"), d, v)[0]
                if v + width <= len(d):
                    values = [d[v : v + count].rstrip(b"\0").decode("latin-1")] if kind == 2 else list(struct.unpack_from(order + size[kind] * count, d, v))
            yield page, tag, kind, count, values
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), d, p + n * step)
        page += 1


def _tiff(d: bytes) -> tuple[int, int, int, int]:
    own = {tag: v for page, tag, _, _, v in tiff_entries(d) if page == 0 and v}
    return own[257][0], own[256][0], own.get(258, [1])[0], own.get(277, [1])[0]


def _webp(d: bytes) -> tuple[int, int, int, int]:
    kind = d[12:16]
    if kind == b"VP8X":
        return int.from_bytes(d[27:30], "little") + 1, int.from_bytes(d[24:27], "little") + 1, 8, 4 if d[20] & 16 else 3
    if kind == b"VP8L":
        bits = int.from_bytes(d[21:25], "little")
        return (bits >> 14 & 0x3FFF) + 1, (bits & 0x3FFF) + 1, 8, 4 if bits >> 28 & 1 else 3
    w, h = struct.unpack_from("<HH", d, 26)
    return h & 0x3FFF, w & 0x3FFF, 8, 3


PARSERS = {"png": _png, "jpeg": _jpeg, "tiff": _tiff, "webp": _webp}


def read_header(kind: str, d: bytes) -> dict:
    """Size, depth and channels; `error` if the header doesn't parse. TIFF pages are its frames."""
    try:
        rows, columns, bits, samples = PARSERS[kind](d)
        pages = len({p for p, *_ in tiff_entries(d)}) if kind == "tiff" else 1
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return {"error": str(e) or type(e).__name__}
    if rows <= 0 or columns <= 0:
        return {"error": "no size"}
    return {"rows": rows, "columns": columns, "bits_allocated": bits, "samples_per_pixel": samples, "frame_count": pages, "has_pixels": True, "error": None}


def metadata_tree(kind: str, d: bytes) -> list[tuple[str, str, int, str | None]]:
    """(group, name, length, value) of a file's records, in file order; values where they are short text or numbers."""
    out: list = []
    if kind == "png":
        at = 8
        while at + 8 <= len(d) and len(out) < TREE_CAP:
            n, name = struct.unpack_from(">I4s", d, at)
            own = d[at + 8 : at + 8 + n]
            value = own.replace(b"\0", b"=", 1).decode("latin-1") if name == b"tEXt" and n <= 1024 else None
            out.append(("PNG", name.decode("latin-1"), n, value))
            at += 12 + n
    elif kind == "jpeg":
        out = [("JPEG", f"{m:02X}", n, d[at : at + n].decode("latin-1") if m == 0xFE and n <= 1024 else None) for m, at, n in jpeg_segments(d)][:TREE_CAP]
    elif kind == "tiff":
        out = [(f"page {p}", str(tag), count, ", ".join(map(str, v)) if v else None) for p, tag, _, count, v in tiff_entries(d)][:TREE_CAP]
    elif kind == "webp":
        at = 12
        while at + 8 <= len(d) and len(out) < TREE_CAP:
            name, n = struct.unpack_from("<4sI", d, at)
            out.append(("RIFF", name.decode("latin-1"), n, None))
            at += 8 + n + n % 2
    return out
