"""Column expressions and byte helpers for the word definitions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters, digits and all non-ASCII characters.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def word_chunks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of `data` (separated by ASCII white space), a bounded number of bytes at a time."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end
