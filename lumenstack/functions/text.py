"""Paths, labels, sort keys and display forms (FN-53, FN-61 to FN-63, FN-76, SRC-12, SORT-6 to SORT-8)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def first_known(*parts: Column) -> Column:
    """The first part that isn't blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(clean(p), F.lit("")) for p in parts])


def label(patient_id: Column, modality: Column, study_date: Column, fallback: Column) -> Column:
    """The fields that are not empty, joined by a middle dot; the fallback if none."""
    joined = F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in (patient_id, modality, study_date)])
    return F.when(joined == "", fallback).otherwise(joined)


def natural_key(c: Column) -> Column:
    """Sort key of natural order: lower case, digit runs as numbers (up to 20 digits, without leading zeros).

    Digits are padded to 20 with their count of leading zeros dropped; letters compare without case.
    Accents are not folded, where a locale's collation would.
    """
    low = F.lower(clean(c))
    runs = F.regexp_extract_all(low, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=[0-9])", ""), 20, "0")).otherwise(r)), "")


def known_first(c: Column, descending: bool = False) -> list[Column]:
    """Order: known text first in natural order, blank last in either direction."""
    key = natural_key(c)
    return [(clean(c) == "").asc(), key.desc() if descending else key.asc()]


def numeric_prefix(c: Column) -> Column:
    return F.regexp_extract(clean(c), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0).try_cast("double")


def numeric_first(c: Column) -> list[Column]:
    """Order: texts that start with a number by that number, then the others by known_first."""
    return [numeric_prefix(c).asc_nulls_last(), *known_first(c)]


def date_text(c: Column) -> Column:
    t = clean(c)
    return F.when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(t)


def person_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\^", " "), r"\s+", " "))


def short_uid(c: Column) -> Column:
    t = clean(c)
    return F.when(F.char_length(t) <= 18, t).otherwise(F.concat(F.lit("..."), F.right(t, F.lit(15))))


def path_parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def written_parts(c: Column) -> Column:
    """Components as they are written, empty ones included."""
    return F.split(c, "/")


def normalized_path(c: Column) -> Column:
    """`.` and `..` resolved lexically."""
    parts = F.aggregate(
        path_parts(c),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(F.startswith(c, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def absolute_path(c: Column, working_directory: str) -> Column:
    return normalized_path(F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit(working_directory.rstrip("/") + "/"), c)))


def common_prefix(low: Column, high: Column) -> Column:
    """The common prefix of two arrays; of a whole column, if they are its least and greatest array."""
    same = F.transform(low, lambda x, i: x == F.get(high, i))
    at = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    return F.when(at == 0, low).otherwise(F.slice(low, F.lit(1), (at - 1).cast("int")))


def tag_steps(selector: str) -> list[tuple[int, int, int | None]]:
    """Steps (group, element, item or None) of a selector `(gggg,eeee)/item/(gggg,eeee)...`; the last has no item."""
    parts = selector.split("/")
    if len(parts) % 2 == 0:
        raise ValueError(f"selector ends with an item: {selector}")
    steps = []
    for i in range(0, len(parts), 2):
        m = re.fullmatch(r"\(?([0-9A-Fa-f]{4}),([0-9A-Fa-f]{4})\)?", parts[i].strip())
        item = parts[i + 1] if i + 1 < len(parts) else None
        if not m or (item is not None and not item.isdigit()):
            raise ValueError(f"bad selector: {selector}")
        steps.append((int(m[1], 16), int(m[2], 16), None if item is None else int(item)))
    return steps


def byte_size(text: str) -> int:
    """Digits with an optional KiB, MiB or GiB, in any case, without a blank; at most 64 bits."""
    m = re.fullmatch(r"([0-9]+)(kib|mib|gib)?", text, re.I)
    if not m:
        raise ValueError(f"not a byte size: {text!r}")
    n = int(m[1]) << {None: 0, "kib": 10, "mib": 20, "gib": 30}[m[2] and m[2].lower()]
    if n >= 1 << 64:
        raise ValueError(f"byte size too large: {text!r}")
    return n
