"""Catalog predicates: scan filters, scoped search, classification (FLT-1 to FLT-9, FLT-11 to FLT-18)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.functions.text import clean, common_prefix, path_parts

FORMATS = ("dicom", "png", "jpeg", "tiff", "webp")
#: Filter fields, their two spellings and the catalog column.
FIELDS = {
    "patient_id": ("PatientID", "patient_id"),
    "patient_name": ("PatientName", "patient_name"),
    "study_description": ("StudyDescription", "study_description"),
    "study_date": ("StudyDate", "study_date"),
    "study_uid": ("StudyInstanceUID", "study_instance_uid"),
    "series_description": ("SeriesDescription", "series_description"),
    "series_number": ("SeriesNumber", "series_number"),
    "series_uid": ("SeriesInstanceUID", "series_instance_uid"),
    "modality": ("Modality", "modality"),
    "format": (None, "format"),
    "path": (None, "path"),
}
#: Search scopes and the columns they look at; None is an unscoped term.
SCOPES: dict[str | None, tuple[str, ...]] = {
    "patient": ("patient_id", "patient_name"),
    "study": ("study_description", "study_date", "study_instance_uid"),
    "series": ("series_description", "series_number", "series_instance_uid"),
    "modality": ("modality",),
    "format": (),
    None: ("patient_id", "patient_name", "study_description", "study_date", "series_description", "series_number", "modality"),
}


@dataclass(frozen=True)
class ScanFilter:
    """One `FIELD=VALUE`: contains without case, for `format` equality without case."""

    column: str
    value: str
    equal: bool = False

    @classmethod
    def parse(cls, text: str) -> ScanFilter:
        field, sep, value = text.partition("=")
        field, value = field.strip().lower(), value.strip()
        found = next((k for k, (long, _) in FIELDS.items() if field in (k, (long or k).lower())), None)
        if not sep or found is None or not value or (found == "format" and value.lower() not in FORMATS):
            raise ValueError(f"expected FIELD=VALUE with a field of {', '.join(FIELDS)}: {text!r}")
        return cls(FIELDS[found][1], value, found == "format")

    def predicate(self) -> Column:
        c = F.lower(F.coalesce(F.col(self.column), F.lit("")))
        return c == self.value.lower() if self.equal else F.contains(c, F.lit(self.value.lower()))


def scan_filter(filters: Sequence[ScanFilter | str]) -> Column:
    """All filters together; true for none."""
    parsed = [f if isinstance(f, ScanFilter) else ScanFilter.parse(f) for f in filters]
    return reduce(lambda a, b: a & b, (f.predicate() for f in parsed), F.lit(True))


def format_selection(text: str) -> list[str]:
    """A comma list of exact format names, without case; no aliases, no empty items."""
    names = [item.strip().lower() for item in text.split(",")]
    for item in names:
        if item not in FORMATS:
            raise ValueError(f"invalid format {item!r}; expected one of {', '.join(FORMATS)}")
    return [f for f in FORMATS if f in names]


def is_raster(fmt: Column) -> Column:
    return fmt != "dicom"


def format_names(fmt: Column) -> Column:
    return F.when(fmt == "jpeg", F.array(fmt, F.lit("jpg"))).when(fmt == "tiff", F.array(fmt, F.lit("tif"))).otherwise(F.array(fmt))


def search_term(term: str, scopes: dict[str | None, Sequence[str]] = SCOPES, fmt: str | None = "format", shown_path: str | None = None) -> Column:
    """One term: scoped (`scope:needle`) or over the unscoped columns; an empty needle matches all."""
    names = "|".join(s for s in scopes if s)
    m = re.fullmatch(rf"({names}):(.*)", term.strip(), re.I | re.S)
    scope, needle = (m[1].lower(), m[2]) if m else (None, term)
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    values = F.array(*[clean(F.col(c).cast("string")) for c in scopes[scope]], *([clean(F.col(shown_path))] if shown_path and scope is None else []))
    if fmt is not None and scope == "format":
        values = format_names(F.col(fmt))
    elif fmt is not None and scope is None:
        values = F.when(is_raster(F.col(fmt)), F.concat(values, format_names(F.col(fmt)))).otherwise(values)
    return F.exists(values, lambda v: F.contains(F.lower(v), F.lit(needle)))


def search(query: str, **options) -> Column:
    """All terms, separated by white space."""
    return reduce(lambda a, b: a & b, (search_term(t, **options) for t in query.split()), F.lit(True))


def shown_paths(files: DataFrame, path: str = "path", where: Column | None = None) -> DataFrame:
    """files with `shown_path`: the path below the folders that all (or all selected) files share.

    The shared prefix is that of the least and the greatest folder, so one aggregation finds it.
    """
    folders = path_parts(F.col(path))
    folders = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0)))
    own = folders if where is None else F.when(where, folders)
    shared = files.agg(common_prefix(F.min(own), F.max(own)).alias("_shared"))
    return files.join(F.broadcast(shared)).withColumn("shown_path", F.array_join(F.slice(path_parts(F.col(path)), F.size("_shared") + 1, 1 << 30), "/")).drop("_shared")


def filter_files(files: DataFrame, query: str, paths: str = "directory") -> DataFrame:
    """Files that match a search, with the part of the path that the view shows: directory, study or hidden."""
    if not query.strip():
        return files
    if paths == "hidden":
        return files.where(search(query))
    raster = is_raster(F.col("format"))
    shown = shown_paths(files, where=raster if paths == "study" else None)
    if paths == "study":
        shown = shown.withColumn("shown_path", F.when(raster, F.col("shown_path")).otherwise(F.element_at(path_parts(F.col("path")), -1)))
    return shown.where(search(query, shown_path="shown_path")).drop("shown_path")


def in_frame_scope(everything: Column, frames: Column, frame: Column) -> Column:
    return everything | F.coalesce(F.array_contains(frames, frame), F.lit(False))


#: Transfer syntaxes and their codecs.
CODECS = {
    "1.2.840.10008.1.2": "native",
    "1.2.840.10008.1.2.1": "native",
    "1.2.840.10008.1.2.2": "native",
    "1.2.840.10008.1.2.1.99": "native",
    "1.2.840.10008.1.2.8.1": "deflated_frame",
    "1.2.840.10008.1.2.4.50": "jpeg_baseline",
    "1.2.840.10008.1.2.4.57": "jpeg_lossless",
    "1.2.840.10008.1.2.4.70": "jpeg_lossless",
    "1.2.840.10008.1.2.4.90": "jpeg_2000",
    "1.2.840.10008.1.2.4.80": "jpeg_ls",
    "1.2.840.10008.1.2.4.110": "jpeg_xl",
    "1.2.840.10008.1.2.5": "rle",
}
#: Storage classes of each object kind, matched exactly.
OBJECT_KINDS = {
    "classic_image": [
        "1.2.840.10008.5.1.4.1.1.1",
        "1.2.840.10008.5.1.4.1.1.1.1",
        "1.2.840.10008.5.1.4.1.1.1.2",
        "1.2.840.10008.5.1.4.1.1.1.2.1",
        "1.2.840.10008.5.1.4.1.1.2",
        "1.2.840.10008.5.1.4.1.1.3.1",
        "1.2.840.10008.5.1.4.1.1.4",
        "1.2.840.10008.5.1.4.1.1.6.1",
        "1.2.840.10008.5.1.4.1.1.7",
        "1.2.840.10008.5.1.4.1.1.7.1",
        "1.2.840.10008.5.1.4.1.1.12.1",
        "1.2.840.10008.5.1.4.1.1.12.2",
        "1.2.840.10008.5.1.4.1.1.20",
        "1.2.840.10008.5.1.4.1.1.77.1.1",
        "1.2.840.10008.5.1.4.1.1.77.1.2",
        "1.2.840.10008.5.1.4.1.1.77.1.4",
        "1.2.840.10008.5.1.4.1.1.128",
    ],
    "enhanced_image": [
        "1.2.840.10008.5.1.4.1.1.2.1",
        "1.2.840.10008.5.1.4.1.1.4.1",
        "1.2.840.10008.5.1.4.1.1.130",
    ],
    "whole_slide_microscopy": [
        "1.2.840.10008.5.1.4.1.1.77.1.6",
    ],
    "segmentation": [
        "1.2.840.10008.5.1.4.1.1.66.4",
        "1.2.840.10008.5.1.4.1.1.66.7",
    ],
    "parametric_map": [
        "1.2.840.10008.5.1.4.1.1.30",
    ],
    "real_world_value_mapping": [
        "1.2.840.10008.5.1.4.1.1.67",
    ],
    "presentation_state": [
        "1.2.840.10008.5.1.4.1.1.11.1",
        "1.2.840.10008.5.1.4.1.1.11.2",
        "1.2.840.10008.5.1.4.1.1.11.4",
        "1.2.840.10008.5.1.4.1.1.11.8",
    ],
    "registration": [
        "1.2.840.10008.5.1.4.1.1.66.1",
        "1.2.840.10008.5.1.4.1.1.66.3",
    ],
    "structured_report": [
        "1.2.840.10008.5.1.4.1.1.88.11",
        "1.2.840.10008.5.1.4.1.1.88.33",
        "1.2.840.10008.5.1.4.1.1.88.34",
    ],
    "key_object_selection": [
        "1.2.840.10008.5.1.4.1.1.88.59",
    ],
    "waveform": [
        "1.2.840.10008.5.1.4.1.1.9.1.1",
        "1.2.840.10008.5.1.4.1.1.9.1.2",
    ],
    "radiation_therapy": [
        "1.2.840.10008.5.1.4.1.1.481.1",
        "1.2.840.10008.5.1.4.1.1.481.2",
        "1.2.840.10008.5.1.4.1.1.481.3",
        "1.2.840.10008.5.1.4.1.1.481.5",
        "1.2.840.10008.5.1.4.1.1.481.12",
        "1.2.840.10008.5.1.4.1.1.481.13",
    ],
    "encapsulated_pdf": [
        "1.2.840.10008.5.1.4.1.1.104.1",
    ],
}
#: Three-sample layouts that a codec displays, by bits.
COLORS = {
    ("native", 8): ["RGB", "YBR_FULL", "YBR_FULL_422"],
    ("jpeg_baseline", 8): ["RGB", "YBR_FULL", "YBR_FULL_422"],
    ("jpeg_lossless", 8): ["RGB", "YBR_FULL"],
    ("jpeg_2000", 8): ["RGB", "YBR_RCT", "YBR_ICT"],
    ("jpeg_2000", 16): ["RGB", "YBR_RCT", "YBR_ICT"],
    ("jpeg_xl", 8): ["RGB", "YBR_RCT", "YBR_FULL"],
    ("rle", 8): ["RGB", "YBR_FULL", "YBR_FULL_422"],
}
#: Bits that the native codec reads of each kind of sample, and the others of integers.
NATIVE_BITS = {"integer": [1, 8, 16, 32], "float32": [32], "float64": [64]}
CODED_BITS = [8, 16]
#: Reasons of syntaxes that are known but not read.
SYNTAX_REASONS = {
    "1.2.840.10008.1.2.4.81": "transfer_syntax.jpeg_ls_not_supported",
    "1.2.840.10008.1.2.4.111": "transfer_syntax.jpeg_xl_not_supported",
    "1.2.840.10008.1.2.4.112": "transfer_syntax.jpeg_xl_not_supported",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def codec(syntax: Column) -> Column:
    return _lookup(CODECS, syntax)


def object_kind(sop_class: Column, fmt: Column | None = None) -> Column:
    """The kind of an exactly known class, else unknown; a raster is an image."""
    table = {uid: kind for kind, own in OBJECT_KINDS.items() for uid in own}
    kind = F.coalesce(_lookup(table, sop_class), F.lit("unknown"))
    return kind if fmt is None else F.when(is_raster(fmt), "image").otherwise(kind)


def pixel_support(f: Column) -> Column:
    """struct(state, reason) by the ordered rules: renderable, metadata_only or unsupported.

    f: struct(format, raster_unsupported, has_pixels, syntax, rows, columns, samples, bits, signed, kind, photometric);
    kind is integer (also null), float32 or float64.
    """
    own, bits = codec(f["syntax"]), f["bits"]
    says = lambda state, reason=None: F.struct(F.lit(state).alias("state"), (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"))
    layout = lambda reason: says("unsupported", f"pixel_layout.{reason}")
    good = says("renderable")
    raster = F.when(f["raster_unsupported"].isNull(), good).otherwise(says("unsupported", F.concat(F.lit("raster."), f["raster_unsupported"])))
    bare = F.trim(f["photometric"])
    packed = (f["rows"] > 0) & (f["columns"] > 0) & (bits == 1) & ~f["signed"] & (f["samples"] == 1) & bare.isin("MONOCHROME1", "MONOCHROME2")

    kind = F.coalesce(f["kind"], F.lit("integer"))
    native = reduce(lambda a, b: a | b, ((kind == k) & bits.isin(own_bits) for k, own_bits in NATIVE_BITS.items()))
    precise = F.when(own == "native", native).otherwise((kind == "integer") & bits.isin(CODED_BITS))
    name = F.upper(bare)
    shown = reduce(lambda a, b: a | b, ((own == c) & (bits == n) & name.isin(names) for (c, n), names in COLORS.items()))
    palette = own.isin("native", "rle") & (bits == 8)
    single = (
        F.when(name.isin("MONOCHROME1", "MONOCHROME2"), good)
        .when(name == "PALETTE COLOR", F.when(palette, good).otherwise(layout("palette_color_not_supported")))
        .otherwise(layout("photometric_interpretation_not_supported"))
    )
    anywhere = sorted({n for names in COLORS.values() for n in names})
    triple = F.when(shown, good).when(name.isin(anywhere), layout("generic_color_rendering_only")).otherwise(layout("samples_per_pixel_not_supported"))
    frames = (
        F.when((f["rows"] == 0) | (f["columns"] == 0), layout("invalid_geometry"))
        .when(f["samples"] == 0, layout("samples_per_pixel_not_supported"))
        .when(precise, F.when(f["samples"] == 1, single).when(f["samples"] == 3, triple).otherwise(layout("samples_per_pixel_not_supported")))
        .when(bits == 1, layout("bit_packed_not_supported"))
        .otherwise(layout("numeric_precision_not_supported"))
    )
    return (
        F.when(is_raster(f["format"]), raster)
        .when(~f["has_pixels"], says("metadata_only", "pixel_data.absent_or_unrecognized"))
        .when(own.isNull(), says("unsupported", F.coalesce(_lookup(SYNTAX_REASONS, f["syntax"]), F.lit("transfer_syntax.not_supported"))))
        .when(own == "deflated_frame", F.when(F.coalesce(packed, F.lit(False)), good).otherwise(layout("bit_packed_not_supported")))
        .otherwise(frames)
    )


def file_summary(files: DataFrame) -> DataFrame:
    """Catalog rows without the heavy metadata, with object kind and support (FLT-15)."""
    heavy = {"per_frame", "positions", "orientations", "luts", "shutter", "overlays", "image_type"}
    kept = [c for c in files.columns if c not in heavy]
    out = files.select(*kept).withColumn("object_kind", object_kind(F.col("sop_class_uid"), F.col("format")))
    wanted = {"format": "format", "raster_unsupported": "raster_unsupported", "has_pixels": "has_pixels", "syntax": "transfer_syntax_uid", "rows": "rows", "columns": "columns", "samples": "samples_per_pixel", "bits": "bits_allocated", "signed": "signed", "kind": "pixel_kind", "photometric": "photometric_interpretation"}
    support = pixel_support(F.struct(*[F.col(c).alias(n) for n, c in wanted.items()]))
    return out.withColumn("_support", support).withColumns({"support_state": F.col("_support.state"), "support_reason": F.col("_support.reason")}).drop("_support")


def page(items: Column, offset: int, limit: int) -> Column:
    """struct(items, truncated, total): skip and take; total only if truncated (FLT-19)."""
    cut = F.slice(items, offset + 1, limit)
    truncated = (F.size(cut) < F.size(items)) if offset == 0 else (F.lit(True) & (F.size(items) != F.size(cut)))
    return F.struct(cut.alias("items"), truncated.alias("truncated"), F.when(truncated, F.size(items)).alias("total"))
