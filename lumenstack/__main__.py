"""Command line: scan paths and print a view of the catalog (UDX-7)."""

from __future__ import annotations

import argparse

from lumenstack.api import open_catalog
from lumenstack.operators.filters import FORMATS, ScanFilter, format_selection
from lumenstack.session import session

VIEWS = ("files", "navigator", "counts", "folders", "discovery", "skips", "masked", "digests")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenstack", description="Scan files into a catalog and show a view of it.")
    p.add_argument("paths", nargs="+")
    p.add_argument("--filter", action="append", default=[], type=ScanFilter.parse, metavar="FIELD=VALUE", help="all filters must match")
    p.add_argument("--formats", default=list(FORMATS), type=format_selection, help="comma list of formats")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--search", default="", help="terms, each optionally scoped: patient: study: series: modality: format:")
    p.add_argument("--mask", metavar="KEY", help="key of pseudonyms and shifted dates")
    p.add_argument("--view", choices=VIEWS, default="files")
    p.add_argument("--limit", type=int, default=50, help="rows to print")
    p.add_argument("--rois", metavar="CSV", help="import region lists and print them")
    p.add_argument("--master", default="local[*]")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(args.master)
    catalog = open_catalog(spark, args.paths, args.filter, args.formats, not args.no_recursive, args.mask)
    if args.rois:
        catalog.import_rois(args.rois).show(args.limit, False)
        return
    shown = {
        "files": lambda: catalog.search(args.search).select("file_index", "path", "format", "label"),
        "navigator": lambda: catalog.navigator().select("patient_label", "study_label", "series_number", "path"),
        "counts": catalog.counts,
        "folders": catalog.folders,
        "discovery": lambda: catalog.discovery,
        "skips": catalog.skip_breakdown,
        "masked": lambda: catalog.masked().select("file_index", "display_name", "patient_id", "study_date"),
        "digests": catalog.digests,
    }
    shown[args.view]().show(args.limit, False)


if __name__ == "__main__":
    main()
