"""The catalog facade: open paths, filter, and query by methods that return DataFrames (UDX-6, UDX-8)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.functions import privacy, samples
from lumenstack.operators import catalog, filters, links
from lumenstack.operators.filters import FORMATS
from lumenstack.session import path_exists
from lumenstack.sources import rois, scan


@dataclass
class Catalog:
    """Discovered files (one row each, `file_index` by path) with their discovery records."""

    files: DataFrame
    discovery: DataFrame
    mask_key: str | None = None
    roots: list[str] = field(default_factory=list)
    recursive: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def health(self) -> dict:
        return {r["disposition"]: r["n"] for r in catalog.discovery_counts(self.discovery).collect()}

    def skip_breakdown(self) -> DataFrame:
        return catalog.skip_breakdown(self.discovery)

    def page(self, since: int | None = None, limit: int | None = None) -> tuple[DataFrame, dict]:
        """One page of the catalog's change feed."""
        return catalog.delta_page(catalog.with_revisions(self.files, ["path"]), since, limit)

    def search(self, query: str, paths: str = "directory") -> DataFrame:
        return filters.filter_files(self.files, query, paths)

    def info(self, file_index: int) -> DataFrame:
        return self.files.where(F.col("file_index") == file_index)

    def navigator(self) -> DataFrame:
        return catalog.navigator_rows(self.files).orderBy(*catalog.navigator_order())

    def counts(self) -> DataFrame:
        return catalog.navigator_counts(catalog.navigator_rows(self.files))

    def folders(self) -> DataFrame:
        return catalog.folder_tree(self.files).orderBy(*catalog.folder_order())

    def references(self, edges: DataFrame) -> DataFrame:
        """Resolved references of declared edges against the catalog."""
        c = self.files.select("file_index", "path", F.col("sop_class_uid").alias("sop_class"), F.col("sop_instance_uid").alias("sop_instance"), F.col("series_instance_uid").alias("series"), F.coalesce("frame_count", F.lit(1)).cast("int").alias("frame_count"))
        return links.resolve_edges(edges, c)

    def masked(self) -> DataFrame:
        """Catalog rows with pseudonyms, shifted dates and hashed identifiers."""
        if self.mask_key is None:
            raise ValueError("the catalog was opened without a mask key")
        extra = {"support_reason": F.lit(None).cast("string")} if "support_reason" not in self.files.columns else {}
        return privacy.masked_summary(self.files.withColumns(extra) if extra else self.files, self.mask_key)

    def digests(self) -> DataFrame:
        """Content digests; reads whole files where they are, and joins digests, not contents, to the catalog."""
        found = samples.file_digests(scan.read_binary(self.spark, self.roots, self.recursive))
        return found.join(self.files.select("path"), "path", "left_semi")

    def import_rois(self, path: str, working_directory: str = "/") -> DataFrame:
        """Region lists of a CSV for the loaded files; refused as a whole on the first broken row."""
        sizes = self.files.select("file_index", "rows", "columns", F.coalesce("frame_count", F.lit(1)).alias("frame_count"))
        local = self.files.select("file_index", F.regexp_replace("path", "^file:", "").alias("path"))
        parsed = rois.parse_rois(rois.read_csv(self.spark, path), lambda rows: links.path_join(rows, local, working_directory).where("file_index is not null").join(sizes, "file_index"))
        return rois.checked(parsed)


def open_catalog(spark: SparkSession, paths: str | Sequence[str], filters: Sequence[str] = (), formats: Sequence[str] = FORMATS, recursive: bool = True, mask_key: str | None = None) -> Catalog:
    """Scan paths into a catalog; files are numbered by path."""
    roots = [paths] if isinstance(paths, str) else list(paths)
    found, records = scan.discover(spark, roots, filters, formats, recursive)
    numbered = catalog.with_revisions(found, ["path"], -1).withColumnRenamed("revision", "file_index").withColumn("file_index", F.col("file_index").cast("int"))
    return Catalog(numbered, records, mask_key, [p for p in roots if path_exists(spark, p)], recursive)
