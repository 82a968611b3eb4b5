"""Editions of published families on disk, found by their snapshot before a file is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Editions:
    """A folder of family=.../edition=... tables and their manifest (family, edition, snapshot)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, df: DataFrame, family: str, edition: str, snapshot: str) -> None:
        """Writes an edition beside the others, then names it in the manifest; an edition is never written twice."""
        df.write.mode("errorifexists").parquet(f"{self.folder}/records/family={family}/edition={edition}")
        row = self.spark.createDataFrame([(family, edition, snapshot)], "family string, edition string, snapshot string")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def edition_of(self, wanted: dict[str, str]) -> str | None:
        """The edition whose snapshots are exactly these, of all its families; a manifest has a row for each family and edition."""
        held: dict[str, dict[str, str]] = {}
        for r in self.manifest().collect():
            held.setdefault(r.edition, {})[r.family] = r.snapshot
        return next((e for e, own in sorted(held.items()) if own == wanted), None)

    def inputs(self, wanted: dict[str, str], codes: list[str] | None = None) -> DataFrame | None:
        """The records of the edition with exactly these snapshots, or None; files of other editions and families are not opened."""
        edition = self.edition_of(wanted)
        if edition is None:
            return None
        df = self.spark.read.parquet(f"{self.folder}/records").where(F.col("edition") == edition).where(F.col("family").isin(*wanted))
        return df if codes is None else df.where(F.col("code").isin(*codes))
