"""Published bundles: a manifest, datasets by key, results sharded by election, hashes.

Reads run in Spark's tasks (S02) and take gzip by a file's ending (S03).
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranged import listed, looked_at, relative


def _read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    return json.loads(rows[0][0])


class Bundle:
    """Datasets of a folder with a ``manifest.json`` of the form {"files": {key: relative path}}. Any file system of Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = _read_json(spark, f"{self.root}/manifest.json")

    def path(self, key: str) -> str:
        files = self.manifest.get("files", {})
        if key not in files:
            raise KeyError(f"the manifest has no dataset {key!r}")
        return posixpath.join(self.root, files[key])

    def load(self, key: str, schema: str | None = None) -> DataFrame:
        """A dataset by its key, read by its file's ending."""
        path = self.path(key)
        kind = path.rsplit(".", 1)[-1] if not path.endswith(".csv.gz") else "csv"
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        if kind == "parquet":
            return reader.parquet(path)
        if kind == "csv":
            return reader.option("header", True).csv(path)
        if kind in ("json", "geojson"):
            return reader.option("multiLine", True).json(path)
        raise ValueError(f"no reader for {path}")

    def available_elections(self) -> list[str]:
        return [r[0] for r in self.load("elections_master").select("election_key").distinct().orderBy("election_key").collect()]  # a row an election

    def results_for_election(self, key: str) -> DataFrame:
        """One partition of the sharded results; Spark prunes the others."""
        return self.load("municipality_results_long").filter(F.col("election_key") == key)

    def summary_for_election(self, key: str) -> DataFrame:
        return self.load("municipality_summary").filter(F.col("election_key") == key)

    def filter_summary(self, election: str | None = None, province: str | None = None, municipality: str | None = None) -> DataFrame:
        out = self.load("municipality_summary")
        for column, value in (("election_key", election), ("province", province), ("municipality_id", municipality)):
            out = out if value is None else out.filter(F.col(column) == value)
        return out

    def verify_integrity(self) -> DataFrame:
        """Per declared file: dataset_key, status (ok, missing_path, missing_file, mismatch)."""
        declared = [(k, v.get("path"), v.get("sha256")) for k, v in self.manifest.get("hashes", {}).items()]
        want = self.spark.createDataFrame(declared, "dataset_key string, path string, sha256 string")
        have = looked_at(listed(self.spark, self.root)).select(relative(F.col("path"), self.root).alias("path"), F.col("sha256").alias("actual"))
        status = F.when(F.col("path").isNull(), "missing_path").when(F.col("actual").isNull(), "missing_file").when(F.col("actual") != F.col("sha256"), "mismatch").otherwise("ok")
        return want.join(have, "path", "left").select("dataset_key", status.alias("status"))


def write_shards(rows: DataFrame, path: str, key: str = "election_key") -> DataFrame:
    """Write one partition folder per key, replacing what is there, and return the row counts per key."""
    rows.write.mode("overwrite").partitionBy(key).parquet(path)  # each task writes its own part of every key: none gathers one
    return rows.sparkSession.read.parquet(path).groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))


def read_clean_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """All-string CSV scan with a header; gzip by its file ending."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
