"""What a bundle publishes: table exports, file summaries, product catalogues, contracts and checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranged import listed, looked_at, record_counts

# Arrays whose length says how much a JSON file holds, the first that is there counts.
COUNTED = {"features": "feature_count", "datasets": "dataset_count", "products": "product_count", "entries": "entry_count"}
LEAKS = r"C:\\|/Users/|/mnt/|/home/"


def contract(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the contract's columns (name: type), in its order; those that are missing are null."""
    return rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Write a table as csv, csv.gz, json or parquet. A csv of no rows still has its header."""
    if form.startswith("csv"):
        rows = rows if not rows.isEmpty() else rows.coalesce(1)
        rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path, compression="gzip" if form == "csv.gz" else "none")
    elif form in ("json", "parquet"):
        getattr(rows.write.mode("overwrite"), form)(path)
    else:
        raise ValueError(f"no writer for {form}")


def compression_report(plain: DataFrame, packed: DataFrame) -> DataFrame:
    """One row from two listings: bytes before and after, and by how many percent they fell (0 for nothing)."""
    size = lambda files, name: files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias(name))
    both = size(plain, "original_bytes").crossJoin(size(packed, "compressed_bytes"))  # one row each
    return both.withColumn("reduction_pct", F.coalesce(F.round(100 * (1 - F.try_divide("compressed_bytes", "original_bytes")), 2), F.lit(0.0)))


def shard_index(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """(key, path, row_count) of the shards that ``write_shards`` makes of ``rows``."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).select(key, F.concat(F.lit(f"{folder}/{key}="), F.col(key).cast("string")).alias("path"), "row_count")


def json_counts(text: Column) -> Column:
    """struct(name, n) of the first counted array of a JSON object, else of the shapes of a topology's first layer, else
    of its shards; null for other texts."""
    n = lambda path: F.json_array_length(F.get_json_object(text, path))
    said = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), c.cast("long").alias("n")))
    keys = lambda path: F.json_object_keys(F.get_json_object(text, path))
    layer = F.get_json_object(text, "$.objects")
    first = F.json_array_length(F.get_json_object(F.map_values(F.from_json(layer, "map<string,string>"))[0], "$.geometries"))
    found = [said(name, n(f"$.{array}")) for array, name in COUNTED.items()]
    return F.coalesce(found[0], said("feature_count", first), *found[1:], said("shard_count", F.size(keys("$.shards"))))


def file_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Per csv, json and geojson file below ``root``: path (whole), kind, size_bytes, sha256, row_count (csv), columns
    (csv) and counts (json). Digests and headers are read in pieces, rows counted by splits; a JSON document is one value, so it
    must stay under 2 GB."""
    tidy = lambda c: F.regexp_replace(c, "^[A-Za-z0-9]+:/*", "/")
    files = listed(spark, root, "csv", "json", "geojson")
    seen = looked_at(files).join(files, "path").withColumn("path", tidy("path"))
    documents = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", "*.{json,geojson}").text(root)
    documents = documents.select(tidy("_metadata.file_path").alias("path"), json_counts(F.col("value")).alias("counts"))
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    out = seen.join(documents, "path", "left").join(record_counts(spark, root).withColumn("path", tidy("path")), "path", "left").withColumn("kind", kind)
    return out.select("path", "kind", F.col("length").alias("size_bytes"), "sha256", "columns", "counts", F.when(F.col("kind") == "csv", F.coalesce("row_count", F.lit(0))).alias("row_count"))


def inventory(catalog: DataFrame) -> DataFrame:
    """(product_key, role, dataset_key) from ``catalog`` (product_key, primary_dataset_key, companion_dataset_key,
    extra_dataset_keys): a row for each dataset of a product, blank keys left out."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("string").alias("dataset_key"))
    extra = F.transform(F.coalesce("extra_dataset_keys", F.array().cast("array<string>")), lambda k: one("extra", k))
    roles = F.concat(F.array(one("primary", F.col("primary_dataset_key")), one("companion", F.col("companion_dataset_key"))), extra)
    return catalog.select("product_key", F.inline(roles)).filter(F.coalesce("dataset_key", F.lit("")) != "")


def product_entries(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """The inventory with path, kind, size_bytes, row_count and sha256 of ``files`` (dataset_key and those); datasets
    that have no file are left out."""
    return inventory(catalog).join(files, "dataset_key").select("product_key", "role", "dataset_key", "path", "kind", "size_bytes", "row_count", "sha256")


def codebook(spark: SparkSession, tables: dict[str, StructType], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each column of each table: its place, type, whether it may be null and whether it is of the key."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable, f.name in (keys or {}).get(t, [])) for t, schema in tables.items() for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, type string, nullable boolean, is_key boolean")


def row_checks(elections: DataFrame, summ: DataFrame, res: DataFrame) -> DataFrame:
    """V08, what rows can show: one row a rule: issue, severity, affected. Shares out of range; leaders that are missing where
    a note or flag says otherwise (two findings of one row count twice); local paths in the elections; elections said to be
    completed that have no rows."""
    none = F.trim(F.coalesce("first_party_std", F.lit(""))) == ""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    said = lambda rows, name, severity, count: rows.agg(count.alias("affected")).select(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), "affected")
    misled = n(none & F.contains(F.coalesce("comparability_note", F.lit("")), F.lit("party_rows_checked"))) + n(none & ~F.contains(F.coalesce("completeness_flag", F.lit("")), F.lit("turnout_only")))
    empty = elections.filter(F.lower(F.trim("status")) == "completed").join(summ.select("election_key").distinct(), "election_key", "left_anti")
    share = F.col("vote_share").try_cast("double")
    out = said(res, "vote_share_range", "warning", n((share < -0.01) | (share > 100.01)))
    out = out.unionByName(said(summ, "completeness_semantics", "error", misled))
    out = out.unionByName(said(elections, "elections_master_path_leak", "error", n(F.concat_ws(" ", *[F.col(c).cast("string") for c in elections.columns]).rlike(LEAKS))))
    return out.unionByName(said(empty, "elections_master_completed_without_rows", "error", F.count(F.lit(1))))


def file_checks(spark: SparkSession, manifest: dict, files: DataFrame, required: list[str]) -> DataFrame:
    """V08, what a manifest and a listing show: keys that are missing, and declared files that are. A row for each."""
    declared = manifest.get("files") or {}
    rows = [(k, declared.get(k), k in required) for k in dict.fromkeys([*declared, *required])]
    want = spark.createDataFrame(rows, "dataset_key string, path string, required boolean")
    seen = want.join(files.select("path", F.lit(True).alias("there")), "path", "left")
    issue = F.when(F.coalesce("path", F.lit("")) == "", F.when(F.col("required"), F.concat(F.lit("manifest:missing_"), "dataset_key"))).when(F.col("there").isNull(), F.concat(F.lit("manifest:missing_file_for_"), "dataset_key"))
    return seen.select("dataset_key", issue.alias("issue")).filter("issue IS NOT NULL")


def contract_checks(tables: dict[str, DataFrame], contracts: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(dataset, missing, rows, repeated): of each contract (columns, key columns) the columns its table lacks, and how many
    of its rows repeat the key of another (null where the key's columns aren't there)."""
    out = None
    for name, (columns, key) in contracts.items():
        rows, missing = tables[name], [c for c in columns if c not in tables[name].columns]
        counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")) if set(key) <= set(rows.columns) else rows.select(F.lit(None).cast("long").alias("n")).limit(0)
        repeated = counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")) if set(key) <= set(rows.columns) else counted.agg(F.max("n").alias("repeated"))
        one = rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(repeated).select(F.lit(name).alias("dataset"), F.lit("|".join(missing)).alias("missing"), "rows", F.col("repeated").cast("long").alias("repeated"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def provenance(declared: DataFrame, shapes: list[str], produced_by: str, steps: list[str], shape_steps: list[str], limits: list[str]) -> DataFrame:
    """(dataset_key, path, produced_by, source_class, steps, limits) of every file that a manifest declares; the ``shapes``
    among them have steps of their own."""
    texts = lambda rows: F.array(*[F.lit(x) for x in rows])
    return declared.select("dataset_key", "path", F.lit(produced_by).alias("produced_by"), F.lit("derived_bundle").alias("source_class"), F.when(F.col("dataset_key").isin(shapes), texts(shape_steps)).otherwise(texts(steps)).alias("steps"), texts(limits).alias("limits"))


def integrity_status(release: Column) -> Column:
    """Of a release list's text: verified, files_present or unverified."""
    said = lambda name: F.coalesce(F.get_json_object(release, f"$.integrity.{name}") == "true", F.lit(False))
    there = said("all_declared_files_present")
    return F.when(there & said("all_declared_file_hashes_verified"), "verified").when(there, "files_present").otherwise("unverified")


def audit_payload(view: dict, trust: DataFrame, issues: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """One row: a view's state, its trust, the failing checks (``issue``, ``affected``) and, of ``shapes`` (year), the years
    there are and how many shapes the last has, as JSON. Checks and years are few by their rules."""
    found = issues.filter("affected > 0").agg(F.array_sort(F.collect_list(F.struct("issue", "affected"))).alias("issues"))
    out, names = trust.crossJoin(found), []
    if shapes is not None:
        years = shapes.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
        out = out.crossJoin(years.agg(F.struct(F.array_sort(F.collect_list("year")).alias("years"), F.max_by("n", "year").alias("main_features")).alias("geometry_pack")))
        names = ["geometry_pack"]
    return out.select(F.to_json(F.struct(F.lit(json.dumps(view, sort_keys=True)).alias("view"), *trust.columns, "issues", *names)).alias("payload"))


def briefing(facts: Column, cautions: Column, limits: Column, most: int = 5) -> Column:
    """struct(can_say, caution, cannot_say): of each array the first ``most`` distinct texts that aren't blank."""
    tidy = lambda a: F.slice(F.array_distinct(F.filter(a, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), 1, most)
    return F.struct(tidy(facts).alias("can_say"), tidy(cautions).alias("caution"), tidy(limits).alias("cannot_say"))
