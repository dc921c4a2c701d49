"""Checks of published JSON documents, as rows: catalogues, guides, recipes, shards, release lists, statuses.

All tables have a ``bundle`` column, so many bundles are checked at once: ``docs`` (bundle, path, text), ``declared`` (bundle,
dataset_key, path), ``files`` (bundle, path, size_bytes). Documents that aren't there break no rule of their own; texts that
are no JSON count as empty ones. A finding is (bundle, issue, severity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import LEAKS
from .panel_store import stored

# Dataset, the array that must hold entries, how many at least, and what it is called when it doesn't.
ARRAYS = [
    ("geometry", "features", 1, "geometry:placeholder_or_missing", "error"), ("dataProducts", "products", 1, "data_products:empty_products", "error"), ("productCatalog", "products", 1, "product_catalog:empty_products", "error"),
    ("datasetContracts", "contracts", 1, "dataset_contracts:empty", "error"), ("provenance", "entries", 5, "provenance:too_short", "error"), ("researchRecipes", "recipes", 1, "research_recipes:empty", "error"),
    ("siteGuides", "layers", 1, "site_guides:empty_layers", "error"), ("siteGuides", "faq", 1, "site_guides:empty_faq", "error"), ("archiveBundleGapReport", "rows", 1, "archive_gap_report:empty", "error"),
]
SHARDS = {"municipalitySummaryByElectionIndex": "summary_shards", "municipalityResultsLongByElectionIndex": "result_shards"}
REQUIRED = [
    "geometryPack", "geometryPackFull", "geometryFull", "provinceGeometryFull", "dataProducts", "productCatalog", "datasetContracts", "provenance", "releaseManifest", "researchRecipes", "siteGuides", *SHARDS,
    "archiveBundleGapReport", "webGeometryReport", "webCompressionReport",
]
# Metadata that must not name local folders, and the file that says how to cite the bundle.
METADATA, CITATION, RELEASE, EXTRA = ["manifest", "releaseManifest", "webGeometryReport", "productCatalog"], "CITATION.cff", "releaseManifest", "productManifest:"


def _get(path: str) -> Column:
    return F.get_json_object("text", path)


def _size(path: str, of: Column | str = "text") -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(of, path)), F.lit(0))


def _many(table: DataFrame) -> DataFrame:
    """A table to be joined by its rows in order: its columns are few and alike, so its size is guessed far too low to tell if
    it may be broadcast."""
    return table.hint("merge")


def _found(rows: DataFrame, issue: Column | str, severity: str = "error") -> DataFrame:
    return rows.select("bundle", (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"), F.lit(severity).alias("severity"))


def array_checks(known: DataFrame) -> DataFrame:
    """Documents whose array holds too little. ``known``: bundle, dataset_key, text."""
    hit = [F.when((F.col("dataset_key") == k) & (_size(f"$.{a}") < n), F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for k, a, n, issue, severity in ARRAYS]
    flaw = F.when((F.col("dataset_key") == "qualityReport") & (_get("$.derived_validations.has_errors") == "true"), F.struct(F.lit("derived_validations:has_errors").alias("issue"), F.lit("warning").alias("severity")))
    return known.select("bundle", F.inline(F.array_compact(F.array(*hit, flaw))))


def product_checks(known: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Clients' entry points, and every product's manifest with its datasets and inventory."""
    there = files.select("bundle", "path", F.lit(True).alias("there"))
    entries = known.filter("dataset_key = 'dataProducts'").select("bundle", F.explode(F.from_json(_get("$.clients"), "array<struct<entrypoint:string>>")).alias("c")).select("bundle", F.col("c.entrypoint").alias("path")).filter("path <> ''")
    out = _found(entries.join(_many(there), ["bundle", "path"], "left_anti"), F.concat(F.lit("data_products:missing_client:"), "path"))
    products = known.filter("dataset_key = 'productCatalog'").select("bundle", F.explode(F.from_json(_get("$.products"), "array<struct<product_key:string,manifest_path:string>>")).alias("p")).select("bundle", "p.product_key", F.col("p.manifest_path").alias("path"))
    seen = products.join(_many(there), ["bundle", "path"], "left").join(_many(docs), ["bundle", "path"], "left")
    say = lambda name: F.concat(F.lit(f"{name}:"), F.coalesce("product_key", F.lit("None")))
    out = out.unionByName(_found(seen.filter("there is null"), say("product_catalog:missing_manifest")))
    out = out.unionByName(_found(seen.filter(F.col("there") & (_size("$.datasets") == 0)), say("product_manifest:empty_datasets")))
    return out.unionByName(_found(seen.filter(F.col("there") & (_size("$.inventory.entries") == 0)), say("product_manifest:empty_inventory")))


def shard_checks(known: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """Shard indices that are empty, or name files that aren't there (the first ``most`` by key)."""
    kind = F.create_map(*[F.lit(x) for pair in SHARDS.items() for x in pair])[F.col("dataset_key")]
    rows = known.filter(F.col("dataset_key").isin(*SHARDS)).select("bundle", kind.alias("kind"), F.from_json(_get("$.shards"), "map<string,string>").alias("shards"))
    empty = _found(rows.filter(F.coalesce(F.size("shards"), F.lit(0)) <= 0), F.concat("kind", F.lit(":empty")), "warning")
    missing = rows.select("bundle", "kind", F.explode("shards").alias("key", "path")).join(_many(files.select("bundle", "path")), ["bundle", "path"], "left_anti")
    first = missing.groupBy("bundle", "kind").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # keys of one index
    return empty.unionByName(_found(first, F.concat("kind", F.lit(":missing_files:"), F.array_join(F.slice("keys", 1, most), ","))))


def release_checks(known: DataFrame, declared: DataFrame) -> DataFrame:
    """The release list: not empty, all files said to be present, and its scope that of the manifest, with or without the list
    itself, or that without it and product manifests more."""
    entries = F.coalesce(F.json_object_keys(_get("$.file_entries")), F.array().cast("array<string>"))
    rows = known.filter(F.col("dataset_key") == RELEASE).select("bundle", entries.alias("has"), (_get("$.integrity.all_declared_files_present") == "true").alias("all"))
    want = declared.groupBy("bundle").agg(F.collect_set("dataset_key").alias("want"))  # keys of one manifest
    rows = rows.join(_many(want), "bundle")
    less, same = F.array_except("want", F.array(F.lit(RELEASE))), lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    extra = F.filter("has", lambda k: k.startswith(EXTRA))
    fits = same(F.col("has"), F.col("want")) | same(F.col("has"), less) | same(F.col("has"), F.array_union(less, extra))
    hit = [(F.size("has") == 0, "release_manifest:empty"), (~F.coalesce("all", F.lit(False)), "release_manifest:declared_files_missing"), (~fits, "release_manifest:file_scope_mismatch")]
    return rows.select("bundle", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in hit]))).alias("issue"), F.lit("error").alias("severity"))


def file_rules(declared: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """Keys and files a manifest lacks, shapes that aren't smaller than the full ones, packs that are the same, local paths in
    metadata, no citation, folders of compiled code."""
    bundles = declared.select("bundle").distinct()
    wanted = bundles.select("bundle", F.explode(F.array(*[F.lit(k) for k in REQUIRED])).alias("dataset_key")).join(_many(declared), ["bundle", "dataset_key"], "left")
    blank = F.coalesce("path", F.lit("")) == ""
    out = _found(wanted.filter(blank), F.concat(F.lit("manifest:missing_"), "dataset_key"))
    out = out.unionByName(_found(wanted.filter(~blank).join(_many(files.select("bundle", "path")), ["bundle", "path"], "left_anti"), F.concat(F.lit("manifest:missing_file_for_"), "dataset_key")))
    of = lambda key, table, *cols: declared.filter(F.col("dataset_key") == key).join(_many(table), ["bundle", "path"]).select("bundle", *cols)
    sizes = of("geometry", files, F.col("size_bytes").alias("web")).join(_many(of("geometryFull", files, F.col("size_bytes").alias("full"))), "bundle")
    out = out.unionByName(_found(sizes.filter("web >= full"), "geometry_web:not_smaller_than_full"))
    pack = lambda key, name: known.filter(F.col("dataset_key") == key).select("bundle", F.try_parse_json("text").cast("string").alias(name))
    packs = pack("geometryPack", "web").join(_many(pack("geometryPackFull", "full")), "bundle")
    out = out.unionByName(_found(packs.filter("web = full"), "geometry_pack:web_and_full_identical"))
    leaks = known.filter(F.col("dataset_key").isin(*METADATA)).filter(F.col("text").rlike(LEAKS)).groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(_found(leaks, F.concat(F.lit("metadata_path_leak:"), F.col("n").cast("string"))))
    out = out.unionByName(_found(bundles.join(_many(files.filter(F.col("path") == CITATION)), "bundle", "left_anti"), "citation:missing_cff"))
    folders = files.select("bundle", F.regexp_extract("path", r"^(.*?__pycache__)/", 1).alias("at")).filter("at <> ''").distinct().groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(_found(folders, F.concat(F.lit("pycache_shipped:"), F.col("n").cast("string"))))


def document_checks(docs: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """All findings of all bundles. Documents meet their keys once, as every check reads some of them."""
    known = stored(declared.join(_many(docs), ["bundle", "path"]), "known-documents")
    return reduce(DataFrame.unionByName, [array_checks(known), product_checks(known, docs, files), shard_checks(known, files), release_checks(known, declared), file_rules(declared, known, files)])


def statuses(docs: DataFrame) -> DataFrame:
    """(election_key, election_year, status, is_complete, comparability_notes, source_notes) from each election folder's
    ``status.json`` of ``docs`` (path, text). Texts that are no JSON say nothing: status unknown, the rest empty."""
    key = F.split_part("path", F.lit("/"), F.lit(1))
    rows = docs.filter(F.col("path").rlike(r"^camera_\d{4}[^/]*/status\.json$") & ~key.rlike("_(clean|raw)$"))
    said = lambda name: F.coalesce(_get(f"$.{name}"), F.lit(""))
    return rows.select(
        key.alias("election_key"), F.regexp_extract(key, r"(\d{4})", 1).cast("int").alias("election_year"), F.coalesce(_get("$.status"), F.lit("unknown")).alias("status"), F.when(_get("$.plausible").isin("true", "false"), _get("$.plausible")).otherwise("").alias("is_complete"),
        F.coalesce(F.nullif(said("warning"), F.lit("")), said("error")).alias("comparability_notes"), F.concat(F.lit("strategy="), said("strategy"), F.lit("; trial="), said("trial_name")).alias("source_notes"),
    )
