"""Queries that write files of the panel into the shared folder and read them back: scans, exports, shards, bundles, archives,
listings and summaries, each with its DuckDB SQL over the same tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources import archives as A
from ..sources import catalog as K
from ..sources import ranged
from ..sources.bundle import Bundle, read_clean_csv, write_shards
from ..sources.panel_store import shared_folder
from .registry import _kind, query

_TOT = ["election_key", "municipality_id", "province", "electors", "voters"]
_STRINGS = ", ".join(f"{c} string" for c in _TOT)
_N = "CAST(municipality_id AS BIGINT)"


def _folder(p, what: str) -> str:
    return shared_folder(p.spark, what)


@query("s01_s02_csv_scan", " SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _TOT) + " FROM tot")
def _(p):
    """Exported and scanned as text alone, in tasks."""
    K.export(p.tot.select(*_TOT), at := _folder(p, "csv"))
    return read_clean_csv(p.spark, at, _STRINGS)


@query("s03_k02_gzip_scan", " SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _TOT) + " FROM tot WHERE electors % 2 = 0")
def _(p):
    K.export(p.tot.filter("electors % 2 = 0").select(*_TOT), at := _folder(p, "gzip"), "csv.gz")
    return read_clean_csv(p.spark, at, _STRINGS)


@query("s04_k05_json_scan", " SELECT " + ", ".join(_TOT) + " FROM tot")
def _(p):
    K.export(p.tot.select(*_TOT), at := _folder(p, "json"), "json")
    return p.spark.read.schema(p.tot.select(*_TOT).schema).json(at)


@query("s06_number_fields", f" SELECT election_key, municipality_id, {_kind(2)} AS number FROM tot")
def _(p):
    """Numbers written in many ways, as text, and read as numbers."""
    p.tot.selectExpr("election_key", "municipality_id", f"{_kind(0)} AS raw").write.option("header", True).csv(at := _folder(p, "numbers"))
    return read_clean_csv(p.spark, at, "election_key string, municipality_id string, raw string").select("election_key", "municipality_id", N.safe_number(F.col("raw")).alias("number"))


def _bundle(p, files: dict[str, DataFrame], hashes: dict | None = None) -> Bundle:
    root = _folder(p, "bundle")
    for name, rows in files.items():
        write_shards(rows, f"{root}/{name}.parquet")
    manifest = json.dumps({"files": {k: f"{k}.parquet" for k in files}, "hashes": hashes or {}})
    ranged.put(p.spark.createDataFrame([("manifest.json", manifest.encode())], "path string, content binary"), root)
    return Bundle(p.spark, root)


@query("s08_s09_pruned_shards", " SELECT 'results' AS dataset, election_key, municipality_id, party_std, votes FROM std WHERE election_key = 'e1996' UNION ALL SELECT 'summary', election_key, municipality_id, first_party_std, voters FROM summ WHERE election_key = 'e1997' AND province = 'NATION_3' UNION ALL SELECT 'elections', election_key, NULL, NULL, NULL FROM (SELECT DISTINCT election_key FROM tot)")
def _(p):
    """A bundle's datasets by key; one election's shard is all that is read of its results."""
    b = _bundle(p, {"municipality_results_long": p.std.select("election_key", "municipality_id", "party_std", "votes"), "municipality_summary": p.summ.select("election_key", "municipality_id", "province", "first_party_std", "voters"), "elections_master": p.tot.select("election_key", F.col("election_year").alias("year")).distinct()})
    cols = ["election_key", "municipality_id", "party_std", "votes"]
    results = b.results_for_election("e1996").select(F.lit("results").alias("dataset"), *cols)
    summary = b.filter_summary("e1997", "NATION_3").select(F.lit("summary"), "election_key", "municipality_id", "first_party_std", "voters").toDF("dataset", *cols)
    keys = p.spark.createDataFrame([("elections", k, None, None, None) for k in b.available_elections()], results.schema)
    return results.unionByName(summary).unionByName(keys)


@query("k03_shard_index", " SELECT election_key, concat('r/election_key=', election_key) AS path, count(*) AS row_count FROM res GROUP BY 1")
def _(p):
    return K.shard_index(p.res, "election_key", "r")


@query("k04_k06_compression_report", f" SELECT CAST(sum(electors) AS BIGINT) AS original_bytes, CAST(sum(voters) FILTER (WHERE electors % 3 = 0) AS BIGINT) AS compressed_bytes, round(100 * (1 - sum(voters) FILTER (WHERE electors % 3 = 0) / CAST(sum(electors) AS DOUBLE)), 2) AS reduction_pct FROM tot")
def _(p):
    plain = p.tot.select(F.concat_ws("/", "election_key", "municipality_id").alias("path"), F.col("electors").alias("size_bytes"))
    return K.compression_report(plain, p.tot.filter("electors % 3 = 0").select("municipality_id", F.col("voters").alias("size_bytes")))


@query("p15_contract", " SELECT CAST(municipality_id AS VARCHAR) AS municipality_id, CAST(electors AS VARCHAR) AS electors, CAST(NULL AS VARCHAR) AS territorial_mode, CAST(voters AS DOUBLE) AS voters FROM tot")
def _(p):
    return K.contract(p.tot, {"municipality_id": "string", "electors": "string", "territorial_mode": "string", "voters": "double"})


@query("v11_codebook", "SELECT table_name, CAST(ordinal_position - 1 AS INT) AS place, column_name, column_name IN ('o_orderkey', 'c_custkey', 'doc_id') AS is_key FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'documents', 'labels', 'pages')", prelude=False)
def _(p):
    schemas = {t: p.spark.read.parquet(f"{p.sf_dir}/{t}.parquet").schema for t in ("orders", "customer", "documents", "labels", "pages")}
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "documents": ["doc_id"], "labels": ["doc_id"]}
    return K.codebook(p.spark, schemas, keys).select("table_name", "place", "column_name", "is_key")


_PATHS = f"SELECT concat('camera_', CAST({_N} % 60 + 1940 AS VARCHAR), CASE {_N} % 6 WHEN 0 THEN '/validated/clean/a.csv' WHEN 1 THEN '/validated/raw/entities.csv' WHEN 2 THEN '/existing/clean/b.csv' WHEN 3 THEN '_clean/c.csv' WHEN 4 THEN '/status.json' ELSE '/existing/raw/entities.csv' END) AS path FROM tot"
_LAYOUT = "bool_or(starts_with(path, concat(k, '/{0}/clean/'))) AS c_{0}, bool_or(path = concat(k, '/{0}/raw/entities.csv')) AS e_{0}".format
_PICK = lambda x: f"CASE WHEN c_validated THEN {x('validated')} WHEN c_existing THEN {x('existing')} WHEN c_flat THEN {x('flat')} END"
_CLEAN = lambda n: "concat(k, '_clean/')" if n == "flat" else f"concat(k, '/{n}/clean/')"
_RAW = lambda n: "NULL" if n == "flat" else f"CASE WHEN e_{n} THEN concat(k, '/{n}/raw/entities.csv') END"


@query("s18_election_folders", f""", f AS (SELECT DISTINCT path FROM ({_PATHS})), g AS (SELECT regexp_replace(split_part(path, '/', 1), '_clean$', '') AS k, path FROM f), h AS (SELECT k, {_LAYOUT('validated')}, {_LAYOUT('existing')}, bool_or(starts_with(path, concat(k, '_clean/'))) AS c_flat FROM g GROUP BY 1 HAVING bool_or(split_part(path, '/', 1) = k))
 SELECT k AS election_key, CAST(substr(k, 8) AS INT) AS election_year, {_PICK(_CLEAN)} AS clean, {_PICK(_RAW)} AS raw_entities FROM h""")
def _(p):
    return A.elections(p.spark.sql(_PATHS.replace("VARCHAR", "STRING").replace("FROM tot", "FROM {tot}"), tot=p.tot).distinct())


_FILES = f"SELECT DISTINCT concat(region, '/', province, '/', CAST({_N} % 30 AS VARCHAR), '.csv') AS path FROM tot"
_ASKED = f"SELECT DISTINCT CASE {_N} % 4 WHEN 0 THEN concat('./', CAST({_N} % 35 AS VARCHAR), '.csv') WHEN 1 THEN concat(province, '/', CAST({_N} % 35 AS VARCHAR), '.csv') WHEN 2 THEN concat(region, chr(92), province, chr(92), CAST({_N} % 35 AS VARCHAR), '.csv') ELSE concat(substring(province, 3, 20), '/1.csv') END AS name FROM tot"


@query("s07_path_suffixes", f", f AS ({_FILES}), a AS (SELECT name, regexp_replace(replace(name, chr(92), '/'), '^\\./', '') AS t FROM ({_ASKED})) SELECT name, min(path) AS path FROM a LEFT JOIN f ON path = t OR ends_with(path, concat('/', t)) GROUP BY 1")
def _(p):
    on = lambda sql: p.spark.sql(sql.replace("VARCHAR", "STRING").replace("FROM tot", "FROM {tot}"), tot=p.tot)
    return A.resolve(on(_FILES), on(_ASKED))


@query("s13_table_cells", f" SELECT municipality_id AS url, table_idx, rownum, column_name, cell_value, 'T' AS title FROM (SELECT municipality_id, 0 AS table_idx, rownum, unnest(['election', 'n']) AS column_name, unnest([election_key, CASE WHEN electors % 5 > 0 THEN CAST(electors AS VARCHAR) END]) AS cell_value FROM (SELECT *, CAST(row_number() OVER (PARTITION BY municipality_id ORDER BY election_key) - 1 AS INT) AS rownum FROM tot) UNION ALL SELECT DISTINCT municipality_id, 1, 0, unnest(['0', '1']), unnest([province, province]) FROM tot)")
def _(p):
    """A page a place: a table with a header, whose cells may be missing, and one without, with a cell over two columns."""
    row = F.concat(F.lit("<tr><td> "), F.col("election_key"), F.when(F.col("electors") % 5 > 0, F.concat(F.lit("<td>"), F.col("electors").cast("string"), F.lit("</td>"))).otherwise(""))
    rows = p.tot.groupBy("municipality_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("election_key", row.alias("r")))), lambda x: x["r"]), "").alias("rows"), F.min("province").alias("province"))
    html = F.concat(F.lit("<title>T</title><table><tr><th>election<th> n"), "rows", F.lit("</table><p>x<table><tr><td colspan=2>"), "province", F.lit("</table><table></table>"))
    cells = A.table_cells(rows.select(F.col("municipality_id").alias("url"), F.lit("f").alias("html_file"), html.alias("html")))
    return cells.select("url", "table_idx", "rownum", "column_name", "cell_value", "title")


@query("s16_consultations", f" SELECT municipality_id, 'camera' AS election_type, CAST(election_year AS INT) AS year, concat('r/', CAST(electors AS VARCHAR)) AS relative_path, concat(CAST(electors % 40 AS VARCHAR), '.zip') AS filename FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id, electors % 40 ORDER BY election_key) AS k FROM tot) WHERE k = 1")
def _(p):
    line = F.concat(F.lit('["Camera", "'), F.col("election_year").cast("string"), F.lit('",  "r/'), F.col("electors").cast("string"), F.lit('", "'), (F.col("electors") % 40).cast("string"), F.lit('.zip", "28/04"], ["senato", "1", "r", "s.zip", "d"]\n'))
    pages = p.tot.groupBy("municipality_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("election_key", line.alias("l")))), lambda x: x["l"]), ",").alias("page"))
    return pages.select("municipality_id", F.explode(A.consultations(F.col("page"))).alias("c")).select("municipality_id", "c.election_type", "c.year", "c.relative_path", "c.filename")


@query("s05_topology", f", d AS (SELECT DISTINCT {_N} AS n FROM tot), pts AS (SELECT n, unnest([0, 1, 2]) AS i, unnest([n % 7, n % 7 + 3, n % 7 + 3]) AS x, unnest([n % 5, n % 5, n % 5 - 2]) AS y FROM d) SELECT CAST(n AS VARCHAR) AS id, CAST(CASE WHEN n % 2 = 0 THEN i ELSE 2 - i END AS INT) AS place, CAST(x * 2 + 1 AS DOUBLE) AS x, CAST(y AS DOUBLE) * CAST(0.5 AS DOUBLE) AS y FROM pts")
def _(p):
    """An arc a place, as steps; odd places run theirs backwards."""
    n = F.col("n")
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    places = p.tot.select(F.expr(_N).alias("n")).distinct()
    arcs = places.select(n.cast("int").alias("arc"), F.array(at(n % 7, n % 5), at(F.lit(3), F.lit(0)), at(F.lit(0), F.lit(-2))).alias("points"))
    shapes = places.select(n.cast("string").alias("id"), F.lit(0).alias("ring"), F.array(F.when(n % 2 == 0, n).otherwise(-n - 1).cast("int")).alias("arcs"))
    rings = A.topology_rings(arcs, shapes, (2.0, 0.5), (1.0, 0.0))
    return rings.select("id", F.posexplode("points").alias("place", "p")).select("id", "place", "p.x", "p.y")


def _zips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["text"]:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("preferenze.csv", "no;no\n1;2\n")
                z.writestr("camera-1.txt", text.encode("cp1252"))
                z.writestr("notes.xlsx", "")
            out.append(held.getvalue())
        yield pd.DataFrame({"path": batch["path"], "content": out})


@query("s10_s12_s17_archives", " SELECT concat(municipality_id, '.zip') AS file, CAST(3 AS INT) AS entry_count, CAST(row_number() OVER (PARTITION BY municipality_id ORDER BY election_key) AS BIGINT) AS row, concat('città ', province) AS name, CAST(electors AS VARCHAR) AS electors, CAST(NULL AS VARCHAR) AS other FROM tot WHERE province = 'NATION_4'")
def _(p):
    """An archive for each place of one province: its main member, in an older encoding, read by columns."""
    line = F.concat(F.lit('"città '), "province", F.lit('" ;x; '), F.col("electors").cast("string"), F.lit("\n\n"))
    texts = p.tot.filter("province = 'NATION_4'").groupBy("municipality_id").agg(F.concat(F.lit('NAME;"Z";ELECTORS \n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("election_key", line.alias("l")))), lambda x: x["l"]), "")).alias("text"))
    ranged.put(texts.select(F.concat("municipality_id", F.lit(".zip")).alias("path"), "text").mapInPandas(_zips, "path string, content binary"), at := _folder(p, "zips"))
    stock = A.zip_inventory(p.spark, at)
    entries = stock.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(1963).alias("year"), F.lit(None).cast("string").alias("election_type"))
    rows = A.zip_rows(p.spark, at, entries, ["NAME", "ELECTORS", "OTHER"]).join(stock.select("path", "entry_count"), "path")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "entry_count", "row", F.col("NAME").alias("name"), F.col("ELECTORS").alias("electors"), F.col("OTHER").alias("other"))


_CSV = "concat('k,\"v\nw\"', chr(10), string_agg(concat(election_key, ',', electors, chr(10)), '' ORDER BY election_key))"


@query("v06_v07_file_summaries", f""", t AS (SELECT concat(municipality_id, '.csv') AS path, {_CSV} AS content, count(*) AS n FROM tot WHERE province = 'NATION_4' GROUP BY municipality_id), j AS (SELECT concat(municipality_id, '.json') AS path, concat('{{"entries": [', string_agg(CAST(electors AS VARCHAR), ', ' ORDER BY election_key), ']}}') AS content, count(*) AS n FROM tot WHERE province = 'NATION_5' GROUP BY municipality_id)
 SELECT path, 'csv' AS kind, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256, n AS row_count, 'k|v w' AS columns, CAST(NULL AS BIGINT) AS entries, CASE WHEN ends_with(path, '7.csv') THEN 'mismatch' ELSE 'ok' END AS status FROM t UNION ALL SELECT path, 'json', CAST(strlen(content) AS BIGINT), sha256(content), NULL, NULL, n, 'ok' FROM j""")
def _(p):
    """Files of each place of two provinces: digest, size, rows, header and entries of each, and whether it is what a manifest declares."""
    joined = lambda line, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("election_key", line.alias("l")))), lambda x: x["l"]), sep)
    of = lambda province: p.tot.filter(F.col("province") == province).groupBy("municipality_id")
    e = F.col("electors").cast("string")
    tables = of("NATION_4").agg(F.concat(F.lit('k,"v\nw"\n'), joined(F.concat("election_key", F.lit(","), e, F.lit("\n")), "")).alias("content")).select(F.concat("municipality_id", F.lit(".csv")).alias("path"), "content")
    lists = of("NATION_5").agg(F.concat(F.lit('{"entries": ['), joined(e, ", "), F.lit("]}")).alias("content")).select(F.concat("municipality_id", F.lit(".json")).alias("path"), "content")
    files = tables.unionByName(lists)
    ranged.put(files.withColumn("content", F.col("content").cast("binary")), at := _folder(p, "files"))
    want = F.sha2(F.when(F.endswith("path", F.lit("7.csv")), F.lit("other")).otherwise(F.col("content")), 256)
    hashes = {r.path: {"path": r.path, "sha256": r.want} for r in files.select("path", want.alias("want")).collect()}  # a manifest, which is one document
    ranged.put(p.spark.createDataFrame([("manifest.json", json.dumps({"hashes": hashes}).encode())], "path string, content binary"), at)
    status = Bundle(p.spark, at).verify_integrity().withColumnRenamed("dataset_key", "path")
    seen = K.file_summaries(p.spark, at).withColumn("path", F.element_at(F.split("path", "/"), -1)).join(status, "path")
    return seen.select("path", "kind", "size_bytes", "sha256", "row_count", F.replace(F.array_join("columns", "|"), F.lit("\n"), F.lit(" ")).alias("columns"), F.col("counts.n").alias("entries"), "status")


@query("v12_product_entries", ", c AS (SELECT concat(election_key, '-', municipality_id) AS product_key, province AS d, region AS e FROM tot), f AS (SELECT province AS dataset_key, max(electors) AS n FROM tot GROUP BY 1) SELECT product_key, 'primary' AS role, d AS dataset_key, n AS row_count FROM c JOIN f ON f.dataset_key = d")
def _(p):
    """Of a product's datasets those that have a file: here provinces, not regions."""
    catalog = p.tot.select(F.concat_ws("-", "election_key", "municipality_id").alias("product_key"), F.col("province").alias("primary_dataset_key"), F.col("region").alias("companion_dataset_key"), F.array(F.lit("")).alias("extra_dataset_keys"))
    files = p.tot.groupBy(F.col("province").alias("dataset_key")).agg(F.max("electors").alias("row_count")).select("dataset_key", "dataset_key", F.lit("csv").alias("kind"), F.lit(1).alias("size_bytes"), "row_count", F.lit("").alias("sha256")).toDF("dataset_key", "path", "kind", "size_bytes", "row_count", "sha256")
    return K.product_entries(catalog, files).select("product_key", "role", "dataset_key", "row_count")


@query("v11_contract_checks", " SELECT 'results' AS dataset, 'vote_share' AS missing, count(*) AS rows, count(*) - count(DISTINCT (election_key, municipality_id, party_std)) AS repeated FROM res UNION ALL SELECT 'summary', '', count(*), count(*) - count(DISTINCT (election_key, municipality_id)) FROM summ UNION ALL SELECT 'places', 'geometry_id', count(*), NULL FROM tot")
def _(p):
    """Results repeat a party where it has several raw names; places lack their key's column."""
    contracts = {"results": (["election_key", "party_std", "vote_share"], ["election_key", "municipality_id", "party_std"]), "summary": (["election_key", "turnout_pct"], ["election_key", "municipality_id"]), "places": (["municipality_id", "geometry_id"], ["geometry_id"])}
    return K.contract_checks({"results": p.res, "summary": p.summ, "places": p.tot}, contracts)


@query("v11_provenance", " SELECT DISTINCT municipality_id AS dataset_key, concat('d/', province, '.csv') AS path, 'build' AS produced_by, 'derived_bundle' AS source_class, CASE WHEN municipality_id IN ('7', '42') THEN 'shapes' ELSE 'read|written' END AS steps, 'part' AS limits FROM tot")
def _(p):
    declared = p.tot.select(F.col("municipality_id").alias("dataset_key"), F.concat(F.lit("d/"), "province", F.lit(".csv")).alias("path")).distinct()
    return K.provenance(declared, ["7", "42"], "build", ["read", "written"], ["shapes"], ["part"]).withColumns({c: F.array_join(c, "|") for c in ("steps", "limits")})


@query("v17_integrity_status", " SELECT election_key, municipality_id, CASE WHEN electors % 3 = 0 AND electors % 2 = 0 THEN 'verified' WHEN electors % 3 = 0 THEN 'files_present' ELSE 'unverified' END AS status FROM tot")
def _(p):
    said = lambda name, k: F.concat(F.lit(f'"{name}": '), F.when(F.col("electors") % k == 0, "true").otherwise("false"))
    whole = F.concat(F.lit('{"integrity": {'), said("all_declared_files_present", 3), F.lit(", "), said("all_declared_file_hashes_verified", 2), F.lit("}}"))
    return p.tot.select("election_key", "municipality_id", K.integrity_status(F.when(F.col("electors") % 3 == 2, "no json").otherwise(whole)).alias("status"))


@query("v14_audit_payload", """, y AS (SELECT election_year AS year, count(*) AS n FROM tot GROUP BY 1), f AS (SELECT count(*) FILTER (WHERE electors % 4 = 0) AS a, count(*) FILTER (WHERE electors < 0) AS b, count(*) FILTER (WHERE voters % 7 = 0) AS c, count(*) % 100 AS t FROM tot)
 SELECT concat('{"view":"{\\"metric\\": \\"turnout\\"}","trust_score":', t, ',"issues":[{"issue":"a","affected":', a, '},{"issue":"c","affected":', c, '}],"geometry_pack":{"years":[', (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM y), '],"main_features":', (SELECT arg_max(n, year) FROM y), '}}') AS payload FROM f""")
def _(p):
    n = lambda name, cond: p.tot.filter(cond).agg(F.count(F.lit(1)).alias("affected")).select(F.lit(name).alias("issue"), "affected")
    issues = n("c", "voters % 7 = 0").unionByName(n("b", "electors < 0")).unionByName(n("a", "electors % 4 = 0"))
    return K.audit_payload({"metric": "turnout"}, p.tot.agg((F.count(F.lit(1)) % 100).alias("trust_score")), issues, p.tot.select(F.col("election_year").alias("year")))
