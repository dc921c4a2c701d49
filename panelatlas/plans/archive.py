"""Archive, name, catalogue and shape queries over raw rows derived from the panel, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as L
from ..functions import text as X
from ..functions.taxonomy import VIEW_V1, classify
from ..operators import borders as B
from ..operators import geo as G
from ..operators.fuzzy import fuzzy_match
from ..sources import archives as A
from ..sources import catalog as K
from ..sources import documents as D
from ..sources.panel_store import stored
from .ingest import _KEY, TURNOUT, made
from .registry import LATEST, query

# Each fixture is a select list that both engines run, over a table of the panel.
_N = "CAST(municipality_id AS BIGINT)"
NAME = f"""CASE {_N} % 9 WHEN 0 THEN concat('Parte del comune di ', province) WHEN 1 THEN concat(province, ' / ', region) WHEN 2 THEN concat('SAN GIOVANNI IN ', province, ' E D''', region)
 WHEN 3 THEN concat('Forl', 'Ã¬', ' & ', province) WHEN 4 THEN NULL WHEN 5 THEN concat('  "L''', province, ' DELLA VALLE"  ') WHEN 6 THEN concat('Sant’', region, '-', municipality_id) WHEN 7 THEN '' ELSE concat(province, ' DI ', region) END"""
PAGE = f"""concat(CASE {_N} % 4 WHEN 0 THEN concat('Provincia ', province, '; ') WHEN 1 THEN concat('(', region, ') Comune ') WHEN 2 THEN 'collegio di luino ' ELSE '' END, 'Comune   ', lower(province), CASE WHEN electors % 3 = 0 THEN '' ELSE
 concat(' Elettori  ', CAST(electors AS STRING), ' VOTANTI ', CAST(voters AS STRING), '  ', CAST(electors % 100 AS STRING), ',5 % Schede bianche ', CAST(electors % 7 AS STRING), '.', ' schede nulle 1.000') END)"""
TOKENS = {"primary_label": "CASE votes % 6 WHEN 0 THEN 'TOTALE' WHEN 1 THEN 'Liste' WHEN 2 THEN party_std WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'x' END", "secondary_label": "CASE votes % 5 WHEN 0 THEN 'LISTE' WHEN 1 THEN '' WHEN 2 THEN party_std WHEN 3 THEN 'Totale coalizione' ELSE 'candidati' END", "tertiary_label": "CASE WHEN votes % 2 = 0 THEN ' Bianche ' END", "n": "CASE votes % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE votes END"}
_VAR = lambda sql: sql.replace("AS STRING", "AS VARCHAR")


def _fixed(t: str) -> str:
    for old, new in L.MOJIBAKE.items():
        t = f"replace({t}, '{old}', '{new}')"
    return t


def _token(t: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({t})), '[^a-z0-9]+', ' ', 'g'))"


def _key(t: str) -> str:
    plain = rf"regexp_replace(trim({_fixed(f'coalesce({t}, {chr(39)*2})')}), '(?i)^parte d(?:el|i) comune(?: di)?\s+', '')"
    return _token(f"translate(replace({plain}, '&', ' e '), '''’`', '   ')")


def _title(t: str) -> str:
    """Title case of ``t`` in DuckDB: a letter is a capital unless a letter stands before it."""
    return f"array_to_string([CASE WHEN i = 1 OR regexp_matches(substr({t}, CAST(i - 1 AS BIGINT), 1), '[^\\p{{L}}]') THEN upper(substr({t}, CAST(i AS BIGINT), 1)) ELSE lower(substr({t}, CAST(i AS BIGINT), 1)) END FOR i IN range(1, length({t}) + 1)], '')"


_NAMES = f", raw AS (SELECT election_key, municipality_id, {NAME} AS name FROM tot)"


def _names(p):
    return p.tot.selectExpr(*_KEY, f"{NAME} AS name")


@query("f16_f18_lookup_key", _NAMES + f" SELECT election_key, municipality_id, {_fixed("coalesce(name, '')")} AS repaired, {_key('name')} AS lookup_key FROM raw")
def _(p):
    return _names(p).select(*_KEY, L.repaired(F.col("name")).alias("repaired"), L.lookup_key(F.col("name")).alias("lookup_key"))


ALIASES = {"europe": "old continent", "asia": "Far / East"}


@query("f17_lookup_keys", _NAMES + f""", cut AS (SELECT *, {_key('name')} AS k, {_fixed("coalesce(name, '')")} AS whole FROM raw),
 f AS (SELECT election_key, municipality_id, ord, key FROM (SELECT election_key, municipality_id, 0 AS ord, k AS key FROM cut UNION ALL SELECT election_key, municipality_id, i, {_key("list_extract(string_split(whole, '/'), i)")} FROM (SELECT *, unnest(range(1, len(string_split(whole, '/')) + 1)) AS i FROM cut WHERE contains(whole, '/'))
  UNION ALL SELECT election_key, municipality_id, 1000, CASE k WHEN 'europe' THEN 'old continent' ELSE 'far east' END FROM cut WHERE k IN ('europe', 'asia'))),
 pairs AS (SELECT election_key, municipality_id, ord * 2 AS o, key FROM f WHERE key <> '' UNION ALL SELECT election_key, municipality_id, ord * 2 + 1, replace(key, ' ', '') FROM f WHERE length(replace(key, ' ', '')) >= 5),
 firsts AS (SELECT election_key, municipality_id, key, min(o) AS o FROM pairs GROUP BY ALL)
 SELECT r.election_key, r.municipality_id, coalesce(x.keys, '') AS lookup_keys FROM raw r LEFT JOIN (SELECT election_key, municipality_id, string_agg(key, '|' ORDER BY o) AS keys FROM firsts GROUP BY ALL) x ON x.election_key = r.election_key AND x.municipality_id = r.municipality_id""")
def _(p):
    return _names(p).select(*_KEY, F.array_join(L.lookup_keys(F.col("name"), ALIASES), "|").alias("lookup_keys"))


def _small(t: str) -> str:
    for word in L.PARTICLES:
        t = f"replace({t}, ' {word} ', ' {word.lower()} ')"
    for word in L.ELIDED:
        old, new = (f" {x}".replace("'", "''") for x in (word, word.lower()))
        t = f"replace({t}, '{old}', '{new}')"
    return t


@query("f19_smart_title", _NAMES + rf""", c AS (SELECT DISTINCT name, regexp_replace(trim({_fixed("coalesce(name, '')")}), '^"+|"+$', '', 'g') AS t FROM raw), d AS (SELECT name, t, {_small(_title('t'))} AS u FROM c),
 e AS (SELECT name, CASE WHEN regexp_matches(t, '\p{{Ll}}') THEN t WHEN regexp_matches(u, '^[LD]''') THEN concat(substr(u, 1, 2), upper(substr(u, 3, 1)), lower(substr(u, 4))) ELSE u END AS v FROM d)
 SELECT DISTINCT name, trim(regexp_replace(v, '\s+', ' ', 'g')) AS title FROM e""")
def _(p):
    return _names(p).select("name").distinct().select("name", L.smart_title(F.col("name")).alias("title"))


_PAGES = f", raw AS (SELECT election_key, municipality_id, {_VAR(PAGE)} AS page FROM tot)"
HINTS, KNOWN = {"collegio di luino": "Varese"}, {"france": "Paris"}


@query("f22_place_names", _PAGES + rf""", m AS (SELECT *, trim(regexp_replace(page, '\s+', ' ', 'g')) AS flat FROM raw), x AS (SELECT *, trim(regexp_extract(flat, '(?i)Comune\s+(.+)$', 1)) AS place, regexp_extract(page, 'Provincia\s+([A-ZÀ-Ü''\- ]+)', 1) AS a, regexp_extract(page, '\(([A-ZÀ-Ü''\- ]+)\)\s*Comune', 1) AS b FROM m),
 y AS (SELECT *, trim(regexp_replace(CASE WHEN a <> '' THEN a ELSE b END, '\s+', ' ', 'g')) AS q FROM x)
 SELECT election_key, municipality_id, {_title('place')} AS municipality, CASE WHEN q <> '' THEN {_title('q')} WHEN regexp_matches(page, '(?i)collegio di luino') THEN 'Varese' WHEN {_token('place')} = 'france' THEN 'Paris' ELSE '' END AS province FROM y""")
def _(p):
    named = p.tot.selectExpr(*_KEY, f"{PAGE} AS page").withColumn("municipality", L.municipality_name(F.col("page")))
    return named.select(*_KEY, "municipality", L.province_named(F.col("page"), F.col("municipality"), HINTS, KNOWN).alias("province"))


@query("f25_turnout_figures", _PAGES + r", m AS (SELECT *, regexp_replace(page, '\s+', ' ', 'g') AS flat FROM raw) SELECT election_key, municipality_id, " + ", ".join(f"regexp_extract(flat, '(?i){pattern}', 1) AS {name}" for name, pattern in L.TURNOUT_TEXT.items()) + " FROM m")
def _(p):
    return p.tot.selectExpr(*_KEY, f"{PAGE} AS page").select(*_KEY, *L.turnout_figures(F.col("page")))


_ROWS = ", raw AS (SELECT election_key, municipality_id, party_raw, " + ", ".join(f"{sql} AS {c}" for c, sql in TOKENS.items()) + " FROM res)"


@query("p11_row_kinds", _ROWS + f""", t AS (SELECT *, {_token("coalesce(primary_label, '')")} AS a, {_token("coalesce(secondary_label, '')")} AS b, coalesce(nullif(secondary_label, ''), nullif(tertiary_label, ''), nullif(primary_label, '')) AS label FROM raw), k AS (SELECT *, CASE WHEN a IN ('totali', 'totale', 'liste') AND b IN ('', 'liste') AND n IS NOT NULL THEN 'list_total'
  WHEN b IN ('totale coalizione', 'coalizione totale') OR (a = 'totale' AND b IN ('candidati', 'candidate')) OR (a <> '' AND a = b) OR label IS NULL OR n IS NULL OR n <= 0 OR {_token('label')} IN ('bianche', 'totali', 'totale', 'liste', 'candidati', 'candidate') THEN 'skip' ELSE 'party' END AS kind FROM t)
 SELECT election_key, municipality_id, party_raw, kind, CASE WHEN kind = 'party' THEN trim(label) END AS label FROM k""")
def _(p):
    rows = p.res.selectExpr(*_KEY, "party_raw", *[f"{sql} AS {c}" for c, sql in TOKENS.items()])
    kind = L.row_kind(F.col("primary_label"), F.col("secondary_label"), F.col("tertiary_label"), F.col("n"), ["bianche"])
    return rows.select(*_KEY, "party_raw", kind.alias("k")).select(*_KEY, "party_raw", "k.kind", "k.label")


URL = f"concat('http://x/', province, CASE {_N} % 3 WHEN 0 THEN '-lev3' WHEN 1 THEN '-lev4' ELSE '' END, '?a=', CAST({_N} % 50 AS STRING), CASE WHEN {_N} % 2 = 0 THEN '&levsut0=3' ELSE '' END)"


@query("p17_archive_urls", f""", raw AS (SELECT {_N} * 10000 + election_year AS n, {_VAR(URL)} AS url FROM tot), f AS (SELECT *, regexp_replace(url, '&levsut0=3', '') AS fixed_url FROM raw WHERE contains(url, '-lev3') OR contains(url, '-lev4')) SELECT fixed_url, min(n) AS n, arg_min(url, n) AS url FROM f GROUP BY 1""")
def _(p):
    rows = p.tot.selectExpr(f"{_N} * 10000 + election_year AS n", f"{URL} AS url")
    return A.archive_urls(rows, X.canonical_url(F.col("url")), "n").select("fixed_url", "n", "url")


# Members whose names the rules ask for, in capitals or with other letters around them.
_R = ["_".join(r.parts) for r in A.MEMBER_RULES]
MEMBERS = f"concat('Preferenze.txt|x.pdf|', CASE {_N} % 6 WHEN 0 THEN 'a.TXT|{_R[4].title()}.csv' WHEN 1 THEN 'b.csv|{_R[0].upper()}.txt|x_{_R[1].title()}.csv' WHEN 2 THEN '{_R[5]}9.txt|{_R[3]}.txt' WHEN 3 THEN '' WHEN 4 THEN 'z.txt|{_R[6]}.csv' ELSE 'estero.csv|c.csv' END)"
_RULES = " ".join("WHEN " + " AND ".join([*([f"y = {r.year}"] if r.year else []), *([f"k = '{r.kind}'"] if r.kind else []), *[f"contains(l, '{x}')" for x in r.parts]]) + f" THEN {i}" for i, r in enumerate(A.MEMBER_RULES))
YEARS, KINDS = "CASE WHEN election_year % 3 = 0 THEN 2018 WHEN election_year % 3 = 1 THEN 2022 ELSE election_year END", "CASE WHEN electors % 4 = 0 THEN ' Assemblea_Costituente' WHEN electors % 4 = 1 THEN NULL ELSE 'camera' END"


@query("s10_primary_member", f""", raw AS (SELECT election_key, municipality_id, {YEARS} AS y, lower(trim(coalesce({KINDS}, 'camera'))) AS k, string_split({MEMBERS}, '|') AS ms FROM tot), m AS (SELECT *, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM raw),
 g AS (SELECT *, lower(m) AS l FROM m WHERE regexp_matches(lower(m), '\\.(txt|csv)$') AND NOT regexp_matches(lower(m), 'preferenze|candidati|estero|vaosta')),
 s AS (SELECT *, CASE {_RULES} ELSE 99 END AS o FROM g),
 b AS (SELECT election_key, municipality_id, arg_min(m, o * 100 + i) AS member FROM s GROUP BY ALL) SELECT election_key, municipality_id, member FROM raw LEFT JOIN b USING (election_key, municipality_id)""")
def _(p):
    rows = p.tot.selectExpr(*_KEY, f"{YEARS} AS y", f"{KINDS} AS k", f"{MEMBERS} AS ms")
    return rows.select(*_KEY, A.primary_member(F.split("ms", r"\|"), F.col("y"), F.col("k")).alias("member"))


SIDES = f"{_N} % 400 AS arc, municipality_id AS id, CASE WHEN {_N} % 400 < 200 THEN 'p' WHEN {_N} % 400 < 250 THEN NULL ELSE province END AS province, CASE WHEN {_N} % 400 < 300 THEN 'r' ELSE region END AS region"


@query("g06_border_kinds", f", s AS (SELECT DISTINCT {SIDES} FROM tot WHERE {_N} < 800 OR {_N} % 3 = 0) SELECT arc, CASE WHEN count(DISTINCT id) < 2 THEN 'outline' WHEN count(DISTINCT coalesce(region, '')) > 1 THEN 'region' WHEN count(DISTINCT coalesce(province, '')) > 1 THEN 'province' ELSE 'municipality' END AS kind FROM s GROUP BY 1")
def _(p):
    return G.border_kinds(p.tot.filter(f"{_N} < 800 OR {_N} % 3 = 0").selectExpr(*SIDES.split(", ", 2)[:2], *["CASE" + x for x in SIDES.split(", CASE")[1:]]))


@query("g08_layer_names", "SELECT c.c_custkey AS id, n.n_name AS province_name, r.r_name AS region_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey", prelude=False)
def _(p):
    t = lambda name: p.spark.read.parquet(f"{p.sf_dir}/{name}.parquet")
    n = t("nation").select(F.col("n_nationkey").alias("province_code"), F.col("n_name").alias("province_name"), F.col("n_regionkey").alias("region_code"))
    places = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("province_code")).join(n.drop("province_name"), "province_code", "left")
    return G.with_layer_names(places, n, t("region").select(F.col("r_regionkey").alias("region_code"), F.col("r_name").alias("region_name"))).select("id", "province_name", "region_name")


JSONS = """CASE electors % 6 WHEN 0 THEN concat('{"features": [', electors, ', 1]}') WHEN 1 THEN '{"objects": {"a": {"geometries": [1, 2, 3]}, "b": {}}}' WHEN 2 THEN concat('{"products": [], "entries": [1], "n": ', electors, '}') WHEN 3 THEN '{"shards": {"x": "1", "y": "2"}}' WHEN 4 THEN '[1]' ELSE '{"entries": [4]}' END"""


@query("r04_json_counts", """ SELECT election_key, municipality_id, CASE electors % 6 WHEN 0 THEN 'feature_count' WHEN 1 THEN 'feature_count' WHEN 2 THEN 'product_count' WHEN 3 THEN 'shard_count' WHEN 5 THEN 'entry_count' END AS name, CAST(CASE electors % 6 WHEN 0 THEN json_array_length(concat('{"features": [', electors, ', 1]}'), '$.features') WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 5 THEN 1 END AS BIGINT) AS n FROM tot""")
def _(p):
    return p.tot.select(*_KEY, K.json_counts(F.expr(JSONS)).alias("c")).select(*_KEY, "c.name", "c.n")


CATALOG = {"product_key": "concat(election_key, '-', municipality_id)", "primary_dataset_key": "CASE WHEN electors % 3 = 0 THEN '' ELSE province END", "companion_dataset_key": "CASE WHEN electors % 2 = 0 THEN region END"}


@query("r05_v12_inventory", ", c AS (SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in CATALOG.items()) + """, CASE electors % 4 WHEN 0 THEN NULL WHEN 1 THEN [region, NULL, province] ELSE [''] END AS extra FROM tot) SELECT product_key, 'primary' AS role, primary_dataset_key AS dataset_key FROM c WHERE primary_dataset_key <> ''
 UNION ALL SELECT product_key, 'companion', companion_dataset_key FROM c WHERE companion_dataset_key <> '' UNION ALL SELECT product_key, 'extra', k FROM (SELECT product_key, unnest(extra) AS k FROM c) WHERE k <> ''""")
def _(p):
    return K.inventory(p.tot.selectExpr(*[f"{sql} AS {c}" for c, sql in CATALOG.items()], "CASE electors % 4 WHEN 0 THEN NULL WHEN 1 THEN array(region, NULL, province) ELSE array('') END AS extra_dataset_keys"))


@query("v08_row_checks", f", t AS ({TURNOUT}), s AS (SELECT *, CASE WHEN electors % 3 <> 0 THEN 'x' WHEN electors % 2 = 0 THEN ' ' END AS leader FROM t), e AS (SELECT DISTINCT election_key, CASE WHEN election_year % 2 = 0 THEN ' Completed' ELSE 'partial' END AS status, CASE WHEN election_year = 1995 THEN 'from /home/u' END AS note FROM tot UNION ALL SELECT 'e1900', 'completed', 'C:\\x')" + """
 SELECT 'vote_share_range' AS issue, 'warning' AS severity, count(*) FILTER (votes - 5 < CAST(-0.01 AS DOUBLE) OR votes - 5 > CAST(100.01 AS DOUBLE)) AS affected FROM res UNION ALL SELECT 'completeness_semantics', 'error', CAST(coalesce(sum(CASE WHEN trim(coalesce(leader, '')) = '' AND contains(coalesce(comparability_note, ''), 'party_rows_checked') THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(leader, '')) = '' AND NOT contains(coalesce(completeness_flag, ''), 'turnout_only') THEN 1 ELSE 0 END), 0) AS BIGINT) FROM s
 UNION ALL SELECT 'elections_master_path_leak', 'error', count(*) FILTER (note IS NOT NULL) FROM e UNION ALL SELECT 'elections_master_completed_without_rows', 'error', count(*) FROM e WHERE lower(trim(status)) = 'completed' AND election_key NOT IN (SELECT election_key FROM tot)""")
def _(p):
    e = p.tot.selectExpr("election_key", "CASE WHEN election_year % 2 = 0 THEN ' Completed' ELSE 'partial' END AS status", "CASE WHEN election_year = 1995 THEN 'from /home/u' END AS note").distinct()
    e = e.unionByName(p.spark.createDataFrame([("e1900", "completed", "C:\\x")], e.schema))
    summ = made(p, TURNOUT).withColumn("first_party_std", F.when(F.col("electors") % 3 != 0, "x").when(F.col("electors") % 2 == 0, " "))
    return K.row_checks(e, summ, p.res.select((F.col("votes") - 5).alias("vote_share")))


# A bundle for each place, with documents that break a rule where a remainder of its electors says so.
_DECLARED = {"geometry": "g.json", "geometryFull": "gf.json", "geometryPack": "p.json", "geometryPackFull": "pf.json", "dataProducts": "d.json", "productCatalog": "c.json", "provenance": "v.json", "releaseManifest": "r.json", "municipalitySummaryByElectionIndex": "i.json", "manifest": "m.json", "siteGuides": "s.json", "qualityReport": "q.json", "datasetContracts": "none.json"}
_SCOPE = ", ".join(f'"{k}": 1' for k in _DECLARED if k != "releaseManifest")
_DOCS = {
    "g.json": "CASE WHEN electors % 2 = 0 THEN '{\"features\": []}' ELSE '{\"features\": [1]}' END", "d.json": "'{\"products\": [1], \"clients\": [{\"entrypoint\": \"c.py\"}, {\"entrypoint\": \"\"}]}'", "v.json": "CASE WHEN electors % 8 >= 5 THEN '{\"entries\": [1, 1, 1, 1, 1]}' ELSE '{\"entries\": [1]}' END",
    "c.json": "CASE WHEN electors % 7 = 0 THEN '{\"products\": []}' ELSE '{\"products\": [{\"product_key\": \"a\", \"manifest_path\": \"pa.json\"}, {\"product_key\": \"b\", \"manifest_path\": \"pb.json\"}]}' END",
    "pa.json": "CASE WHEN electors % 11 = 0 THEN '{\"datasets\": []}' ELSE '{\"datasets\": [1], \"inventory\": {\"entries\": [1]}}' END", "pb.json": "CASE WHEN electors % 13 <> 0 THEN '{\"datasets\": [1], \"inventory\": {\"entries\": [1]}}' END",
    "r.json": "concat('{\"file_entries\": {', CASE WHEN electors % 17 = 0 THEN '' WHEN electors % 3 = 0 THEN '\"x\": 1' ELSE '" + _SCOPE + ", \"productManifest:a\": 1' END, '}, \"integrity\": {\"all_declared_files_present\": ', CASE WHEN electors % 4 = 0 THEN 'false' ELSE 'true' END, '}}')",
    "i.json": "CASE WHEN electors % 19 = 0 THEN '{\"shards\": {}}' ELSE '{\"shards\": {\"e2\": \"s2.csv\", \"e1\": \"s1.csv\"}}' END", "p.json": "'{\"a\": 1, \"b\": [2]}'", "pf.json": "CASE WHEN electors % 9 = 0 THEN '{\"b\": [2], \"a\": 1}' ELSE '{\"a\": 2}' END",
    "m.json": "CASE WHEN electors % 10 = 0 THEN '{\"at\": \"/home/u\"}' ELSE '{}' END", "s.json": "CASE WHEN electors % 5 = 1 THEN 'no json' ELSE '{\"layers\": [1], \"faq\": [2]}' END", "q.json": "CASE WHEN electors % 5 = 2 THEN '{\"derived_validations\": {\"has_errors\": true}}' ELSE '{}' END", "gf.json": "'{\"features\": [1]}'",
}
_OTHER_FILES = {"c.py": "electors % 5 <> 0", "s1.csv": "electors % 6 <> 0", "s2.csv": "electors % 6 > 1", "CITATION.cff": "electors % 12 <> 0", "x/__pycache__/a.pyc": "electors % 14 = 0", "x/__pycache__/b.pyc": "electors % 14 = 0", "y/__pycache__/b.pyc": "electors % 28 = 0"}
_FINDINGS = [
    ("'geometry:placeholder_or_missing'", "electors % 2 = 0"), ("'data_products:missing_client:c.py'", "electors % 5 = 0"), ("'provenance:too_short'", "electors % 8 < 5"), ("'product_catalog:empty_products'", "electors % 7 = 0"), ("'product_manifest:empty_datasets:a'", "electors % 7 <> 0 AND electors % 11 = 0"), ("'product_manifest:empty_inventory:a'", "electors % 7 <> 0 AND electors % 11 = 0"), ("'product_catalog:missing_manifest:b'", "electors % 7 <> 0 AND electors % 13 = 0"),
    ("'release_manifest:empty'", "electors % 17 = 0"), ("'release_manifest:declared_files_missing'", "electors % 4 = 0"), ("'release_manifest:file_scope_mismatch'", "electors % 17 = 0 OR electors % 3 = 0"), ("CASE WHEN electors % 6 = 0 THEN 'summary_shards:missing_files:e1,e2' ELSE 'summary_shards:missing_files:e2' END", "electors % 19 <> 0 AND electors % 6 < 2"),
    ("'geometry_pack:web_and_full_identical'", "electors % 9 = 0"), ("'metadata_path_leak:1'", "electors % 10 = 0"), ("'site_guides:empty_layers'", "electors % 5 = 1"), ("'site_guides:empty_faq'", "electors % 5 = 1"), ("'citation:missing_cff'", "electors % 12 = 0"), ("CASE WHEN electors % 28 = 0 THEN 'pycache_shipped:2' ELSE 'pycache_shipped:1' END", "electors % 14 = 0"), ("'geometry_web:not_smaller_than_full'", "electors % 3 > 0"),
    ("'manifest:missing_file_for_datasetContracts'", "TRUE"), *((f"'manifest:missing_{k}'", "TRUE") for k in D.REQUIRED if k not in _DECLARED),
]


@query("v08_document_checks", " " + " UNION ALL ".join(f"SELECT municipality_id AS bundle, {issue} AS issue, 'error' AS severity FROM tot WHERE election_key = '{LATEST}' AND ({cond})" for issue, cond in _FINDINGS) + "".join(f" UNION ALL SELECT municipality_id, '{issue}', 'warning' FROM tot WHERE election_key = '{LATEST}' AND {cond}" for issue, cond in (("summary_shards:empty", "electors % 19 = 0"), ("derived_validations:has_errors", "electors % 5 = 2"))))
def _(p):
    places = p.tot.filter(F.col("election_key") == LATEST).withColumn("bundle", F.col("municipality_id"))
    docs = places.select("bundle", F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.expr(v).alias("text")) for k, v in _DOCS.items()])).alias("d")).select("bundle", "d.*").filter("text IS NOT NULL")
    declared = places.select("bundle", F.explode(F.array(*[F.struct(F.lit(k).alias("dataset_key"), F.lit(v).alias("path")) for k, v in _DECLARED.items()])).alias("d")).select("bundle", "d.*")
    there = [*[F.when(F.expr(v).isNotNull(), F.lit(k)) for k, v in _DOCS.items()], *[F.when(F.expr(cond), F.lit(k)) for k, cond in _OTHER_FILES.items()]]
    size = F.when(F.col("path") == "g.json", 10 + F.col("electors") % 3).otherwise(11).cast("long").alias("size_bytes")  # against 11 of the full shapes
    files = places.select("bundle", "electors", F.explode(F.array_compact(F.array(*there))).alias("path")).select("bundle", "path", size)
    return D.document_checks(docs, declared, files)


STATUS = f"CASE {_N} % 5 WHEN 0 THEN concat('{{\"status\": \"completed\", \"plausible\": true, \"strategy\": \"s', {_N}, '\", \"trial_name\": \"t\"}}') WHEN 1 THEN '{{\"plausible\": false, \"warning\": \"\", \"error\": \"e\"}}' WHEN 2 THEN 'no json' WHEN 3 THEN '{{\"status\": \"partial\", \"warning\": \"w\"}}' ELSE '{{}}' END"


@query("s19_statuses", f""", st AS (SELECT concat('camera_', CAST(1000 + {_N} AS VARCHAR)) AS election_key, {_N} AS n FROM (SELECT DISTINCT municipality_id FROM tot) WHERE {_N} % 3 > 0) SELECT election_key, CAST(1000 + n AS INT) AS election_year, CASE n % 5 WHEN 0 THEN 'completed' WHEN 3 THEN 'partial' ELSE 'unknown' END AS status, CASE n % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS is_complete,
 CASE n % 5 WHEN 1 THEN 'e' WHEN 3 THEN 'w' ELSE '' END AS comparability_notes, CASE n % 5 WHEN 0 THEN concat('strategy=s', n, '; trial=t') ELSE 'strategy=; trial=' END AS source_notes FROM st WHERE n < 9000""")
def _(p):
    places = p.tot.select("municipality_id").distinct().filter(f"{_N} < 9000")
    path = f"concat('camera_', CAST(1000 + {_N} AS STRING), CASE WHEN {_N} % 3 = 0 THEN '_raw' ELSE '' END, '/status.json')"
    return D.statuses(places.selectExpr(f"{path} AS path", f"{STATUS} AS text"))


_SAID = "CASE WHEN electors % 3 = 0 THEN '' WHEN electors % 3 = 1 THEN NULL ELSE province END"


@query("v15_briefing", f", x AS (SELECT election_key, municipality_id, [region, province, region, {_SAID}, 'a', 'b', 'c', 'd'] AS f, [{_SAID}] AS g FROM tot) " + ", ".join(["SELECT election_key, municipality_id", *[f"array_to_string([k FOR k, i IN {c} IF trim(coalesce(k, '')) <> '' AND list_position({c}, k) = i][:5], '|') AS {n}" for c, n in (("f", "can_say"), ("g", "caution"))]]) + " FROM x")
def _(p):
    b = K.briefing(F.expr(f"array(region, province, region, {_SAID}, 'a', 'b', 'c', 'd')"), F.expr(f"array({_SAID})"), F.array(F.lit("")))
    return p.tot.select(*_KEY, b.alias("b")).select(*_KEY, F.array_join("b.can_say", "|").alias("can_say"), F.array_join("b.caution", "|").alias("caution"))


@query("f34_notes", f", t AS ({TURNOUT}), x AS (SELECT election_key, municipality_id, [trim(k) FOR k IN string_split(coalesce(comparability_note, ''), '|')] AS f FROM t) SELECT election_key, municipality_id, array_to_string([k FOR k, i IN f IF k <> '' AND list_position(f, k) = i], '|') AS note_tokens FROM x")
def _(p):
    return made(p, TURNOUT).select(*_KEY, F.array_join(X.notes(F.col("comparability_note")), "|").alias("note_tokens"))


PARTIES = """CASE votes % 12 WHEN 0 THEN 'DC' WHEN 1 THEN 'Partito Democratico' WHEN 2 THEN 'LEGA NORD' WHEN 3 THEN 'Sviluppo-Legalità' WHEN 4 THEN 'P.C.I.' WHEN 5 THEN 'lista verde' WHEN 6 THEN 'Movimento 5 Stelle' WHEN 7 THEN 'SVP' WHEN 8 THEN NULL WHEN 9 THEN 'L''Ulivo' WHEN 10 THEN 'Azione nuova' ELSE party_raw END"""


@query("f30_party_view", f", l AS (SELECT DISTINCT {PARTIES} AS label FROM res) SELECT label, CASE " + " ".join("WHEN regexp_matches(trim(label), '(?i){}') THEN '{}'".format(r[0].replace("'", "''"), r[2].replace("'", "''")) for r in VIEW_V1) + " ELSE 'altro' END AS party_family_by_rule FROM l")
def _(p):
    return classify(p.res.selectExpr(f"{PARTIES} AS label").distinct(), "label", VIEW_V1).select("label", "party_family_by_rule")


@query("j12_fuzzy_names", None)
def _(p):
    """Names with a letter too many against the municipalities' own; ratios are Python's, so SQL has no equal."""
    places = p.tot.selectExpr("municipality_id AS place_id", "concat(lower(province), ' ', municipality_id) AS name", "region").distinct()
    names = places.selectExpr("place_id AS name_id", "concat(substring(name, 1, 3), 'x', substring(name, 4)) AS name", "region")
    return fuzzy_match(names, places)


@query("g01_simplified", None)
def _(p):
    """A closed track for each municipality, its corners from the counts of its elections."""
    point = F.struct(F.col("election_year").cast("double").alias("x"), F.col("electors").cast("double").alias("y"))
    rings = p.tot.groupBy("municipality_id").agg(F.array_sort(F.collect_list(point)).alias("ring"))  # a corner an election
    return G.simplified(rings.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1))), 5.0)


def country(places: DataFrame, width: int = 40, steps: int = 8) -> DataFrame:
    """A map of a cell for each place (``no``, ``wobble``), row by row: (id, ring, points). Each side has ``steps`` corners
    between its ends, off the straight line by what the side's own place says, so neighbours share them all."""
    at = lambda k: (k % width, (k / width).cast("long"))
    x, y = at(F.col("no"))

    def side(cx, cy, across: bool):
        wobble = lambda i: F.pmod(cx * 31 + cy * 17 + i * i * 7, F.lit(9)).cast("double") / 10 - 0.4
        along = lambda i: i.cast("double") * (10.0 / (steps + 1))
        point = lambda i: F.struct((cx * 10.0 + (along(i) if across else wobble(i))).alias("x"), (cy * 10.0 + (wobble(i) if across else along(i))).alias("y"))
        ends = F.struct((cx * 10.0).alias("x"), (cy * 10.0).alias("y"))
        return F.concat(F.array(ends), F.transform(F.sequence(F.lit(1), F.lit(steps)), point))

    corner = lambda cx, cy: F.array(F.struct((cx * 10.0).alias("x"), (cy * 10.0).alias("y")))
    back = lambda a, end: F.concat(end, F.reverse(F.slice(a, 2, steps)))
    ring = F.concat(side(x, y, True), side(x + 1, y, False), back(side(x, y + 1, True), corner(x + 1, y + 1)), back(side(x, y, False), corner(x, y + 1)))
    return places.select(F.col("municipality_id").alias("id"), F.lit(0).alias("ring"), ring.alias("points"))


@query("g01_shared_borders", f", pl AS (SELECT DISTINCT {_N} AS n FROM tot), un AS (SELECT count(*) AS shapes FROM pl), sh AS (SELECT (SELECT count(*) FROM pl a JOIN pl b ON b.n = a.n + 1 AND a.n % 40 <> 39) + (SELECT count(*) FROM pl a JOIN pl b ON b.n = a.n + 40) AS inner_borders) SELECT shapes, inner_borders, CAST(0 AS BIGINT) AS torn FROM un, sh")
def _(p):
    """How many borders two places share before, and how many sides of those borders the simplified places don't share."""
    places = p.tot.select("municipality_id").distinct().withColumn("no", F.expr(_N))
    shapes = country(places)
    used = stored(B.arcs(shapes), "arcs")
    owners = used.groupBy("arc_id").agg(F.count(F.lit(1)).alias("n"), F.any_value("arc").alias("points"))
    once = lambda rows: B.border_uses(rows).filter("uses = 1").agg(F.count(F.lit(1)).alias("once"))
    thin = B.simplified_arcs(used, 0.3)
    outline = G.simplified(owners.filter("n = 1").withColumnRenamed("points", "ring"), 0.3, closed=False)
    outer = outline.agg(F.coalesce(F.sum(F.size("ring") - 1), F.lit(0)).alias("outer"))
    # A border of two cells is cut where a third meets it, so it is counted by the places it parts.
    pairs = used.join(owners.filter("n = 2").select("arc_id"), "arc_id").groupBy("arc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b").distinct()
    n = places.agg(F.count(F.lit(1)).alias("shapes")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("inner_borders")))  # one row each
    return n.crossJoin(once(thin)).crossJoin(outer).select("shapes", "inner_borders", F.abs(F.col("once") - F.col("outer")).alias("torn"))
