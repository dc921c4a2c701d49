"""Ingest, quality and view queries over raw rows derived from the panel, each with its DuckDB SQL.

The panel has no faults of its own, so each query reads a fixture with some: SQL of one table that both engines run
(``made``), whose odd rows follow from remainders of the counts. The operator is written twice, here as DataFrame code and
as SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.names import municipality_name
from ..operators import ingest as I
from ..operators import panel as P
from ..operators import quality as Q
from ..operators.resolve import alias_rows
from .registry import _CELLS, _OWN, _PCT, _VOL, LATEST, Panel, _cells, query, r6

TURNOUT = """SELECT election_key, election_year, municipality_id, province, region, CASE WHEN electors % 5 = 0 THEN NULL WHEN electors % 7 = 0 THEN voters - 1 ELSE electors END AS electors,
 CASE WHEN electors % 11 = 0 THEN NULL ELSE voters END AS voters, CASE WHEN electors % 3 = 0 THEN NULL ELSE CAST(electors % 60 + 30 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS turnout_pct,
 CASE WHEN electors % 13 = 0 THEN voters + 2 ELSE valid_votes END AS valid_votes, valid_votes AS total_votes, CASE WHEN electors % 4 = 0 THEN NULL WHEN electors % 4 = 1 THEN 'a|b| a' WHEN electors % 4 = 2 THEN 'turnout_from_clean' ELSE 'party_rows_checked|no_party_rows_detected' END AS comparability_note,
 CASE WHEN electors % 9 = 0 THEN electors % 17 END AS invalid_total, CASE WHEN electors % 2 = 0 THEN electors % 3 END AS contested, CASE WHEN electors % 8 = 1 THEN electors % 5 END AS null_ballots, CASE WHEN electors % 6 = 1 THEN 0 END AS blank,
 CASE WHEN electors % 6 = 0 THEN 'Partial_Clean_Ingest' WHEN electors % 6 = 1 THEN NULL WHEN electors % 6 = 2 THEN 'unknown' WHEN electors % 6 = 3 THEN ' clean_ingest_turnout_only' WHEN electors % 6 = 4 THEN 'clean_ingest_party_results_checked' ELSE '' END AS completeness_flag,
 CASE WHEN electors % 10 = 0 THEN 'Soppresso' WHEN electors % 10 = 1 THEN 'fuso in altro' WHEN electors % 10 = 2 THEN 'Stòrico' ELSE 'current' END AS territorial_status, CASE WHEN electors % 12 = 0 THEN 'harmonized' WHEN electors % 12 = 1 THEN NULL ELSE 'historical' END AS territorial_mode,
 CASE WHEN electors % 14 = 0 THEN 'split' END AS lineage_note, electors % 15 <> 0 AS has_geometry FROM tot"""
RAWS = """SELECT election_key, election_year, municipality_id, province, party_std, party_raw, CAST(votes AS BIGINT) AS votes, votes * 7919 % 1000003 AS ord, concat('s', CAST(votes % 3 AS STRING)) AS segment, CASE WHEN votes % 4 = 0 THEN NULL ELSE CAST(votes % 100 AS DOUBLE) END AS vote_share_raw,
 CASE WHEN votes % 5 = 0 THEN CAST(160 AS DOUBLE) ELSE CAST(votes % 90 AS DOUBLE) END AS vote_share, concat('v', CAST(votes AS STRING)) AS votes_raw_text, CASE WHEN votes % 3 = 0 THEN 'n' ELSE '' END AS comparability_note FROM res"""


def made(p: Panel, sql: str) -> DataFrame:
    """A fixture: the select list of ``sql`` over its table, ``tot`` or ``res``."""
    select, table = sql.removeprefix("SELECT ").rsplit(" FROM ", 1)
    parts, depth, at = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(select[at:i])
            at = i + 1
    return getattr(p, table).selectExpr(*[x.strip() for x in [*parts, select[at:]]])


_T, _R = f", t AS ({TURNOUT})", f", raws AS ({RAWS.replace('AS STRING', 'AS VARCHAR')})"
_KEY = ["election_key", "municipality_id"]


@query("f06_fill_counts", _T + """ SELECT election_key, municipality_id, e2 AS electors, CASE WHEN turnout_pct > 0 AND e2 <> 0 AND voters IS NULL AND electors <> 0 THEN CAST(round_even(electors * turnout_pct / 100, 0) AS BIGINT) ELSE voters END AS voters FROM
 (SELECT *, CASE WHEN turnout_pct > 0 AND voters <> 0 AND (electors IS NULL OR electors < voters) THEN CAST(round_even(voters / (turnout_pct / 100), 0) AS BIGINT) ELSE electors END AS e2 FROM t)""")
def _(p):
    return I.fill_counts(made(p, TURNOUT)).select(*_KEY, "electors", "voters")


@query("f13_nullify_anomalous", _T + """ SELECT election_key, municipality_id, CASE WHEN NOT bad THEN electors END AS electors, CASE WHEN NOT bad THEN voters END AS voters, CASE WHEN NOT bad THEN turnout_pct END AS turnout_pct, CASE WHEN bad THEN valid_votes ELSE total_votes END AS total_votes,
 CASE WHEN bad THEN CASE WHEN TRUE THEN concat_ws('|', CASE comparability_note WHEN 'a|b| a' THEN 'a|b' ELSE comparability_note END, 'official_turnout_counts_anomalous_nullified') END ELSE comparability_note END AS comparability_note FROM (SELECT *, coalesce(electors < voters, FALSE) OR coalesce(valid_votes > voters, FALSE) AS bad FROM t)""")
def _(p):
    return I.nullify_anomalous(made(p, TURNOUT)).select(*_KEY, "electors", "voters", "turnout_pct", "total_votes", "comparability_note")


@query("f14_valid_from_invalid", _T + " SELECT election_key, municipality_id, invalid, CASE WHEN voters >= invalid THEN voters - invalid END AS valid_votes FROM (SELECT *, coalesce(invalid_total, nullif(coalesce(contested, 0) + coalesce(null_ballots, 0) + coalesce(blank, 0), 0)) AS invalid FROM t)")
def _(p):
    return I.valid_from_invalid(made(p, TURNOUT)).select(*_KEY, "invalid", "valid_votes")


@query("f07_share_denominator", _R + """, c AS (SELECT election_key, municipality_id, CAST(sum(votes) AS BIGINT) AS s, max(vote_share_raw) AS r FROM raws GROUP BY ALL), d AS (SELECT c.*, CASE WHEN t.electors % 3 = 0 THEN t.valid_votes * 3 WHEN t.electors % 3 = 1 THEN NULL ELSE t.valid_votes END AS valid, t.voters, CASE WHEN t.electors % 5 = 0 THEN 0 ELSE s END AS party_sum FROM c JOIN tot t USING (election_key, municipality_id))
 SELECT election_key, municipality_id, CAST(CASE WHEN valid > 0 AND party_sum >= CAST(0.5 AS DOUBLE) * valid AND party_sum <= CAST(1.05 AS DOUBLE) * valid THEN valid WHEN party_sum > 0 THEN party_sum WHEN voters > 0 AND r IS NOT NULL THEN voters END AS DOUBLE) AS denominator FROM d""")
def _(p):
    c = made(p, RAWS).groupBy(*_KEY).agg(F.sum("votes").alias("s"), F.max("vote_share_raw").alias("r")).join(p.tot, _KEY)
    valid = F.when(F.col("electors") % 3 == 0, F.col("valid_votes") * 3).when(F.col("electors") % 3 != 1, F.col("valid_votes"))
    return c.select(*_KEY, N.share_denominator(valid, F.when(F.col("electors") % 5 == 0, 0).otherwise(F.col("s")), F.col("voters"), F.col("r"))["denominator"].alias("denominator"))


@query("f08_repair_magnitude", _R + """, m AS (SELECT *, votes * CAST(9 AS DOUBLE) AS d, CASE WHEN votes % 7 = 0 THEN CAST(200 AS DOUBLE) ELSE vote_share_raw END AS s FROM raws), e AS (SELECT *, s * d / 100 AS aim FROM m), o AS (SELECT *, unnest([1, 10, 100, 1000]) AS k FROM e), b AS (SELECT election_key, municipality_id, party_raw, any_value(votes) AS votes, any_value(s) AS s, any_value(aim) AS aim, min(abs(votes * k - aim) / aim) AS best, arg_min(k, abs(votes * k - aim) / aim * 1e6 + k * 1e-9) AS kb FROM o GROUP BY ALL)
 SELECT election_key, municipality_id, party_raw, CASE WHEN aim > 0 AND s BETWEEN 0 AND 100.01 AND best < abs(votes - aim) / aim - CAST(0.02 AS DOUBLE) THEN CAST(votes * kb AS BIGINT) ELSE votes END AS votes FROM b""")
def _(p):
    s = F.when(F.col("votes") % 7 == 0, F.lit(200.0)).otherwise(F.col("vote_share_raw"))
    return made(p, RAWS).select(*_KEY, "party_raw", N.repair_magnitude(F.col("votes"), s, F.col("votes") * F.lit(9.0)).alias("votes"))


@query("f35_completeness_flag", _T + """ SELECT election_key, municipality_id, concat(CASE WHEN contains(coalesce(nullif(completeness_flag, ''), 'partial_clean_ingest'), 'partial') THEN 'partial_' ELSE '' END, CASE WHEN n > 0 AND first_party_std IS NOT NULL THEN 'clean_ingest_party_results_checked' ELSE 'clean_ingest_turnout_only' END) AS flag
 FROM t JOIN (SELECT election_key, municipality_id, first_party_std, electors % 4 AS n FROM summ) USING (election_key, municipality_id)""")
def _(p):
    t = made(p, TURNOUT).select(*_KEY, "completeness_flag").join(p.summ.select(*_KEY, "first_party_std", (F.col("electors") % 4).alias("n")), _KEY)
    return t.select(*_KEY, I.completeness_flag(F.col("completeness_flag"), F.col("n"), F.col("first_party_std")).alias("flag"))


@query("a22_a23_collapse", _R + " SELECT election_key, municipality_id, party_std, CAST(coalesce(sum(CASE WHEN votes % 2 = 0 THEN votes END), 0) AS BIGINT) AS votes, CAST(sum(CASE WHEN votes % 2 = 0 THEN votes END) AS BIGINT) AS votes_or_null, arg_min(votes_raw_text, ord) AS votes_raw_text, round(avg(vote_share_raw), 6) AS vote_share_raw FROM (SELECT * FROM raws WHERE votes % 19 <> 0) GROUP BY ALL")
def _(p):
    rows = made(p, RAWS).withColumn("party_std", F.when(F.col("votes") % 19 != 0, F.col("party_std"))).withColumn("votes", F.when(F.col("votes") % 2 == 0, F.col("votes")))
    known = rows.dropna(subset=["party_std"]).groupBy(*_KEY, "party_std").agg(F.sum("votes").alias("votes_or_null"))
    return I.collapse_rows(rows, [*_KEY, "party_std"]).join(known, [*_KEY, "party_std"]).select(*_KEY, "party_std", "votes", "votes_or_null", "votes_raw_text", *r6("vote_share_raw"))


@query("a24_collapse_implausible", _R + """, bad AS (SELECT election_key, municipality_id FROM raws GROUP BY ALL HAVING count(*) > count(DISTINCT party_std) AND (max(vote_share) > 100.01 OR sum(vote_share) > 150))
 SELECT election_key, municipality_id, party_std, party_raw, votes, vote_share_raw, comparability_note FROM raws ANTI JOIN bad USING (election_key, municipality_id)
 UNION ALL SELECT election_key, municipality_id, party_std, first(party_raw ORDER BY votes DESC, coalesce(vote_share_raw, -1) DESC, party_raw), max(votes), max(vote_share_raw), 'party_duplicates_collapsed_max' FROM raws JOIN bad USING (election_key, municipality_id) GROUP BY ALL""")
def _(p):
    return I.collapse_implausible(made(p, RAWS)).select(*_KEY, "party_std", "party_raw", "votes", "vote_share_raw", "comparability_note")


@query("a25_segment_totals", _R + " SELECT election_key, municipality_id, CAST(nullif(sum(v), 0) AS BIGINT) AS votes, CAST(nullif(sum(o), 0) AS BIGINT) AS ord FROM (SELECT election_key, municipality_id, segment, max(votes) AS v, max(ord) AS o FROM raws GROUP BY ALL) GROUP BY ALL")
def _(p):
    return I.segment_totals(made(p, RAWS), ["votes", "ord"])


@query("a26_party_votes", _R + " SELECT election_key, municipality_id, party_std, CAST(sum(votes) AS BIGINT) AS votes, first(party_raw ORDER BY ord, party_raw) AS party_raw, string_agg(DISTINCT party_raw, '|' ORDER BY party_raw) AS all_raw FROM raws WHERE votes - 10 > -5 GROUP BY ALL")
def _(p):
    rows = made(p, RAWS).filter("votes - 10 > -5").withColumn("ord", F.struct("ord", "party_raw"))
    return I.party_votes(rows)


@query("a28_valid_or_party_sum", ", c AS (SELECT election_key, municipality_id, CAST(sum(votes) AS BIGINT) AS s, max(votes) AS top FROM std GROUP BY ALL), v AS (SELECT c.*, CASE WHEN electors % 4 = 0 THEN NULL WHEN electors % 4 = 1 THEN top - 1 WHEN electors % 4 = 2 THEN CAST(floor(s * CAST(0.4 AS DOUBLE)) AS BIGINT) ELSE valid_votes END AS valid FROM c JOIN tot USING (election_key, municipality_id)) SELECT election_key, municipality_id, CASE WHEN valid IS NULL OR valid < top OR valid < floor(CAST(0.5 AS DOUBLE) * s) THEN s ELSE valid END AS valid_votes FROM v")
def _(p):
    c = p.std.groupBy(*_KEY).agg(F.sum("votes").alias("s"), F.max("votes").alias("top")).join(p.tot, _KEY)
    k = F.col("electors") % 4
    valid = F.when(k == 0, F.lit(None).cast("long")).when(k == 1, F.col("top") - 1).when(k == 2, F.floor(F.col("s") * 0.4)).otherwise(F.col("valid_votes"))
    return c.select(*_KEY, I.valid_or_party_sum(valid, F.col("s"), F.col("top")).alias("valid_votes"))


_NAMED = ", nm AS (SELECT municipality_id, election_year, concat(province, ' ', CAST(electors % 3 AS VARCHAR)) AS municipality_name FROM tot)"


def _named(p: Panel) -> DataFrame:
    return p.tot.select("election_key", "municipality_id", "election_year", "province", F.concat_ws(" ", "province", (F.col("electors") % 3).cast("string")).alias("municipality_name"))


@query("a29_canonical_places", _NAMED + """, f AS (SELECT municipality_id, municipality_name, min(election_year) AS since FROM nm GROUP BY ALL), c AS (SELECT municipality_id, arg_max(municipality_name, election_year) AS cur FROM nm GROUP BY 1)
 SELECT municipality_id, any_value(cur) AS municipality_name, string_agg(municipality_name, '|' ORDER BY since, municipality_name) AS alias_names, first(municipality_name ORDER BY since, municipality_name) FILTER (WHERE municipality_name <> cur) AS name_historical FROM f JOIN c USING (municipality_id) GROUP BY 1""")
def _(p):
    return I.canonical_places(_named(p))


_TWO_NAMES = "CASE WHEN CAST(municipality_id AS BIGINT) % 5 = 0 THEN concat('Comune ', lower(province)) WHEN CAST(municipality_id AS BIGINT) % 5 = 1 THEN ' NaN ' ELSE concat(province, ' ', municipality_id, ' ') END AS name_current", "CASE CAST(municipality_id AS BIGINT) % 4 WHEN 0 THEN concat('x comune  ', lower(province)) WHEN 1 THEN concat(province, ' ', municipality_id) WHEN 2 THEN concat('N', lower(substring(province, 2, 20))) END AS name_historical"


@query("a30_parties_and_aliases", f""", nm AS (SELECT DISTINCT municipality_id, {", ".join(_TWO_NAMES)} FROM tot), td AS (SELECT municipality_id, nullif(nullif(trim(name_current), 'NaN'), '') AS c, nullif(trim(name_historical), '') AS h FROM nm),
 al AS (SELECT municipality_id, c AS alias, 'current_name' AS kind, 0 AS pos FROM td UNION ALL SELECT municipality_id, concat('N', substring(c, 9)), 'normalized_name', 1 FROM td WHERE c LIKE 'Comune %' UNION ALL SELECT municipality_id, h, 'historical_name', 2 FROM td UNION ALL SELECT municipality_id, concat('N', substring(h, 12)), 'normalized_name', 3 FROM td WHERE h LIKE 'x comune %')
 SELECT DISTINCT party_std, party_raw, 'party' AS kind FROM res UNION ALL SELECT municipality_id, alias, arg_min(kind, pos) FROM al WHERE alias IS NOT NULL GROUP BY municipality_id, alias""")
def _(p):
    parties = p.res.select("party_std", "party_raw").distinct().withColumn("kind", F.lit("party"))
    places = p.tot.selectExpr("municipality_id", *_TWO_NAMES).distinct()
    return parties.unionByName(alias_rows(places, municipality_name).select(F.col("municipality_id").alias("party_std"), F.col("alias").alias("party_raw"), F.col("alias_type").alias("kind")))


@query("a31_coverage_score", f"SELECT CAST(round_even((CAST(0.7 AS DOUBLE) * s / t + CAST(0.3 AS DOUBLE) * r / t) * 100, 0) AS BIGINT) AS coverage FROM (SELECT (SELECT count(DISTINCT election_key) FROM tot WHERE election_year <> 1997) AS s, (SELECT count(DISTINCT election_key) FROM res WHERE election_key <> '{LATEST}' AND election_year <> 1996) AS r, (SELECT count(DISTINCT election_key) FROM tot) AS t)")
def _(p):
    return I.coverage_score(p.tot.filter("election_year <> 1997"), p.res.filter(f"election_key <> '{LATEST}' and election_year <> 1996"), p.tot)


_GAP = f""", ex AS (SELECT election_key, count(DISTINCT municipality_id) + CASE WHEN election_year % 3 = 0 THEN 0 WHEN election_year % 3 = 1 THEN 3 ELSE 900 END AS expected, CASE WHEN election_year % 2 = 0 THEN 5 END AS unresolved FROM tot GROUP BY election_key, election_year), fo AS (SELECT election_key, count(DISTINCT municipality_id) AS found FROM tot WHERE election_key <> '{LATEST}' GROUP BY 1),
 g AS (SELECT election_key, expected, coalesce(found, 0) AS found, unresolved FROM ex LEFT JOIN fo USING (election_key)), rep AS (SELECT election_key, expected, found, round_even(CAST(found AS DOUBLE) / expected, 4) AS ratio, concat_ws('|', CASE WHEN expected > 0 AND found = 0 THEN 'bundle_empty_archive_nonempty' END, CASE WHEN expected > 0 AND found < expected THEN 'bundle_below_archive_positive_tables' END, CASE WHEN expected > 0 AND CAST(found AS DOUBLE) / expected < CAST(0.9 AS DOUBLE) THEN 'bundle_severely_partial_vs_archive' END, CASE WHEN unresolved > 0 THEN 'bundle_rows_without_geometry_join' END) AS flags FROM g)"""


def _gaps(p: Panel) -> DataFrame:
    more = F.when(F.col("election_year") % 3 == 0, 0).when(F.col("election_year") % 3 == 1, 3).otherwise(900)
    expected = p.tot.groupBy("election_key", "election_year").agg(F.count_distinct("municipality_id").alias("c")).select("election_key", (F.col("c") + more).alias("expected"), F.when(F.col("election_year") % 2 == 0, 5).alias("unresolved"))
    return I.gap_report(expected, p.tot.filter(F.col("election_key") != LATEST))


@query("a32_j20_gap_report", _GAP + " SELECT * FROM rep")
def _(p):
    return _gaps(p)


@query("a32_v17_gap_counts", _GAP + " SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM rep UNION ALL SELECT 'with_any_flags' FROM rep WHERE flags <> '') WHERE flag <> '' GROUP BY 1")
def _(p):
    return I.gap_counts(_gaps(p))


_EAV = "SELECT concat('u', municipality_id) AS url, election_year % 2 AS table_idx, CAST(votes % 50 AS INT) AS rownum, party_std AS column_name, CASE WHEN votes % 50 = 7 THEN 'Schede NON  valide' WHEN votes % 50 = 8 THEN 'schede bianche' WHEN votes % 50 = 9 THEN 'nan' WHEN votes % 50 = 10 THEN ' ' ELSE CAST(votes AS STRING) END AS cell_value FROM res"


@query("a33_invalid_from_tables", f", e AS ({_EAV.replace('AS STRING', 'AS VARCHAR')})" + """, w AS (SELECT url, table_idx, rownum, string_agg(cell_value, ' ' ORDER BY column_name, cell_value) AS text FROM e WHERE trim(cell_value) <> '' AND lower(cell_value) <> 'nan' GROUP BY ALL), l AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low, table_idx * 1000 + rownum AS k FROM w)
 SELECT url, arg_max(text, k) FILTER (WHERE contains(low, 'non valide')) AS invalid_text, arg_min(text, k) FILTER (WHERE contains(low, 'bianche') AND NOT contains(low, 'non valide')) AS blank_text FROM l GROUP BY 1""")
def _(p):
    return I.invalid_from_tables(made(p, _EAV))


@query("v09_v10_v16_registry", f", el AS (SELECT election_key, CASE WHEN election_year % 2 = 0 THEN 'completed' ELSE 'empty' END AS status, 'true' AS is_complete FROM tot GROUP BY election_key, election_year UNION ALL SELECT 'e1900', 'completed', 'true'), c AS (SELECT election_key, status, is_complete, (SELECT count(*) FROM tot t WHERE t.election_key = el.election_key AND t.election_key <> '{LATEST}') AS summary_rows, (SELECT count(*) FROM res r WHERE r.election_key = el.election_key AND r.election_year <> 1996) AS result_rows FROM el)" + """
 SELECT election_key, summary_rows, result_rows, CASE WHEN summary_rows + result_rows > 0 THEN 'usable' ELSE 'empty' END AS registry_status, CASE WHEN summary_rows > 0 AND result_rows > 0 THEN 'summary+results' WHEN summary_rows > 0 THEN 'summary_only' WHEN result_rows > 0 THEN 'results_only' ELSE 'empty' END AS coverage_label,
 CASE WHEN status = 'completed' AND summary_rows = 0 THEN 'completed_without_rows' ELSE status END AS status, CASE WHEN status = 'completed' AND summary_rows = 0 THEN 'false' ELSE is_complete END AS is_complete FROM c""")
def _(p):
    elections = p.tot.select("election_key", "election_year").distinct().select("election_key", F.when(F.col("election_year") % 2 == 0, "completed").otherwise("empty").alias("status"), F.lit("true").alias("is_complete"))
    elections = elections.unionByName(p.spark.createDataFrame([("e1900", "completed", "true")], elections.schema))
    return I.registry(elections, p.tot.filter(F.col("election_key") != LATEST), p.res.filter("election_year <> 1996"))


_FLAGS = "lower(trim(regexp_replace(coalesce(completeness_flag, ''), '\\s+', ' ', 'g')))"
_PARTIAL = ", q AS (SELECT *, " + _FLAGS + " AS f, list_distinct(list_filter(list_transform(string_split(coalesce(comparability_note, ''), '|'), lambda x: trim(x)), lambda x: x <> '')) AS nt FROM t)"
_ROW_TRUST = _T + _PARTIAL + """, rt AS (SELECT election_key, municipality_id, greatest(0, 100 - CASE WHEN has_geometry THEN 0 ELSE 22 END - CASE WHEN contains(f, 'partial') THEN 28 WHEN f IN ('', 'unknown') THEN 12 WHEN contains(f, 'turnout_only') THEN 12 ELSE 0 END - CASE WHEN list_contains(nt, 'no_party_rows_detected') THEN 8 ELSE 0 END
 - CASE WHEN len(list_filter(nt, lambda x: x NOT IN ('turnout_from_clean', 'counts_corrected_from_turnout', 'party_rows_checked'))) > 0 THEN 12 ELSE 0 END - CASE WHEN regexp_matches(lower(territorial_status), 'supp|fuso|merge|rename|stor|harmon|scorpor|derived') THEN 10 ELSE 0 END - CASE WHEN lineage_note IS NOT NULL THEN 6 ELSE 0 END - 18 - CASE WHEN territorial_mode = 'harmonized' THEN 4 ELSE 0 END) AS trust_score FROM q)"""


@query("v03_row_trust", _ROW_TRUST + " SELECT *, CASE WHEN trust_score >= 80 THEN 'strong' WHEN trust_score >= 55 THEN 'caution' ELSE 'fragile' END AS trust_status FROM rt")
def _(p):
    return Q.row_trust(made(p, TURNOUT), compare_missing=True).select(*_KEY, "trust_score", "trust_status")


_VIEW = _T + _PARTIAL + """, a AS (SELECT election_key, count(*) AS n, avg(CASE WHEN has_geometry THEN 1.0 ELSE 0.0 END) AS geo, avg(CASE WHEN contains(f, 'partial') THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN contains(f, 'turnout_only') THEN 1.0 ELSE 0.0 END) AS onl, avg(CASE WHEN f IN ('', 'unknown') THEN 1.0 ELSE 0.0 END) AS unk FROM q WHERE election_key = 'e1998' GROUP BY 1),
 vt AS (SELECT n, greatest(0, 100 - CASE WHEN geo < 0.5 THEN 28 WHEN geo < 0.9 THEN 14 ELSE 0 END - CASE WHEN pa > 0.25 THEN 22 WHEN pa > 0 THEN 10 ELSE 0 END - CASE WHEN onl > 0.3 THEN 10 WHEN onl > 0 THEN 4 ELSE 0 END - CASE WHEN unk > 0.3 THEN 8 ELSE 0 END) AS trust_score FROM a), st AS (SELECT n, trust_score, CASE WHEN trust_score >= 80 THEN 'strong' WHEN trust_score >= 55 THEN 'caution' ELSE 'fragile' END AS trust_status FROM vt)"""


@query("v04_view_trust", _VIEW + " SELECT * FROM st")
def _(p):
    return Q.view_trust(made(p, TURNOUT).filter("election_key = 'e1998'"))


@query("v05_evidence", _VIEW + " SELECT n, trust_status, CASE WHEN trust_status = 'strong' AND n >= 20 THEN 'strong' WHEN trust_status <> 'fragile' AND n >= 5 THEN 'cautious' ELSE 'exploratory' END AS evidence FROM st")
def _(p):
    return Q.evidence(Q.view_trust(made(p, TURNOUT).filter("election_key = 'e1998'")), 70)


@query("p02_completeness", _T + ", q AS (SELECT *, coalesce(nullif(lower(trim(completeness_flag)), ''), 'unknown') AS f FROM t) SELECT election_key, municipality_id, contains(f, 'complete') OR contains(f, 'party_results_checked') OR f = 'ok' AS complete, NOT contains(f, 'partial') AND f <> 'unknown' AS non_partial, contains(f, 'partial') AS partial, f = 'unknown' AS unknown, TRUE AS other FROM q")
def _(p):
    return made(p, TURNOUT).select(*_KEY, *[X.is_complete(F.col("completeness_flag"), m).alias(m) for m in ("complete", "non_partial", "partial", "unknown", "other")])


@query("p03_territorial_status", _T + " SELECT election_key, municipality_id FROM t WHERE trim(regexp_replace(lower(strip_accents(territorial_status)), '[^a-z0-9]+', ' ', 'g')) = 'storico'")
def _(p):
    return made(p, TURNOUT).filter(X.token(F.col("territorial_status")) == X.token(F.lit("STORICO!"))).select(*_KEY)


@query("p08_meaningful_note", _T + _PARTIAL + " SELECT election_key, municipality_id, len(list_filter(nt, lambda x: x NOT IN ('turnout_from_clean', 'counts_corrected_from_turnout', 'party_rows_checked'))) > 0 AS meaningful, list_aggregate(list_sort(nt), 'string_agg', '|') AS note FROM q")
def _(p):
    note = F.col("comparability_note")
    return made(p, TURNOUT).select(*_KEY, X.has_meaningful_note(note).alias("meaningful"), F.nullif(F.array_join(F.array_sort(X.notes(note)), "|"), F.lit("")).alias("note"))


@query("p06_client_filter", f"SELECT municipality_id, electors FROM tot WHERE election_key = '{LATEST}' AND province = 'NATION_3'")
def _(p):
    one = p.cells.filter((F.col("election_key") == LATEST) & (F.col("province") == "NATION_3"))
    return P.totals(one).select("municipality_id", "electors")


@query("p07_area_preset", "SELECT DISTINCT province FROM tot SEMIJOIN_".replace("SEMIJOIN_", "WHERE contains(lower(province), 'ion_1') OR contains(lower(province), 'ion_2')"))
def _(p):
    presets = p.spark.createDataFrame([("north", "ion_1"), ("north", "ion_2"), ("south", "ion_3")], "preset string, word string").filter("preset = 'north'")
    return p.tot.select("province").distinct().join(F.broadcast(presets), F.lower("province").contains(F.col("word")), "left_semi")


@query("p10_party_label", "SELECT DISTINCT party_raw, CASE WHEN regexp_matches(last, '^[0-9]+$') THEN NULL WHEN n >= 2 AND last <> first THEN last ELSE first END AS label FROM (SELECT party_raw, len(w) AS n, w[1] AS first, w[len(w)] AS last FROM (SELECT party_raw, list_filter(string_split(party_raw, ' '), lambda x: lower(x) NOT IN ('standard', 'promo', '')) AS w FROM res))")
def _(p):
    return p.res.select("party_raw").distinct().select("party_raw", X.last_label(F.split("party_raw", " "), ["standard", "promo"]).alias("label"))


_CONC = _VOL + f""", hhi AS (SELECT s.election_key, s.municipality_id, {_PCT} * sum(votes * votes) / (any_value(valid_votes) * any_value(valid_votes)) AS concentration FROM std s JOIN tot t USING (election_key, municipality_id) GROUP BY ALL), pv AS (SELECT t.province, {_PCT} * v / d AS ps FROM (SELECT province, sum(valid_votes) AS d FROM tot WHERE election_key = '{LATEST}' GROUP BY 1) t LEFT JOIN (SELECT province, sum(votes) AS v FROM std WHERE election_key = '{LATEST}' AND party_std = 'Brand#12' GROUP BY 1) s USING (province)),
 na AS (SELECT {_PCT} * (SELECT sum(votes) FROM std WHERE election_key = '{LATEST}' AND party_std = 'Brand#12') / (SELECT sum(valid_votes) FROM tot WHERE election_key = '{LATEST}') AS ns)"""


@query("p12_context_metrics", _CONC + f" SELECT o.municipality_id, round(concentration, 6) AS concentration, round(share - ps, 6) AS over_performance_province, round(share - ns, 6) AS over_performance_region, CASE WHEN CAST(o.municipality_id AS BIGINT) % 3 = 0 THEN CAST(CAST(o.municipality_id AS BIGINT) % 10 AS DOUBLE) WHEN CAST(o.municipality_id AS BIGINT) % 3 = 1 THEN CAST(7 AS DOUBLE) END AS custom_indicator FROM own o LEFT JOIN hhi USING (election_key, municipality_id) LEFT JOIN pv ON pv.province = o.province CROSS JOIN na WHERE o.election_key = '{LATEST}'")
def _(p):
    own = p.own.filter(F.col("election_key") == LATEST)
    tot, std = p.tot.filter(F.col("election_key") == LATEST), p.std.filter(F.col("election_key") == LATEST)
    hhi = P.concentration(std, tot).select("municipality_id", "concentration")
    id_ = F.col("municipality_id").cast("long")
    custom = tot.filter(id_ % 3 == 0).select("municipality_id", F.lit(LATEST).alias("election_key"), (id_ % 10).cast("double").alias("value"))
    custom = custom.unionByName(tot.filter(id_ % 3 == 1).select("municipality_id", F.lit("").alias("election_key"), F.lit(7.0).alias("value")))  # a blank election stands for all
    return P.context_metrics(own, hhi, std, tot, "Brand#12", custom, LATEST).select("municipality_id", *r6("concentration", "over_performance_province", "over_performance_region"), "custom_indicator")
