"""Report tables over the panel: series, comparisons, history, archetypes and coverage, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import reports as R
from ..operators import trajectory as T
from .registry import _CELLS, _OWN, _PCT, _VOL, BEFORE, LATEST, Panel, _cells, query, r6

PLACE = "1287"
PLACES = ["7", "42", "99", "100"]


@query("a09_place_groups", f"SELECT bloc AS grp, CAST(sum(votes) AS BIGINT) AS votes, round({_PCT} * sum(votes) / any_value(d), 6) AS share FROM (SELECT s.bloc, s.votes, (SELECT sum(valid_votes) FROM tot WHERE municipality_id = '{PLACE}' AND election_key = '{LATEST}') AS d FROM std s WHERE municipality_id = '{PLACE}' AND election_key = '{LATEST}') GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 8")
def _(p: Panel) -> DataFrame:
    one = p.cells.filter((F.col("municipality_id") == PLACE) & (F.col("election_key") == LATEST))
    return R.place_groups(P.by_party(one), P.totals(one), "bloc", 8).select("grp", "votes", *r6("share"))


@query("a14_province_years", f"SELECT s.province, s.election_year, round({_PCT} * v / d, 6) AS party_share, round(turnout, 6) AS turnout, leader FROM (SELECT province, election_year, avg(turnout_pct) AS turnout, sum(valid_votes) AS d FROM summ GROUP BY ALL) s LEFT JOIN (SELECT province, election_year, sum(votes) AS v FROM std WHERE party_std = 'Brand#12' GROUP BY ALL) o ON o.province = s.province AND o.election_year = s.election_year LEFT JOIN (SELECT province, election_year, first_party_std AS leader, row_number() OVER (PARTITION BY province, election_year ORDER BY count(*) DESC, first_party_std) AS k FROM summ WHERE first_party_std IS NOT NULL GROUP BY province, election_year, first_party_std) m ON m.province = s.province AND m.election_year = s.election_year AND k = 1")
def _(p: Panel) -> DataFrame:
    return R.province_years(p.summ, p.std, "Brand#12").select("province", "election_year", *r6("party_share", "turnout"), "leader")


_ST = _VOL + ", st AS (SELECT municipality_id, CASE WHEN volatility IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - CAST(2.4 AS DOUBLE) * volatility - 6 * changes) END AS stability FROM chg LEFT JOIN vol USING (municipality_id)), cl AS (SELECT o.*, s.turnout_pct, st.stability FROM own o JOIN summ s USING (election_key, municipality_id) LEFT JOIN st ON st.municipality_id = o.municipality_id)"
_GROUPS = {"ids": "municipality_id IN ('7', '42', '99', '100')", "provinces": "province IN ('NATION_1', 'NATION_7')", "nation": "true"}


@query("a16_group_series", _ST + " " + " UNION ALL ".join(f"SELECT '{k}' AS grp, election_year, round(avg(share), 6) AS share, round(avg(turnout_pct), 6) AS turnout, round(avg(stability), 6) AS stability, count(*) AS n FROM cl WHERE {c} GROUP BY 2" for k, c in _GROUPS.items()))
def _(p: Panel) -> DataFrame:
    return R.mean_series(T.with_history(_cells(p)), {k: F.expr(c) for k, c in _GROUPS.items()}).select("grp", "election_year", *r6("share", "turnout", "stability"), "n")


@query("a18_archetypes", _OWN + """, t AS (SELECT municipality_id, CASE WHEN count(share) < 2 THEN 'trend n/d' WHEN arg_max(share, election_year) - arg_min(share, election_year) >= 5 THEN 'crescita netta' WHEN arg_max(share, election_year) - arg_min(share, election_year) <= -5 THEN 'calo netto' ELSE 'andamento stabile' END AS label FROM own GROUP BY 1),
 k AS (SELECT label, municipality_id, row_number() OVER (PARTITION BY label ORDER BY municipality_id) AS i FROM t)
 SELECT label, count(*) AS n, string_agg(CASE WHEN i <= 6 THEN municipality_id END, '|' ORDER BY municipality_id) AS first_places FROM k GROUP BY 1 ORDER BY n DESC, label LIMIT 6""")
def _(p: Panel) -> DataFrame:
    return R.label_distribution(T.trend(p.own).withColumnRenamed("trend", "label"), 6, 6)


@query("a35_coverage", "SELECT t.election_key, t.n AS n_summary, r.n AS n_results, CASE WHEN t.election_year >= 1996 THEN 'covered' ELSE 'before_geometry' END AS geometry, CASE WHEN r.n > 0 THEN 'complete' ELSE 'summary_only' END AS status FROM (SELECT election_key, election_year, count(*) AS n FROM tot GROUP BY ALL) t LEFT JOIN (SELECT election_key, count(*) AS n FROM res GROUP BY 1) r USING (election_key)")
def _(p: Panel) -> DataFrame:
    return R.coverage(p.tot, p.res, 1996)


SELECTED = {"party_raw": "Brand#12 ECONOMY ANODIZED STEEL", "party_std": "Brand#12", "party_family": "fam_4", "bloc": "bloc_0"}
_IN = lambda k, where: f"{_PCT} * (SELECT sum(votes) FROM res WHERE {k} = '{SELECTED[k]}' AND {where}) / (SELECT sum(valid_votes) FROM tot WHERE {where})"
_NOW = f"election_key = '{LATEST}'"
_HERE = {"municipality": f"{_NOW} AND municipality_id = '{PLACE}'", "province": f"{_NOW} AND province = (SELECT province FROM tot WHERE {_NOW} AND municipality_id = '{PLACE}')", "nation": _NOW}


@query("a37_context", _ST + " SELECT mode, level, measure, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS mode, '{level}' AS level, 'share' AS measure, {_IN(k, where)} AS value" for k in SELECTED for level, where in _HERE.items()) + f""" UNION ALL SELECT '', 'municipality', 'turnout', {_PCT} * sum(voters) / sum(electors) FROM tot WHERE {_HERE["municipality"]} UNION ALL SELECT '', 'province', 'turnout', {_PCT} * sum(voters) / sum(electors) FROM tot WHERE {_HERE["province"]}
 UNION ALL SELECT '', 'municipality', 'stability', stability FROM st WHERE municipality_id = '{PLACE}') WHERE value IS NOT NULL AND EXISTS (SELECT 1 FROM tot WHERE {_HERE["municipality"]})""")
def _(p: Panel) -> DataFrame:
    stable = T.history(_cells(p).filter(F.col("municipality_id") == PLACE))
    return R.context(p.cells.filter(F.col("election_key") == LATEST), SELECTED, PLACE, stable).select("mode", "level", "measure", *r6("value"))


@query("o06_results_by_rank", f"SELECT municipality_id, party_std, votes, rn AS rank FROM rk WHERE election_key = '{LATEST}' AND municipality_id = '{PLACE}' ORDER BY rn, party_std LIMIT 12")
def _(p: Panel) -> DataFrame:
    one = P.by_party(p.cells.filter((F.col("municipality_id") == PLACE) & (F.col("election_key") == LATEST)))
    return R.ranked(one).orderBy("rank", "party_std").limit(12)


@query("w19_stepping", "SELECT election_key, lag(election_key) OVER w AS previous, lead(election_key) OVER w AS next FROM (SELECT DISTINCT election_key, election_year FROM tot) WINDOW w AS (ORDER BY election_year)")
def _(p: Panel) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy("election_year")  # one row an election
    return p.tot.select("election_key", "election_year").distinct().select("election_key", F.lag("election_key").over(w).alias("previous"), F.lead("election_key").over(w).alias("next"))


@query("w21_multi_series", _OWN + " SELECT municipality_id, election_year, round(share, 6) AS share FROM own WHERE municipality_id IN ('7', '42', '99', '100') AND share IS NOT NULL")
def _(p: Panel) -> DataFrame:
    some = p.cells.filter(F.col("municipality_id").isin(PLACES))
    return P.own_share(some, "Brand#12").filter("share is not null").select("municipality_id", "election_year", *r6("share"))


@query("w22_leading_row", "SELECT election_key, municipality_id, party_raw AS leader, votes FROM (SELECT *, row_number() OVER (PARTITION BY election_key, municipality_id ORDER BY votes DESC, party_raw) AS k FROM res) WHERE k = 1")
def _(p: Panel) -> DataFrame:
    first = p.res.groupBy("election_key", "municipality_id").agg(F.min_by(F.struct("party_raw", "votes"), F.struct(-F.col("votes"), "party_raw")).alias("r"))
    return first.select("election_key", "municipality_id", F.col("r.party_raw").alias("leader"), "r.votes")


@query("w23_history", _VOL + f" SELECT s.election_year, round(s.turnout_pct, 6) AS turnout, round(s.first_second_margin, 6) AS margin, round(o.share, 6) AS share, s.first_party_std AS leader FROM summ s LEFT JOIN own o USING (election_key, municipality_id) WHERE municipality_id = '{PLACE}'")
def _(p: Panel) -> DataFrame:
    one = P.own_share(p.cells.filter(F.col("municipality_id") == PLACE), "Brand#12", "party_std", "turnout_pct", "first_second_margin", "first_party_std")
    return one.select("election_year", F.round("turnout_pct", 6).alias("turnout"), F.round("first_second_margin", 6).alias("margin"), *r6("share"), F.col("first_party_std").alias("leader"))


@query("o05_insights", _VOL + f" SELECT 'top_turnout' AS kind, municipality_id, round(turnout_pct, 6) AS value FROM (SELECT * FROM summ WHERE election_key = '{LATEST}' AND turnout_pct IS NOT NULL ORDER BY turnout_pct DESC, municipality_id LIMIT 1) UNION ALL SELECT 'changes', municipality_id, CAST(changes AS DOUBLE) FROM (SELECT * FROM chg WHERE changes >= 2 ORDER BY changes DESC, municipality_id LIMIT 3)")
def _(p: Panel) -> DataFrame:
    top = p.summ.filter((F.col("election_key") == LATEST) & F.col("turnout_pct").isNotNull()).orderBy(F.desc("turnout_pct"), "municipality_id").limit(1)
    moved = T.dominance_changes(p.summ).filter("changes >= 2").orderBy(F.desc("changes"), "municipality_id").limit(3)
    return top.select(F.lit("top_turnout").alias("kind"), "municipality_id", F.round("turnout_pct", 6).alias("value")).unionByName(moved.select(F.lit("changes").alias("kind"), "municipality_id", F.col("changes").cast("double").alias("value")))


_BY = {"own": f"r.municipality_id = '{PLACE}'", "province": "r.province = h.province", "nation": "true"}
_DEN = {"own": f"t.municipality_id = '{PLACE}'", "province": "t.province = h.province", "nation": "true"}
_TOP = "SELECT '{0}' AS mode, {1} AS series, sum(votes) AS total FROM res WHERE municipality_id = '" + PLACE + "' GROUP BY 2 ORDER BY total DESC, 2 LIMIT 5"
_MODES = {"top_parties": "party_raw", "top_groups party_std": "party_std", "top_groups party_family": "party_family", "top_groups bloc": "bloc"}


@query("w20_trajectory", f", h AS (SELECT election_year, province, turnout_pct, valid_votes FROM summ WHERE municipality_id = '{PLACE}') SELECT mode, series, election_year, round(value, 6) AS value FROM (SELECT 'selected_vs_context' AS mode, 'turnout' AS series, election_year, turnout_pct AS value FROM h UNION ALL "
  + " UNION ALL ".join(f"SELECT 'selected_vs_context', '{level} {k}', h.election_year, {_PCT} * (SELECT sum(votes) FROM res r WHERE r.election_year = h.election_year AND r.{k} = '{v}' AND {_BY[level]}) / (SELECT sum(valid_votes) FROM tot t WHERE t.election_year = h.election_year AND {_DEN[level]}) FROM h" for k, v in SELECTED.items() for level in _BY)
  + " UNION ALL " + " UNION ALL ".join(f"SELECT '{m}', r.{c}, r.election_year, {_PCT} * sum(votes) / any_value(h.valid_votes) FROM res r JOIN h USING (election_year) JOIN ({_TOP.format(m, c)}) x ON x.series = r.{c} WHERE municipality_id = '{PLACE}' GROUP BY 2, 3" for m, c in _MODES.items()) + ") WHERE value IS NOT NULL")
def _(p: Panel) -> DataFrame:
    return R.trajectory(p.cells, PLACE, SELECTED).select("mode", "series", "election_year", *r6("value"))


@query("p13_enriched", _VOL + f" SELECT o.municipality_id, round(o.share, 6) AS party_share, round(o.share - b.share, 6) AS swing_compare, round(volatility, 6) AS volatility, changes AS dominance_changes, round(o.share, 6) AS metric_value FROM own o LEFT JOIN own b ON b.municipality_id = o.municipality_id AND b.election_key = '{BEFORE}' LEFT JOIN vol v ON v.municipality_id = o.municipality_id LEFT JOIN chg c ON c.municipality_id = o.municipality_id WHERE o.election_key = '{LATEST}'")
def _(p: Panel) -> DataFrame:
    was = p.own.filter(F.col("election_key") == BEFORE).select("municipality_id", F.col("share").alias("s0"))
    e = p.own.filter(F.col("election_key") == LATEST).join(was, "municipality_id", "left").join(T.volatility(p.own), "municipality_id", "left").join(T.dominance_changes(p.summ), "municipality_id", "left")
    return e.select("municipality_id", F.round("share", 6).alias("party_share"), F.round(F.col("share") - F.col("s0"), 6).alias("swing_compare"), *r6("volatility"), F.col("changes").alias("dominance_changes"), F.round("share", 6).alias("metric_value"))
