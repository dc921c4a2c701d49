"""View, ranking, join and lookup queries over the panel, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import cluster as C
from ..operators import geo as G
from ..operators import ingest as I
from ..operators import panel as P
from ..operators import reports as R
from ..operators import resolve as V
from ..operators import trajectory as T
from .ingest import _KEY, RAWS, made
from .registry import _CELLS, _OWN, _PCT, _VECTORS, _VOL, BEFORE, LATEST, PARTY, Panel, _cells, query, r6, vectors

_R = f", raws AS ({RAWS.replace('AS STRING', 'AS VARCHAR')})"
_STAB = _VOL + ", met AS (SELECT municipality_id, volatility, changes, CASE WHEN volatility IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - CAST(2.4 AS DOUBLE) * volatility - 6 * changes) END AS stability FROM chg LEFT JOIN vol USING (municipality_id))"


def metrics(p: Panel) -> DataFrame:
    """(municipality_id, volatility, changes, stability_index) over all elections."""
    return T.history(_cells(p)).withColumnRenamed("stability_index", "stability")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("j03_last_write_wins", _R + " SELECT election_key, municipality_id, party_std, arg_max(party_raw, ord) AS party_raw, arg_max(votes, ord) AS votes FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY election_key, municipality_id, party_std, ord ORDER BY party_raw) AS k FROM raws) WHERE k = 1) GROUP BY ALL")
def _(p):
    return I.first_of(made(p, RAWS), [*_KEY, "party_std"], F.desc("ord"), "party_raw").select(*_KEY, "party_std", "party_raw", "votes")


@query("j04_results_by_rank", f" SELECT municipality_id, party_std, CAST(row_number() OVER (PARTITION BY municipality_id ORDER BY coalesce(nullif(CASE WHEN votes % 5 = 0 THEN 0 WHEN votes % 5 = 1 THEN NULL ELSE rn END, 0), 999), party_std) AS INT) AS place FROM rk WHERE election_key = '{LATEST}'")
def _(p):
    one = P.by_party(p.cells.filter(F.col("election_key") == LATEST))
    ranked = one.withColumn("rn", F.row_number().over(Window.partitionBy("municipality_id").orderBy(F.desc("votes"), "party_std")))
    rank = F.coalesce(F.nullif(F.when(F.col("votes") % 5 == 0, 0).when(F.col("votes") % 5 != 1, F.col("rn")), F.lit(0)), F.lit(999))
    return ranked.select("municipality_id", "party_std", F.row_number().over(Window.partitionBy("municipality_id").orderBy(rank, "party_std")).alias("place"))


_MASTER = ", ms AS (SELECT municipality_id, min(province) AS province, 'g' || CAST(CAST(municipality_id AS BIGINT) % 700 AS VARCHAR) AS geometry_id FROM tot GROUP BY 1)"


def _master(p: Panel) -> DataFrame:
    return p.tot.groupBy("municipality_id").agg(F.min("province").alias("province")).withColumn("geometry_id", F.concat(F.lit("g"), (F.col("municipality_id").cast("long") % 700).cast("string")))


@query("j05_current_territory", _MASTER + """, g AS (SELECT geometry_id, arg_min(province, CAST(municipality_id AS BIGINT)) AS gp, min(CAST(municipality_id AS BIGINT)) AS gid FROM ms GROUP BY 1), x AS (SELECT election_key, municipality_id, province, CASE WHEN electors % 2 = 0 THEN 'g' || CAST(electors % 900 AS VARCHAR) END AS geometry_id FROM tot)
 SELECT x.election_key, x.municipality_id, x.province AS province_observed, coalesce(g.gp, ms.province) AS province, coalesce(g.geometry_id, ms.geometry_id) AS geometry_id FROM x LEFT JOIN g ON g.geometry_id = x.geometry_id LEFT JOIN ms ON ms.municipality_id = x.municipality_id""")
def _(p):
    rows = p.tot.select(*_KEY, "province", F.when(F.col("electors") % 2 == 0, F.concat(F.lit("g"), (F.col("electors") % 900).cast("string"))).alias("geometry_id"))
    return P.on_current_territory(rows, _master(p))


@query("j06_geometry_match", _MASTER + ", x AS (SELECT election_key, municipality_id, province, electors FROM tot), ge AS (SELECT DISTINCT geometry_id FROM ms WHERE CAST(municipality_id AS BIGINT) % 3 <> 0) SELECT election_key, x.municipality_id, EXISTS (SELECT 1 FROM ge WHERE ge.geometry_id = ms.geometry_id) AS geometry_match FROM x JOIN ms USING (municipality_id)")
def _(p):
    m = _master(p)
    shapes = m.filter(F.col("municipality_id").cast("long") % 3 != 0).select("geometry_id").distinct().withColumn("has", F.lit(True))
    return p.tot.select(*_KEY).join(m.select("municipality_id", "geometry_id"), "municipality_id").join(shapes, "geometry_id", "left").select(*_KEY, F.coalesce("has", F.lit(False)).alias("geometry_match"))


@query("j07_j08_denominators", "SELECT r.election_key, r.municipality_id, party_raw, r.votes, t.valid_votes, CASE WHEN t.electors % 3 = 0 THEN t.electors % 17 END AS invalid FROM res r LEFT JOIN (SELECT * FROM tot WHERE electors % 7 <> 0) t USING (election_key, municipality_id)")
def _(p):
    den = p.tot.filter("electors % 7 <> 0").select(*_KEY, "valid_votes", F.when(F.col("electors") % 3 == 0, F.col("electors") % 17).alias("invalid")).distinct()
    return p.res.select(*_KEY, "party_raw", "votes").join(den, _KEY, "left")


# Places under made-up names that have nothing in common: even ones have a shape, every third one a former name, every
# fiftieth a fixed answer. Rows ask for them in eleven ways; a row's candidate 0 is its own name.
_PLACES = f"SELECT municipality_id, CAST(municipality_id AS BIGINT) AS no, substring(md5(municipality_id), 1, 12) AS k, min(province) AS province, min(region) AS region FROM tot GROUP BY municipality_id"
_ASKED = [
    ("k", "province", "region"), ("k", "'?'", "region"), ("k", "'?'", "'?'"), ("concat(k, 'h')", "province", "region"), ("concat(k, 'h')", "'?'", "region"), ("concat(k, 'h')", "'?'", "'?'"), ("substring(k, 1, 3)", "province", "NULL"),
    ("concat(k, 'hxy')", "'?'", "'?'"), ("concat(substring(k, 1, 4), 'x', substring(k, 5, 8))", "'?'", "region"), ("'none'", "province", "region"), ("concat(k, 'h')", "'?'", "'?'"),
]
_ASK = ", ".join(f"CASE no % 66 // 6 {' '.join(f'WHEN {i} THEN {x[j]}' for i, x in enumerate(_ASKED))} END AS {c}" for j, c in enumerate(("key", "province", "region")))
_KNOWN_PLACES = {
    "overrides": "SELECT k AS key, concat('m', municipality_id) AS id FROM pl WHERE no % 50 = 0", "geometry": "SELECT k AS key, province, region, concat('g', municipality_id) AS id FROM pl WHERE no % 2 = 0",
    "historical": "SELECT concat(k, 'h') AS key, province, region, concat('h', municipality_id) AS id FROM pl WHERE no % 3 = 0 UNION ALL SELECT concat(substring(k, 1, 2), 'q') AS key, province, region, concat('q', municipality_id) AS id FROM pl WHERE no % 30 = 0",
    "names": f"SELECT municipality_id AS row, 0 AS candidate, {_ASK} FROM pl UNION ALL SELECT municipality_id AS row, 1 AS candidate, k AS key, province, region FROM pl WHERE no % 66 // 6 >= 9",
}
_ALONE = "SELECT key, min(id) AS id FROM {} GROUP BY key HAVING min(id) = max(id)"
_EXACT = [
    "SELECT row, candidate, 0 AS s, id FROM names JOIN overrides USING (key)",
    *(f"SELECT row, candidate, {i} AS s, id FROM names JOIN {t if len(on) > 1 else '(' + _ALONE.format(t) + ')'} k USING ({', '.join(on)})" for i, (t, on) in enumerate(((t, on) for t in ("geometry", "historical") for on in (["key", "province"], ["key", "region"], ["key"])), 1)),
]
_BEGINS = "(starts_with(n.key, h.key) OR starts_with(h.key, n.key)) AND n.key <> ''"


@query("j10_cascade", f", pl AS ({_PLACES}), " + ", ".join(f"{k} AS ({v})" for k, v in _KNOWN_PLACES.items()) + f""", hits AS ({' UNION ALL '.join(_EXACT)}),
 r0 AS (SELECT row, candidate, s, id FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY candidate, s, id) AS i FROM hits) WHERE i = 1),
 r1 AS (SELECT row, min(candidate) AS candidate, 7 AS s, min(h.id) AS id FROM names n JOIN historical h ON h.province = n.province AND {_BEGINS} WHERE row NOT IN (SELECT row FROM r0) GROUP BY row HAVING min(h.id) = max(h.id)),
 r2 AS (SELECT row, min(candidate) AS candidate, 8 AS s, min(h.id) AS id FROM names n JOIN historical h ON {_BEGINS} WHERE row NOT IN (SELECT row FROM r0 UNION ALL SELECT row FROM r1) GROUP BY row HAVING min(h.id) = max(h.id)),
 r3 AS (SELECT row, 0 AS candidate, 9 AS s, min(g.id) AS id FROM names n JOIN geometry g ON g.region = n.region AND levenshtein(n.key, g.key) <= 1 WHERE candidate = 0 AND row NOT IN (SELECT row FROM r0 UNION ALL SELECT row FROM r1 UNION ALL SELECT row FROM r2) GROUP BY row HAVING min(g.id) = max(g.id))
 SELECT row, candidate, {list(V.STRATEGIES)}[s + 1] AS strategy, id FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""")
def _(p):
    """In the SQL one letter more stands for the ratio: for these names of 12 letters, 0.91 lets through no more than that."""
    pl = p.tot.groupBy("municipality_id").agg(F.min("province").alias("province"), F.min("region").alias("region"))
    pl = pl.selectExpr("municipality_id", "CAST(municipality_id AS BIGINT) AS no", "substring(md5(municipality_id), 1, 12) AS k", "province", "region")
    t = {k: p.spark.sql(v.replace(" // ", " DIV ").replace("FROM pl", "FROM {pl}"), pl=pl) for k, v in _KNOWN_PLACES.items()}
    return V.cascade(t["names"], t["overrides"], t["geometry"], t["historical"])


@query("j11_prefix_match", "SELECT name, min(id) AS id FROM (SELECT DISTINCT lower(province) AS name FROM tot UNION SELECT substr(CAST(electors AS VARCHAR), 1, CAST(voters % 4 AS BIGINT)) FROM tot) n JOIN (SELECT DISTINCT CAST(valid_votes AS VARCHAR) AS known, province AS id FROM tot WHERE valid_votes % 3 = 0 UNION ALL SELECT 'nation_1', 'a' UNION ALL SELECT 'nation_11', 'b' UNION ALL SELECT 'nation_22x', 'c' UNION ALL SELECT 'n', 'd') k ON starts_with(known, name) OR starts_with(name, known) WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1")
def _(p):
    known = p.tot.filter("valid_votes % 3 = 0").selectExpr("CAST(valid_votes AS STRING) AS known_name", "province AS id").distinct()
    known = known.unionByName(p.spark.createDataFrame([("nation_1", "a"), ("nation_11", "b"), ("nation_22x", "c"), ("n", "d")], known.schema))
    return V.prefix_match(p.tot.selectExpr("lower(province) AS name").unionByName(p.tot.selectExpr("substring(CAST(electors AS STRING), 1, CAST(voters % 4 AS INT)) AS name")), known)


@query("j13_lookup_by_name", _MASTER + ", l AS (SELECT municipality_id % 40 AS name, province, geometry_id, CAST(municipality_id AS BIGINT) AS ord FROM (SELECT CAST(municipality_id AS BIGINT) AS municipality_id, province, geometry_id FROM ms)), x AS (SELECT municipality_id, CAST(municipality_id AS BIGINT) % 41 AS name, province FROM ms) SELECT municipality_id, geometry_id FROM (SELECT x.municipality_id, l.geometry_id, row_number() OVER (PARTITION BY x.municipality_id ORDER BY CASE WHEN l.province = x.province THEN 0 ELSE 1 END, l.ord) AS k FROM x LEFT JOIN l ON l.name = x.name) WHERE k = 1")
def _(p):
    m = _master(p).withColumn("ord", F.col("municipality_id").cast("long"))
    shapes = m.select((F.col("ord") % 40).alias("name"), "province", "geometry_id", "ord")
    # First per name and province, and first per name: two lookups of one row, not every shape of the name.
    exact = I.first_of(shapes, ["name", "province"], "ord").select("name", "province", F.col("geometry_id").alias("exact"))
    any_ = I.first_of(shapes, ["name"], "ord").select("name", F.col("geometry_id").alias("any"))
    return m.select("municipality_id", (F.col("ord") % 41).alias("name"), "province").join(exact, ["name", "province"], "left").join(any_, "name", "left").select("municipality_id", F.coalesce("exact", "any").alias("geometry_id"))


@query("j18_known_province", "SELECT election_key, municipality_id, CASE WHEN electors % 5 = 0 AND CAST(municipality_id AS BIGINT) % 2 = 0 THEN 'known' WHEN electors % 5 = 0 THEN NULL ELSE province END AS province, CASE WHEN electors % 5 = 0 AND CAST(municipality_id AS BIGINT) % 2 = 0 THEN 'old|filled' ELSE 'old' END AS note FROM tot")
def _(p):
    rows = p.tot.select(*_KEY, F.when(F.col("electors") % 5 != 0, F.col("province")).alias("province"), F.lit("old").alias("note"))
    known = p.tot.select("municipality_id").distinct().filter("cast(municipality_id as bigint) % 2 = 0").withColumn("known", F.lit("known"))
    blank = F.nullif(F.trim("province"), F.lit("")).isNull() & F.col("known").isNotNull()
    out = rows.join(known, "municipality_id", "left")
    return out.select(*_KEY, F.when(blank, F.col("known")).otherwise(F.col("province")).alias("province"), F.when(blank, X.join_notes(F.col("note"), F.lit("filled"))).otherwise(F.col("note")).alias("note"))


@query("j22_j25_first_record", _MASTER + ", a AS (SELECT geometry_id AS key, province AS label, 0 AS source, CAST(municipality_id AS BIGINT) AS ord FROM ms UNION ALL SELECT municipality_id, upper(province), 1, CAST(municipality_id AS BIGINT) FROM ms) SELECT key, label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, ord) AS k FROM a) WHERE k = 1")
def _(p):
    m = _master(p).withColumn("ord", F.col("municipality_id").cast("long"))
    both = m.select(F.col("geometry_id").alias("key"), F.col("province").alias("label"), F.lit(0).alias("source"), "ord").unionByName(m.select(F.col("municipality_id").alias("key"), F.upper("province").alias("label"), F.lit(1).alias("source"), "ord"))
    return I.first_of(both, ["key"], "source", "ord").select("key", "label")


@query("j24_unique_names", _MASTER + " SELECT CAST(municipality_id AS BIGINT) % 900 AS name, min(municipality_id) AS municipality_id, min(geometry_id) AS geometry_id FROM ms GROUP BY 1 HAVING count(DISTINCT municipality_id) = 1")
def _(p):
    m = _master(p).withColumn("name", F.col("municipality_id").cast("long") % 900)
    return I.unique_names(m, "name", ["municipality_id", "geometry_id"])


@query("j23_segment_rows", _R + ", e AS (SELECT DISTINCT election_key, municipality_id, segment FROM raws), t AS (SELECT election_key, municipality_id, electors FROM tot WHERE electors % 3 = 0) SELECT e.election_key, e.municipality_id, segment, t.electors, v.votes FROM e LEFT JOIN t USING (election_key, municipality_id) LEFT JOIN (SELECT election_key, municipality_id, segment, CAST(sum(votes) AS BIGINT) AS votes FROM raws WHERE votes % 2 = 0 GROUP BY ALL) v USING (election_key, municipality_id, segment) WHERE t.electors IS NOT NULL OR v.votes IS NOT NULL")
def _(p):
    raws = made(p, RAWS)
    votes = raws.filter("votes % 2 = 0").groupBy(*_KEY, "segment").agg(F.sum("votes").alias("votes"))
    out = raws.select(*_KEY, "segment").distinct().join(p.tot.filter("electors % 3 = 0").select(*_KEY, "electors"), _KEY, "left").join(votes, [*_KEY, "segment"], "left")
    return out.filter("electors is not null or votes is not null").select(*_KEY, "segment", "electors", "votes")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("a07_declared_coverage", "SELECT election_key, greatest(coalesce(d, 0), coalesce(s, 0), coalesce(r, 0)) AS declared FROM (SELECT election_key, count(*) AS s FROM tot GROUP BY 1) FULL JOIN (SELECT election_key, count(*) AS r FROM res WHERE election_year < 2000 GROUP BY 1) USING (election_key) FULL JOIN (SELECT 'e1890' AS election_key, CAST(40 AS BIGINT) AS d UNION ALL SELECT 'e1996', 999999) USING (election_key)")
def _(p):
    n = lambda df: df.groupBy("election_key").agg(F.count(F.lit(1)).alias("n"))
    declared = p.spark.createDataFrame([("e1890", 40), ("e1996", 999_999)], "election_key string, n long")
    return reduce(DataFrame.unionByName, [n(p.tot), n(p.res.filter("election_year < 2000")), declared]).groupBy("election_key").agg(F.max("n").alias("declared"))


@query("a20_top_groups", "SELECT party_std, round(sum(share), 6) AS total FROM (SELECT s.party_std, CAST(100 AS DOUBLE) * votes / valid_votes AS share FROM std s JOIN tot USING (election_key, municipality_id)) GROUP BY 1 ORDER BY round(sum(share), 6) DESC, 1 LIMIT 5")
def _(p):
    share = p.std.select(*_KEY, "party_std", "votes").join(p.tot.select(*_KEY, "valid_votes"), _KEY).select("party_std", P.pct(F.col("votes"), F.col("valid_votes")).alias("share"))
    return share.groupBy("party_std").agg(F.round(F.sum("share"), 6).alias("total")).orderBy(F.desc("total"), "party_std").limit(5)


@query("a38_shared_domain", f"SELECT round(min(turnout_pct), 6) AS low, round(max(turnout_pct), 6) AS high, round(max(abs(first_second_margin)), 6) AS diverging, count(DISTINCT election_key) AS elections FROM summ WHERE election_key IN ('{LATEST}', '{BEFORE}')")
def _(p):
    two = p.cells.filter(F.col("election_key").isin(LATEST, BEFORE))
    s = P.summary(two)
    return s.agg(F.round(F.min("turnout_pct"), 6).alias("low"), F.round(F.max("turnout_pct"), 6).alias("high"), F.round(F.max(F.abs("first_second_margin")), 6).alias("diverging"), F.count_distinct("election_key").alias("elections"))


_LEVELS = f""", ov AS (SELECT s.*, o.votes AS own FROM summ s LEFT JOIN std o ON o.election_key = s.election_key AND o.municipality_id = s.municipality_id AND o.party_std = '{PARTY}'),
 lv AS (SELECT election_key, CASE WHEN grouping(province) = 1 THEN 'nation' ELSE 'province' END AS level, province, {_PCT} * sum(voters) / sum(electors) AS t, sum(first_second_margin * valid_votes) / sum(valid_votes) AS m, sum(first_party_share * valid_votes) / sum(valid_votes) AS fs, {_PCT} * sum(own) / sum(valid_votes) AS sh FROM ov GROUP BY GROUPING SETS ((election_key, province), (election_key))),
 cu AS (SELECT municipality_id, province, CAST(electors % 50 AS DOUBLE) AS value FROM tot WHERE election_key = '{LATEST}' AND electors % 3 <> 0), cm AS (SELECT province, avg(value) AS c FROM cu GROUP BY GROUPING SETS ((province), ()))"""
_CONTEXT_VALUES = {
    "party_share": "n.sh", "swing_compare": "n.sh - w.sh", "turnout": "n.t", "margin": "n.m", "delta_turnout": "n.t - w.t", "over_performance_province": "CASE WHEN n.level = 'province' THEN 0 ELSE ps.sh - ns.sh END",
    "over_performance_region": "CASE WHEN n.level = 'nation' THEN 0 ELSE ps.sh - ns.sh END", "stability_index": "met.stability", "custom_indicator": "cm.c", "volatility": "n.fs",
}


@query("a15_context_averages", _STAB + _LEVELS + " SELECT municipality_id, level, metric, value FROM (SELECT p.municipality_id, n.level, unnest([" + ", ".join(f"'{k}'" for k in _CONTEXT_VALUES) + "]) AS metric, unnest([" + ", ".join(f"round(CAST({v} AS DOUBLE), 6)" for v in _CONTEXT_VALUES.values()) + f"""]) AS value FROM (SELECT municipality_id, province FROM tot WHERE election_key = '{LATEST}') p
 JOIN lv n ON n.election_key = '{LATEST}' AND (n.level = 'nation' OR n.province = p.province) LEFT JOIN lv w ON w.election_key = '{BEFORE}' AND w.level = n.level AND w.province IS NOT DISTINCT FROM n.province LEFT JOIN cm ON cm.province IS NOT DISTINCT FROM n.province JOIN lv ns ON ns.election_key = '{LATEST}' AND ns.level = 'nation' JOIN lv ps ON ps.election_key = '{LATEST}' AND ps.province = p.province LEFT JOIN met ON met.municipality_id = p.municipality_id)""")
def _(p):
    custom = p.tot.filter((F.col("election_key") == LATEST) & (F.col("electors") % 3 != 0)).select("municipality_id", "province", (F.col("electors") % 50).cast("double").alias("value"))
    stable = T.history(_cells(p)).select("municipality_id", "stability_index")
    return R.context_averages(p.cells, PARTY, LATEST, BEFORE, stable, custom).select("municipality_id", "level", "metric", *r6("value"))


@query("a17_block_matrix", f"SELECT coalesce(a.dominant_block, '—') AS before, coalesce(b.dominant_block, '—') AS after, count(*) AS n FROM summ a JOIN summ b USING (municipality_id) WHERE a.election_key = '{BEFORE}' AND b.election_key = '{LATEST}' GROUP BY ALL")
def _(p):
    return P.transitions(p.summ, BEFORE, LATEST).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("a17_change_counts", f"SELECT count(CASE WHEN a.first_party_std <> b.first_party_std THEN 1 END) AS leaders, count(CASE WHEN coalesce(a.dominant_block, '—') <> coalesce(b.dominant_block, '—') THEN 1 END) AS blocks, count(*) AS places FROM summ a JOIN summ b USING (municipality_id) WHERE a.election_key = '{BEFORE}' AND b.election_key = '{LATEST}'")
def _(p):
    n = lambda c: F.count(F.when(c, 1))
    return P.transitions(p.summ, BEFORE, LATEST).agg(n(F.col("leader_before") != F.col("leader_after")).alias("leaders"), n(F.col("before") != F.col("after")).alias("blocks"), F.count(F.lit(1)).alias("places"))


# --- archetypes and clusters ----------------------------------------------------------------------------------------

_ARCH = _STAB + f""", tier AS (SELECT municipality_id, CASE WHEN avg(turnout_pct) >= 82 THEN 'alta' WHEN avg(turnout_pct) >= 72 THEN 'intermedia' WHEN avg(turnout_pct) IS NOT NULL THEN 'bassa' ELSE 'n/d' END AS tier FROM summ GROUP BY 1),
 ps AS (SELECT t.province, {_PCT} * v / d AS ps FROM (SELECT province, sum(valid_votes) AS d FROM tot WHERE election_key = '{LATEST}' GROUP BY 1) t LEFT JOIN (SELECT province, sum(votes) AS v FROM std WHERE election_key = '{LATEST}' AND party_std = '{PARTY}' GROUP BY 1) s USING (province)),
 ar AS (SELECT s.municipality_id, concat_ws(' · ', CASE WHEN dominant_block <> 'altro' THEN dominant_block END, tier, CASE WHEN stability >= 72 THEN 'forte continuità' WHEN changes >= 4 THEN 'leader mobili' WHEN volatility >= 9 THEN 'volatilità alta' ELSE 'profilo intermedio' END, CASE WHEN o.share - ps.ps >= 4 THEN 'sopra provincia' WHEN o.share - ps.ps <= -4 THEN 'sotto provincia' END) AS label
 FROM summ s JOIN own o USING (election_key, municipality_id) JOIN met ON met.municipality_id = s.municipality_id JOIN tier ON tier.municipality_id = s.municipality_id LEFT JOIN ps ON ps.province = s.province WHERE s.election_key = '{LATEST}')"""


def archetypes(p: Panel) -> DataFrame:
    """A place's block, turnout tier, continuity and gap to its province, as one label."""
    now = _cells(p).filter(F.col("election_key") == LATEST)
    tot, std = p.tot.filter(F.col("election_key") == LATEST), p.std.filter((F.col("election_key") == LATEST) & (F.col("party_std") == PARTY))
    ps = tot.groupBy("province").agg(F.sum("valid_votes").alias("d")).join(std.groupBy("province").agg(F.sum("votes").alias("v")), "province", "left").select("province", P.pct(F.col("v"), F.col("d")).alias("ps"))
    rows = now.join(metrics(p), "municipality_id").join(T.turnout_tier(p.summ), "municipality_id").join(F.broadcast(ps), "province", "left")
    gap = F.col("share") - F.col("ps")
    tags = [
        F.when(F.col("dominant_block") != "altro", F.col("dominant_block")), F.col("tier"),
        F.when(F.col("stability") >= 72, "forte continuità").when(F.col("changes") >= 4, "leader mobili").when(F.col("volatility") >= 9, "volatilità alta").otherwise("profilo intermedio"),
        F.when(gap >= 4, "sopra provincia").when(gap <= -4, "sotto provincia"),
    ]
    return rows.select("municipality_id", F.concat_ws(" · ", *tags).alias("label"))


@query("m05_archetypes", _ARCH + " SELECT * FROM ar")
def _(p):
    return archetypes(p)


@query("m06_fallback_label", _STAB + """, tier AS (SELECT municipality_id, CASE WHEN avg(turnout_pct) >= 82 THEN 'alta' WHEN avg(turnout_pct) >= 72 THEN 'intermedia' WHEN avg(turnout_pct) IS NOT NULL THEN 'bassa' ELSE 'n/d' END AS tier FROM summ GROUP BY 1), bl AS (SELECT municipality_id, dominant_block, row_number() OVER (PARTITION BY municipality_id ORDER BY count(*) DESC, dominant_block) AS k FROM summ WHERE dominant_block IS NOT NULL GROUP BY municipality_id, dominant_block)
 SELECT met.municipality_id, concat_ws(' · ', coalesce(dominant_block, 'altro'), tier, CASE WHEN volatility IS NULL THEN 'volatilità n/d' WHEN volatility >= 10 THEN 'alta volatilità' WHEN volatility >= 5 THEN 'volatilità media' ELSE 'bassa volatilità' END, CASE WHEN changes >= 4 THEN 'molti cambi' WHEN changes >= 2 THEN 'alcuni cambi' ELSE 'stabile' END) AS label FROM met JOIN tier USING (municipality_id) LEFT JOIN bl ON bl.municipality_id = met.municipality_id AND k = 1""")
def _(p):
    block = p.summ.filter("dominant_block is not null").groupBy("municipality_id", "dominant_block").agg(F.count(F.lit(1)).alias("n")).groupBy("municipality_id").agg(F.min_by("dominant_block", F.struct(-F.col("n"), "dominant_block")).alias("block"))
    rows = metrics(p).join(T.turnout_tier(p.summ), "municipality_id").join(block, "municipality_id", "left")
    return rows.select("municipality_id", C.fallback_label(F.coalesce("block", F.lit("altro")), F.col("tier"), F.col("volatility"), F.col("changes")).alias("label"))


@query("m03_cluster_labels", _VECTORS + " SELECT municipality_id, concat_ws(' · ', CASE WHEN f[1] >= 20 THEN 'quota alta' WHEN f[1] >= 10 THEN 'quota media' ELSE 'quota bassa' END, CASE WHEN f[2] >= 8 THEN 'volatile' ELSE 'più stabile' END, CASE WHEN f[3] >= 60 THEN 'dominanza stabile' WHEN f[5] >= 3 THEN 'leader mobili' ELSE 'equilibrato' END, CASE WHEN f[4] >= 75 THEN 'alta affluenza' ELSE 'affluenza intermedia' END) AS label FROM vec")
def _(p):
    """What the label says of each place's own vector."""
    return vectors(p).select("municipality_id", C.cluster_label().alias("label"))


# --- order, search, sets --------------------------------------------------------------------------------------------

_SORTERS = {"turnout": "turnout_pct", "party": "share", "margin": "first_second_margin", "swing": "swing", "volatility": "volatility", "dominance_changes": "changes", "stability": "stability", "over_province": "over_p", "over_nation": "over_n"}


@query("o01_sorters", _STAB + f""", w AS (SELECT s.municipality_id, s.turnout_pct, s.first_second_margin, o.share, o.share - b.share AS swing, volatility, CAST(changes AS DOUBLE) AS changes, stability, o.share - {_PCT} * pv / pd AS over_p, o.share - {_PCT} * nv / nd AS over_n FROM summ s JOIN own o USING (election_key, municipality_id) LEFT JOIN own b ON b.election_key = '{BEFORE}' AND b.municipality_id = s.municipality_id JOIN met ON met.municipality_id = s.municipality_id
 LEFT JOIN (SELECT province, sum(valid_votes) AS pd FROM tot WHERE election_key = '{LATEST}' GROUP BY 1) pd ON pd.province = s.province LEFT JOIN (SELECT province, sum(votes) AS pv FROM std WHERE election_key = '{LATEST}' AND party_std = '{PARTY}' GROUP BY 1) pv ON pv.province = s.province CROSS JOIN (SELECT sum(valid_votes) AS nd FROM tot WHERE election_key = '{LATEST}') CROSS JOIN (SELECT sum(votes) AS nv FROM std WHERE election_key = '{LATEST}' AND party_std = '{PARTY}') WHERE s.election_key = '{LATEST}'),
 """ + ", ".join(f"s_{k} AS (SELECT '{k}' AS sorter, municipality_id, round({c}, 6) AS value FROM w ORDER BY round({c}, 6) DESC NULLS LAST, municipality_id LIMIT 10)" for k, c in _SORTERS.items()) + ", s_name AS (SELECT 'name' AS sorter, municipality_id, CAST(NULL AS DOUBLE) AS value FROM w ORDER BY municipality_id LIMIT 10) " + " UNION ALL ".join(f"SELECT * FROM s_{k}" for k in [*_SORTERS, "name"]))
def _(p):
    rows = P.sort_values(_cells(p), p.summ, p.std, p.tot, metrics(p), PARTY, LATEST, BEFORE)
    # One pass for all sorters: a top-k per sorter by rank, which tasks keep before the shuffle.
    long = rows.select("municipality_id", F.explode(F.array(*[F.struct(F.lit(k).alias("sorter"), F.round(F.col(c).cast("double"), 6).alias("value")) for k, c in _SORTERS.items()], F.struct(F.lit("name").alias("sorter"), F.lit(None).cast("double").alias("value")))).alias("s")).select("municipality_id", "s.*")
    return long.withColumn("k", F.row_number().over(Window.partitionBy("sorter").orderBy(F.desc_nulls_last("value"), "municipality_id"))).filter("k <= 10").drop("k")


@query("o03_all_rankings", _VOL + f", r AS (SELECT 'top' AS list, municipality_id, first_second_margin AS v, -first_second_margin AS o FROM summ WHERE election_key = '{LATEST}' UNION ALL SELECT 'bottom', municipality_id, turnout_pct, turnout_pct FROM summ WHERE election_key = '{LATEST}' UNION ALL SELECT 'tightest', municipality_id, first_second_margin, first_second_margin FROM summ WHERE election_key = '{LATEST}' UNION ALL SELECT 'volatile', municipality_id, volatility, -volatility FROM vol) SELECT list, municipality_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY round(o, 6), municipality_id) AS k FROM r WHERE v IS NOT NULL) WHERE k <= 6")
def _(p):
    now = p.summ.filter(F.col("election_key") == LATEST)
    part = lambda name, c, sign: F.struct(F.lit(name).alias("list"), F.col(c).alias("v"), (F.lit(float(sign)) * F.col(c)).alias("o"))
    lists = now.select("municipality_id", F.explode(F.array(part("top", "first_second_margin", -1), part("bottom", "turnout_pct", 1), part("tightest", "first_second_margin", 1))).alias("x"))
    lists = lists.unionByName(T.volatility(p.own).select("municipality_id", part("volatile", "volatility", -1).alias("x"))).select("municipality_id", "x.*").filter("v is not null")
    w = Window.partitionBy("list").orderBy(F.round("o", 6), "municipality_id")
    return lists.withColumn("k", F.row_number().over(w)).filter("k <= 6").select("list", "municipality_id", F.round("v", 6).alias("value"))


@query("o04_compare_lists", _CELLS + f""", d AS (SELECT a.municipality_id, a.share - b.share AS swing, a.turnout_pct - b.turnout_pct AS dt, a.first_party_std AS l1, b.first_party_std AS l0 FROM cell a JOIN cell b USING (municipality_id) WHERE a.election_key = '{LATEST}' AND b.election_key = '{BEFORE}'), r AS (SELECT 'gains' AS list, municipality_id, swing AS v, -swing AS o, 8 AS m FROM d UNION ALL SELECT 'losses', municipality_id, swing, swing, 8 FROM d UNION ALL SELECT 'turnout', municipality_id, dt, -dt, 6 FROM d UNION ALL SELECT 'flips', municipality_id, 1, 0, 8 FROM d WHERE l1 <> l0)
 SELECT list, municipality_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY round(o, 6), municipality_id) AS k FROM r WHERE v IS NOT NULL) WHERE k <= m""")
def _(p):
    c = _cells(p)
    now = c.filter(F.col("election_key") == LATEST)
    was = c.filter(F.col("election_key") == BEFORE).select("municipality_id", F.col("share").alias("s0"), F.col("turnout_pct").alias("t0"), F.col("first_party_std").alias("l0"))
    d = now.join(was, "municipality_id").select("municipality_id", (F.col("share") - F.col("s0")).alias("swing"), (F.col("turnout_pct") - F.col("t0")).alias("dt"), (F.col("first_party_std") != F.col("l0")).alias("flip"))
    part = lambda name, v, o, m: F.struct(F.lit(name).alias("list"), v.alias("v"), o.alias("o"), F.lit(m).alias("m"))
    swing, dt, one = F.col("swing"), F.col("dt"), F.when(F.col("flip"), F.lit(1.0))
    lists = d.select("municipality_id", F.explode(F.array(part("gains", swing, -swing, 8), part("losses", swing, swing, 8), part("turnout", dt, -dt, 6), part("flips", one, F.lit(0.0), 8))).alias("x")).select("municipality_id", "x.*").filter("v is not null")
    return lists.withColumn("k", F.row_number().over(Window.partitionBy("list").orderBy(F.round("o", 6), "municipality_id"))).filter("k <= m").select("list", "municipality_id", F.round("v", 6).alias("value"))


_NO = "CAST(municipality_id AS BIGINT)"
_FOUND_IN = [f"SELECT municipality_id AS id, {_NO} AS ord, concat(province, ' ', geometry_id) AS text FROM ms", f"SELECT municipality_id AS id, {_NO} AS ord, concat('Al', {_NO} * 7 % 1000, ' type') AS text FROM ms WHERE {_NO} % 3 = 0", f"SELECT municipality_id AS id, {_NO} AS ord, concat('SUM ', municipality_id) AS text FROM ms"]
_SEARCHED = f"SELECT DISTINCT CASE {_NO} % 10 WHEN 0 THEN concat(' G', {_NO} % 700) WHEN 1 THEN concat('AL', {_NO} * 7 % 1000) WHEN 2 THEN concat('sum ', municipality_id) WHEN 3 THEN concat('no ', municipality_id) WHEN 4 THEN substring(province, 8, 1) WHEN 5 THEN ' ' WHEN 6 THEN '9' ELSE NULL END AS query FROM ms"


@query("o07_search", _MASTER + f", qs AS ({_SEARCHED}), al AS (" + " UNION ALL ".join(f"SELECT {i} AS source, * FROM ({x})" for i, x in enumerate(_FOUND_IN)) + ") SELECT query, source, id FROM (SELECT query, source, id, row_number() OVER (PARTITION BY query ORDER BY source, ord, id) AS k FROM qs JOIN al ON trim(query) <> '' AND contains(lower(text), lower(trim(query)))) WHERE k = 1")
def _(p):
    ms = _master(p)
    on = lambda sql: p.spark.sql(sql.replace("FROM ms", "FROM {ms}"), ms=ms)
    return V.search(on(_SEARCHED), *[on(x) for x in _FOUND_IN])


@query("w13_rank_position", f"SELECT 1 + count(*) AS position FROM summ a, (SELECT turnout_pct AS t FROM summ WHERE election_key = '{LATEST}' AND municipality_id = '1287') o WHERE election_key = '{LATEST}' AND (turnout_pct > t OR (turnout_pct = t AND municipality_id < '1287'))")
def _(p):
    one = P.totals(p.cells.filter(F.col("election_key") == LATEST)).select("municipality_id", P.pct(F.col("voters"), F.col("electors")).alias("t"))
    own = one.filter("municipality_id = '1287'").select(F.col("t").alias("t0"))  # one row; counting those before it needs no global sort
    before = (F.col("t") > F.col("t0")) | ((F.col("t") == F.col("t0")) & (F.col("municipality_id") < "1287"))
    return one.crossJoin(F.broadcast(own)).agg((F.count(F.when(before, 1)) + 1).alias("position"))


@query("w17_u03_latest_row", "SELECT municipality_id, election_key, electors FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id ORDER BY election_year DESC) AS k FROM tot) WHERE k = 1")
def _(p):
    return I.first_of(p.tot, ["municipality_id"], F.desc("election_year")).select("municipality_id", "election_key", "electors")


@query("w18_best_candidate", _R + " SELECT municipality_id, election_key FROM (SELECT municipality_id, election_key, row_number() OVER (PARTITION BY municipality_id ORDER BY n DESC, valid_votes DESC, voters DESC, electors DESC, election_key) AS k FROM tot JOIN (SELECT election_key, municipality_id, count(*) AS n FROM raws GROUP BY ALL) USING (election_key, municipality_id)) WHERE k = 1")
def _(p):
    n = made(p, RAWS).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = p.tot.join(n, _KEY)
    return rows.groupBy("municipality_id").agg(F.min_by("election_key", F.struct(-F.col("n"), -F.col("valid_votes"), -F.col("voters"), -F.col("electors"), "election_key")).alias("election_key"))


@query("u01_union_all", f"SELECT election_key, municipality_id, electors, CAST(NULL AS BIGINT) AS extra FROM tot WHERE election_key = '{BEFORE}' UNION ALL SELECT election_key, municipality_id, electors, voters FROM tot WHERE election_key = '{LATEST}'")
def _(p):
    frames = [p.tot.filter(F.col("election_key") == BEFORE).select(*_KEY, "electors"), p.tot.filter(F.col("election_key") == LATEST).select(*_KEY, "electors", F.col("voters").alias("extra"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@query("u04_key_sets", "SELECT 'missing' AS kind, election_key FROM (SELECT 'e1890' AS election_key UNION ALL SELECT 'e1996') EXCEPT SELECT 'missing', election_key FROM tot UNION ALL (SELECT DISTINCT 'undeclared', election_key FROM tot WHERE election_key <> 'e1996')")
def _(p):
    declared, have = p.spark.createDataFrame([("e1890",), ("e1996",)], "election_key string"), p.tot.select("election_key").distinct()
    return declared.exceptAll(have).select(F.lit("missing").alias("kind"), "election_key").unionByName(have.exceptAll(declared).select(F.lit("undeclared").alias("kind"), "election_key"))


@query("u05_note_union", "SELECT DISTINCT election_key, CASE WHEN election_year % 2 = 0 THEN 'a|b|c' ELSE 'b|c|a' END AS note FROM tot")
def _(p):
    e = p.tot.select("election_key", "election_year").distinct()
    own = F.when(F.col("election_year") % 2 == 0, F.lit("a| b|a")).otherwise(F.lit("b"))
    return e.select("election_key", X.join_notes(own, F.lit("|b |c|"), F.lit("a")).alias("note"))


# --- text -----------------------------------------------------------------------------------------------------------


_DAY = "electors % 33, '/', voters % 14, '/', election_year"
_TEXTS = {"a": "concat(' ', province, ' \n ', region, '  ')", "b": "CASE WHEN electors % 3 = 0 THEN concat(province, 'x') ELSE concat(province, ' ', electors % 50) END", "d": f"concat('del ', {_DAY}, ' x')", "e": "CASE electors % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat(' ', region) END", "f": "CASE WHEN voters % 2 = 0 THEN province END"}


@query("f15_f21_f26_f33_texts", f""" SELECT election_key, municipality_id, concat(lower(province), ' ', lower(region)) AS squeezed, CASE WHEN electors % 3 = 0 THEN concat(province, 'x') ELSE province END AS base, TRY_CAST(concat(election_year, '-', lpad(CAST(voters % 14 AS VARCHAR), 2, '0'), '-', lpad(CAST(electors % 33 AS VARCHAR), 2, '0')) AS DATE) AS day,
 CASE WHEN electors % 4 > 1 THEN region WHEN voters % 2 = 0 THEN province END AS first_text FROM tot""")
def _(p):
    t = p.tot.selectExpr(*_KEY, *[f"{sql} AS {c}" for c, sql in _TEXTS.items()])
    return t.select(*_KEY, X.squeeze(F.col("a")).alias("squeezed"), X.base_name(F.col("b")).alias("base"), X.iso_date(F.col("d")).alias("day"), X.first_nonempty(F.col("e"), F.col("f")).alias("first_text"))


@query("f09_token_texts", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'))) AS token FROM documents", prelude=False)
def _(p):
    docs = p.spark.read.parquet(f"{p.sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(X.token(F.coalesce("text", F.lit("")))).alias("token"))


# Urls and paths of eight kinds, made of the pages' own, with what is to become of them: code, canonical, rewritten.
_B = "regexp_extract(url, '^([^?#]*)', 1)"
_URLS = [
    (f"concat({_B}, '?lev4=', page_id, '-3&unipro=uni&lev3=9&levsut0=3')", "CAST(page_id AS VARCHAR)", f"concat({_B}, '?lev4=', page_id, '-3&lev3=9')", f"concat({_B}, '?lev3=9&lev4=', page_id, '-3&levsut0=3&tpe=C&unipro=uni')"),
    (f"concat({_B}, '?unipro=uni&lev4=0&lev3=', page_id + 1)", "CAST(page_id + 1 AS VARCHAR)", f"concat({_B}, '?lev4=0&lev3=', page_id + 1)", f"concat({_B}, '?lev3=', page_id + 1, '&lev4=0&tpe=C&unipro=uni')"),
    (f"concat({_B}, '?z=1&lev3=roma-lev31', page_id, '&a=%C3%A9+x&a=*~#top')", "'roma'", f"concat({_B}, '?z=1&lev3=roma-lev31', page_id, '&a=%C3%A9+x&a=*~#top')", f"concat({_B}, '?a=%2A~&es3=N&lev3=1', page_id, '&levsut3=3&ne3=roma&tpe=C&z=1')"),
    (f"concat({_B}, '?lev1=x-lev24', page_id, '&es2=Y&b&&ne3=0')", "''", f"concat({_B}, '?lev1=x-lev24', page_id, '&es2=Y&b&ne3=0')", f"concat({_B}, '?b=&es2=Y&lev1=x-lev24', page_id, '&lev2=4', page_id, '&levsut2=2&ne2=x&ne3=0')"),
    (f"concat({_B}, '?ne2=a-lev11-lev22&lev3=0')", "''", f"concat({_B}, '?ne2=a-lev11-lev22&lev3=0')", f"concat({_B}, '?es2=N&lev2=2&lev3=0&levsut2=2&ne2=a-lev11')"),
    (f"concat({_B}, '?levsut0=7')", "''", _B, f"concat({_B}, '?levsut0=7')"), ("NULL", "''", "''", "''"), ("concat('no url ', page_id)", "''", "concat('no url ', page_id)", "concat('no url ', page_id)"),
]
_url = lambda i: "CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {row[i]}" for k, row in enumerate(_URLS)) + " END"
_PATHS = ["concat('plain ', page_id)", "concat('/home/a/f', page_id, '.csv')", "concat('/mnt/x python run ', page_id)", "NULL", "concat('C:', chr(92), 'b', chr(92), 'd', page_id)"]
_PATHS_AFTER = ["concat('plain ', page_id)", "concat('f', page_id, '.csv')", "'[redacted-path-string]'", "NULL", "concat('d', page_id)"]
_path = lambda rows: "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(rows)) + " END"


@query("f23_f24_f29_urls", f"SELECT page_id, {_url(1)} AS code, {_url(2)} AS url, {_url(3)} AS rewritten, {_path(_PATHS_AFTER)} AS path FROM pages", prelude=False)
def _(p):
    t = p.spark.read.parquet(f"{p.sf_dir}/pages.parquet").selectExpr("page_id", f"{_url(0)} AS u", f"{_path(_PATHS)} AS s")
    u = F.col("u")
    return t.select("page_id", X.code_from_url(u).alias("code"), X.canonical_url(u).alias("url"), X.historical_url(u).alias("rewritten"), X.redacted_path(F.col("s")).alias("path"))


@query("f27_named_region", "SELECT DISTINCT party_raw, CASE WHEN contains(concat(' ', lower(party_raw), ' '), ' economy ') THEN 'E' WHEN contains(concat(' ', lower(party_raw), ' '), ' steel ') THEN 'S' WHEN starts_with(trim(regexp_replace(lower(party_raw), '[^a-z0-9]+', ' ', 'g')), 'brand 1') THEN 'B' ELSE '' END AS region FROM res")
def _(p):
    return p.res.select("party_raw").distinct().select("party_raw", X.named_region(F.col("party_raw"), {"steel": "S", "economy": "E", "brand 1": "B"}).alias("region"))


@query("f02_f12_percentages", "SELECT election_key, municipality_id, CASE WHEN electors > 100 AND electors <= 10000 THEN CAST(electors AS DOUBLE) / 100 ELSE CAST(electors AS DOUBLE) END AS pct, CASE WHEN electors > 1 THEN CAST(electors AS DOUBLE) / 100 ELSE electors END AS from_basis_points, greatest(0, least(100, electors - 150)) AS clamped FROM tot")
def _(p):
    e = F.col("electors").cast("double")
    return p.tot.select(*_KEY, N.safe_pct(e).alias("pct"), N.safe_pct(e, True).alias("from_basis_points"), N.clamp100(F.col("electors") - 150).alias("clamped"))


@query("p09_scope", "SELECT election_key, municipality_id FROM tot WHERE CASE WHEN electors % 3 = 0 THEN lower(province) IN ('nation_1', 'nation_2') ELSE contains(lower(region), 'a') END")
def _(p):
    province = F.when(F.col("electors") % 3 == 0, F.lower("province"))  # elsewhere the constituency's text tells
    return p.tot.filter(F.when(province.isNotNull(), province.isin("nation_1", "nation_2")).otherwise(F.lower("region").contains("a"))).select(*_KEY)


@query("g04_g05_g07_hit_test", """, pt AS (SELECT municipality_id AS key, CAST(CAST(municipality_id AS BIGINT) * 37 % 400 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS x, CAST(CAST(municipality_id AS BIGINT) * 91 % 300 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y FROM (SELECT DISTINCT municipality_id FROM tot)),
 ed(id, ord, ax, ay, ex, ey) AS (VALUES ('tri', 1, 0, 0, 200, 0), ('tri', 1, 200, 0, 100, 250), ('tri', 1, 100, 250, 0, 0), ('box', 2, 150, 50, 390, 50), ('box', 2, 390, 50, 390, 200), ('box', 2, 390, 200, 150, 200), ('box', 2, 150, 200, 150, 50)),
 hit AS (SELECT key, x, y, id, ord FROM pt, ed WHERE (ay > y) <> (ey > y) AND x < CAST(ex - ax AS DOUBLE) * (y - ay) / (ey - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
 SELECT key, arg_max(id, ord) AS id, any_value(abs(x) > 360 OR abs(y) > 180) AS projected FROM hit GROUP BY 1""")
def _(p):
    n = F.col("key").cast("long")
    points = p.tot.select(F.col("municipality_id").alias("key")).distinct().select("key", ((n * 37 % 400).cast("double") + 0.5).alias("x"), ((n * 91 % 300).cast("double") + 0.25).alias("y"))
    shapes = p.spark.createDataFrame([("tri", 1, [(0.0, 0.0), (200.0, 0.0), (100.0, 250.0)]), ("box", 2, [(150.0, 50.0), (390.0, 50.0), (390.0, 200.0), (150.0, 200.0)])], "id string, ord int, ring array<struct<x double, y double>>")
    return G.hit_test(points, shapes, 32.0).join(points, "key").select("key", "id", G.is_projected(F.col("x"), F.col("y")).alias("projected"))


@query("r03_vertices", " SELECT municipality_id, count(*) + least(2, count(*)) AS n FROM tot GROUP BY 1")
def _(p):
    """Two rings a place: a corner an election, and the first two of them again."""
    corner = F.array(F.col("election_year").cast("double"), F.col("electors").cast("double"))
    rings = p.tot.groupBy("municipality_id").agg(F.array_sort(F.collect_list(corner)).alias("ring"))
    return rings.select("municipality_id", G.vertices(F.array("ring", F.slice("ring", 1, 2))).alias("n"))


@query("a18_archetype_distribution", _ARCH + ", k AS (SELECT label, municipality_id, row_number() OVER (PARTITION BY label ORDER BY municipality_id) AS i FROM ar) SELECT label, count(*) AS n, string_agg(CASE WHEN i <= 6 THEN municipality_id END, '|' ORDER BY municipality_id) AS first_places FROM k GROUP BY 1 ORDER BY n DESC, label LIMIT 6")
def _(p):
    return R.label_distribution(archetypes(p), 6, 6)


@query("a34_release_counts", "SELECT CASE WHEN kind = 0 THEN 'csv' ELSE 'json' END AS kind, count(*) AS files, CAST(sum(electors) AS BIGINT) AS bytes FROM (SELECT electors % 2 AS kind, electors FROM tot) GROUP BY 1")
def _(p):
    return p.tot.groupBy(F.when(F.col("electors") % 2 == 0, "csv").otherwise("json").alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("electors").alias("bytes"))
