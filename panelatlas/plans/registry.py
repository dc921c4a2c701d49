"""Registered panel queries, each with its DuckDB SQL. Names start with the operators' ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import PRELUDE, TABLES
from ..fixtures import cells as fixture_cells
from ..functions import numeric as N
from ..functions import text as X
from ..functions.taxonomy import classify
from ..operators import cluster as C
from ..operators import panel as P
from ..operators import quality as Q
from ..operators import trajectory as T
from ..sources.panel_store import PanelStore, exchanging, fingerprint, parts_of
from ..streaming.incremental import replace_by_key

PARTY = "Brand#12"
LATEST, BEFORE = "e2000", "e1999"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


STORES: dict[tuple, PanelStore] = {}


class Panel:
    """The panel's tables over one data folder, as lazy plans over its stored cells. A session stores a folder's panel when it
    is first asked for, and anew when the folder's files have changed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        files = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])
        key = (spark.sparkContext.applicationId, files)
        if key not in STORES:
            n = parts_of(spark, files)
            with exchanging(spark, n):
                STORES[key] = PanelStore.write(fixture_cells(spark, sf_dir, n), buckets=n, dealt=True)
        self.store = STORES[key]
        self.cells = self.store.cells()
        self.tot, self.res, self.std, self.summ = P.totals(self.cells), P.results(self.cells), P.by_party(self.cells), P.summary(self.cells)
        self.own = P.own_share(self.cells, PARTY)


def query(name: str, sql: str | None, prelude: bool = True):
    def add(f: Callable[[Panel], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Panel(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"WITH {PRELUDE}{sql}" if prelude else sql
        return f

    return add


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


_OWN = f""", own AS (SELECT t.election_key, t.election_year, t.municipality_id, t.province, t.region, CAST(100 AS DOUBLE) * s.votes / t.valid_votes AS share
 FROM tot t LEFT JOIN std s ON s.election_key = t.election_key AND s.municipality_id = t.municipality_id AND s.party_std = '{PARTY}')"""
_VOL = _OWN + """, vol AS (SELECT municipality_id, avg(step) AS volatility FROM (SELECT municipality_id, abs(share - lag(share) OVER (PARTITION BY municipality_id ORDER BY election_year)) AS step FROM own WHERE share IS NOT NULL) GROUP BY 1),
 chg AS (SELECT m.municipality_id, CAST(coalesce(sum(CASE WHEN b <> first_party_std THEN 1 ELSE 0 END), 0) AS BIGINT) AS changes FROM (SELECT DISTINCT municipality_id FROM tot) m LEFT JOIN
  (SELECT municipality_id, first_party_std, lag(first_party_std) OVER (PARTITION BY municipality_id ORDER BY election_year) AS b FROM summ WHERE first_party_std IS NOT NULL) x USING (municipality_id) GROUP BY 1)"""
_PCT = "CAST(100 AS DOUBLE)"
_SHARE = f"SELECT election_key, province, mode, grp, sum(votes) AS votes FROM (SELECT election_key, province, votes, unnest(['party_raw', 'party_std', 'party_family', 'bloc']) AS mode, unnest([party_raw, party_std, party_family, bloc]) AS grp FROM res) GROUP BY ALL"


def over_performance(p: Panel, election: str, top: int | None = None) -> DataFrame:
    """Own share against the province's and the nation's."""
    one = p.cells.filter(F.col("election_key") == election)
    own = P.own_share(one, PARTY)
    province = one.groupBy("province").agg(F.sum(P.own_votes(PARTY)).alias("v"), F.sum("valid_votes").alias("d"))
    nation = province.agg(P.pct(F.sum("v"), F.sum("d")).alias("nation_share"))  # one row
    province = province.filter("v is not null").select("province", P.pct(F.col("v"), F.col("d")).alias("province_share"))
    out = own.join(province, "province", "left").crossJoin(F.broadcast(nation)).select(
        "municipality_id", "province", F.round("share", 6).alias("share"), F.round(F.col("share") - F.col("province_share"), 6).alias("over_province"), F.round(F.col("share") - F.col("nation_share"), 6).alias("over_nation"))
    return out if top is None else out.orderBy(F.desc_nulls_last("over_province"), "municipality_id").limit(top)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_performance(Panel(spark, sf_dir), LATEST, 20)


_OVER = _OWN + f""" SELECT o.municipality_id, o.province, round(share, 6) AS share, round(share - ps, 6) AS over_province, round(share - ns, 6) AS over_nation FROM own o
 LEFT JOIN (SELECT t.province, {_PCT} * v / d AS ps FROM (SELECT province, sum(valid_votes) AS d FROM tot WHERE election_key = '{LATEST}' GROUP BY 1) t LEFT JOIN (SELECT province, sum(votes) AS v FROM std WHERE election_key = '{LATEST}' AND party_std = '{PARTY}' GROUP BY 1) s USING (province)) USING (province)
 CROSS JOIN (SELECT {_PCT} * (SELECT sum(votes) FROM std WHERE election_key = '{LATEST}' AND party_std = '{PARTY}') / (SELECT sum(valid_votes) FROM tot WHERE election_key = '{LATEST}') AS ns) WHERE o.election_key = '{LATEST}'"""


@query("j19_over_performance", _OVER)
def _(p):
    return over_performance(p, LATEST)


@query("o01_top_over_performance", f"{_OVER} ORDER BY over_province DESC NULLS LAST, municipality_id LIMIT 20")
def _(p):
    return over_performance(p, LATEST, 20)


@query("a27_summary", "SELECT election_key, municipality_id, province, electors, voters, valid_votes, round(turnout_pct, 6) AS turnout_pct, first_party_std, round(first_party_share, 6) AS first_party_share, second_party_std, round(second_party_share, 6) AS second_party_share, round(first_second_margin, 6) AS first_second_margin, dominant_block FROM summ")
def _(p):
    return p.summ.select("election_key", "municipality_id", "province", "electors", "voters", "valid_votes", *r6("turnout_pct"), "first_party_std", *r6("first_party_share"), "second_party_std", *r6("second_party_share", "first_second_margin"), "dominant_block")


@query("a01_a02_rollup", f"""SELECT election_key, province, region, level, CAST(electors AS BIGINT) AS electors, CAST(voters AS BIGINT) AS voters, CAST(valid AS BIGINT) AS valid_votes, n, round(turnout, 6) AS turnout, round(margin, 6) AS margin, round(first_share, 6) AS first_share FROM (
 SELECT election_key, province, region, CASE WHEN grouping(province) = 0 THEN 'province' WHEN grouping(region) = 0 THEN 'region' ELSE 'nation' END AS level, sum(electors) AS electors, sum(voters) AS voters, sum(valid_votes) AS valid, count(*) AS n,
 {_PCT} * sum(voters) / sum(electors) AS turnout, CASE WHEN sum(valid_votes) > 0 THEN sum(first_second_margin * valid_votes) / sum(valid_votes) ELSE avg(first_second_margin) END AS margin, CASE WHEN sum(valid_votes) > 0 THEN sum(first_party_share * valid_votes) / sum(valid_votes) ELSE avg(first_party_share) END AS first_share
 FROM summ GROUP BY GROUPING SETS ((election_key, province, region), (election_key, region), (election_key)))""")
def _(p):
    return P.rollup(p.summ).select("election_key", "province", "region", "level", "electors", "voters", "valid_votes", "n", *r6("turnout", "margin", "first_share"))


@query("a03_province_group_share", f"SELECT g.election_key, g.province, mode, grp, CAST(votes AS BIGINT) AS votes, round({_PCT} * votes / d, 6) AS share FROM ({_SHARE}) g JOIN (SELECT election_key, province, sum(valid_votes) AS d FROM tot GROUP BY ALL) USING (election_key, province)")
def _(p):
    return P.group_shares(p.res, p.tot, True).select("election_key", "province", "mode", "grp", "votes", *r6("share"))


@query("a03_national_group_share", f"SELECT g.election_key, mode, grp, CAST(sum(votes) AS BIGINT) AS votes, round({_PCT} * sum(votes) / any_value(d), 6) AS share FROM ({_SHARE}) g JOIN (SELECT election_key, sum(valid_votes) AS d FROM tot GROUP BY ALL) USING (election_key) GROUP BY ALL")
def _(p):
    return P.group_shares(p.res, p.tot, False).select("election_key", "mode", "grp", "votes", *r6("share"))


@query("a04_party_share", _OWN + " SELECT election_key, municipality_id, round(share, 6) AS share FROM own")
def _(p):
    return p.own.select("election_key", "municipality_id", *r6("share"))


@query("a05_concentration", f"SELECT s.election_key, s.municipality_id, round({_PCT} * sum(votes * votes) / (any_value(valid_votes) * any_value(valid_votes)), 6) AS concentration FROM std s JOIN tot t USING (election_key, municipality_id) GROUP BY ALL")
def _(p):
    return P.concentration(p.std, p.tot).select("election_key", "municipality_id", *r6("concentration"))


@query("a06_row_counts", "SELECT t.election_key, n_summary, n_results FROM (SELECT election_key, count(*) AS n_summary FROM tot GROUP BY 1) t JOIN (SELECT election_key, count(*) AS n_results FROM res GROUP BY 1) USING (election_key)")
def _(p):
    return p.tot.groupBy("election_key").agg(F.count(F.lit(1)).alias("n_summary")).join(p.res.groupBy("election_key").agg(F.count(F.lit(1)).alias("n_results")), "election_key")


@query("a08_national_top_parties", f"SELECT party_std, CAST(sum(votes) AS BIGINT) AS votes, round({_PCT} * sum(votes) / (SELECT sum(votes) FROM std WHERE election_key = '{LATEST}'), 6) AS share FROM std WHERE election_key = '{LATEST}' GROUP BY 1 HAVING sum(votes) > 0 ORDER BY sum(votes) DESC, party_std LIMIT 8")
def _(p):
    std = p.std.filter(F.col("election_key") == LATEST)
    g = std.groupBy("party_std").agg(F.sum("votes").alias("votes")).crossJoin(F.broadcast(std.agg(F.sum("votes").alias("all"))))
    return g.filter("votes > 0").select("party_std", "votes", F.round(P.pct(F.col("votes"), F.col("all")), 6).alias("share")).orderBy(F.desc("votes"), "party_std").limit(8)


@query("a10_party_options", "SELECT party_std, CAST(sum(votes) AS BIGINT) AS votes, row_number() OVER (ORDER BY sum(votes) DESC, party_std) AS position FROM std GROUP BY 1")
def _(p):
    g = p.std.groupBy("party_std").agg(F.sum("votes").alias("votes"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("votes"), "party_std")).cast("long"))  # a row a party


@query("a11_quick_stats", "SELECT election_key, round(avg(turnout_pct), 6) AS mean, round(min(turnout_pct), 6) AS low, round(max(turnout_pct), 6) AS high, count(turnout_pct) AS n FROM summ GROUP BY 1")
def _(p):
    return p.summ.groupBy("election_key").agg(F.avg("turnout_pct").alias("mean"), F.min("turnout_pct").alias("low"), F.max("turnout_pct").alias("high"), F.count("turnout_pct").alias("n")).select("election_key", *r6("mean", "low", "high"), "n")


@query("a11_block_counts", "SELECT election_key, dominant_block, count(*) AS n FROM summ WHERE dominant_block IS NOT NULL GROUP BY ALL")
def _(p):
    return p.summ.filter("dominant_block is not null").groupBy("election_key", "dominant_block").agg(F.count(F.lit(1)).alias("n"))


@query("a12_overview", "SELECT s.election_key, round(avg_turnout, 6) AS avg_turnout, round(avg_share, 6) AS avg_share, leader, n_leader FROM (SELECT election_key, avg(turnout_pct) AS avg_turnout, avg(first_party_share) AS avg_share FROM summ GROUP BY 1) s JOIN (SELECT election_key, first_party_std AS leader, count(*) AS n_leader, row_number() OVER (PARTITION BY election_key ORDER BY count(*) DESC, first_party_std) AS k FROM summ WHERE first_party_std IS NOT NULL GROUP BY election_key, first_party_std) m ON m.election_key = s.election_key AND k = 1")
def _(p):
    lead = p.summ.filter("first_party_std is not null").groupBy("election_key", "first_party_std").agg(F.count(F.lit(1)).alias("n_leader"))
    lead = lead.withColumn("k", F.row_number().over(Window.partitionBy("election_key").orderBy(F.desc("n_leader"), "first_party_std"))).filter("k = 1")
    s = p.summ.groupBy("election_key").agg(F.avg("turnout_pct").alias("avg_turnout"), F.avg("first_party_share").alias("avg_share"))
    return s.join(lead, "election_key").select("election_key", *r6("avg_turnout", "avg_share"), F.col("first_party_std").alias("leader"), "n_leader")


@query("a13_province_insights", f"SELECT s.province, n, round(mean_turnout, 6) AS mean_turnout, round(mean_margin, 6) AS mean_margin, leader FROM (SELECT province, count(*) AS n, avg(turnout_pct) AS mean_turnout, avg(first_second_margin) AS mean_margin FROM summ WHERE election_key = '{LATEST}' GROUP BY 1) s LEFT JOIN (SELECT province, first_party_std AS leader, row_number() OVER (PARTITION BY province ORDER BY count(*) DESC, first_party_std) AS k FROM summ WHERE election_key = '{LATEST}' AND first_party_std IS NOT NULL GROUP BY province, first_party_std) m ON m.province = s.province AND k = 1")
def _(p):
    s = p.summ.filter(F.col("election_key") == LATEST)
    lead = s.filter("first_party_std is not null").groupBy("province", "first_party_std").agg(F.count(F.lit(1)).alias("c")).groupBy("province").agg(F.min_by("first_party_std", F.struct(-F.col("c"), "first_party_std")).alias("leader"))
    return s.groupBy("province").agg(F.count(F.lit(1)).alias("n"), F.avg("turnout_pct").alias("mean_turnout"), F.avg("first_second_margin").alias("mean_margin")).join(lead, "province", "left").select("province", "n", *r6("mean_turnout", "mean_margin"), "leader")


@query("a17_transitions", f"SELECT a.first_party_std AS leader_before, b.first_party_std AS leader_after, count(*) AS n FROM summ a JOIN summ b USING (municipality_id) WHERE a.election_key = '{BEFORE}' AND b.election_key = '{LATEST}' AND a.first_party_std IS NOT NULL AND b.first_party_std IS NOT NULL GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 8")
def _(p):
    at = lambda k, c: p.summ.filter((F.col("election_key") == k) & F.col("first_party_std").isNotNull()).select("municipality_id", F.col("first_party_std").alias(c))
    g = at(BEFORE, "leader_before").join(at(LATEST, "leader_after"), "municipality_id").groupBy("leader_before", "leader_after").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "leader_before", "leader_after").limit(8)


@query("a19_heatmap", "SELECT g.grp, y.election_year, CAST(coalesce(sum(s.votes), 0) AS BIGINT) AS votes FROM (SELECT party_std AS grp FROM std GROUP BY 1 ORDER BY sum(votes) DESC, 1 LIMIT 8) g CROSS JOIN (SELECT DISTINCT election_year FROM tot) y LEFT JOIN std s ON s.party_std = g.grp AND s.election_year = y.election_year GROUP BY ALL")
def _(p):
    v = p.std.groupBy("party_std", "election_year").agg(F.sum("votes").alias("v"))
    top = v.groupBy(F.col("party_std").alias("grp")).agg(F.sum("v").alias("t")).orderBy(F.desc("t"), "grp").limit(8).select("grp")
    grid = top.crossJoin(F.broadcast(p.tot.select("election_year").distinct()))  # eight groups by years
    return grid.join(v.withColumnRenamed("party_std", "grp"), ["grp", "election_year"], "left").select("grp", "election_year", F.coalesce("v", F.lit(0)).alias("votes"))


@query("a21_column_coverage", f"SELECT unnest(['first_party_std', 'second_party_std', 'province']) AS column_name, round(unnest([{_PCT} * count(first_party_std) / count(*), {_PCT} * count(second_party_std) / count(*), {_PCT} * count(province) / count(*)]), 6) AS coverage_pct FROM summ")
def _(p):
    return Q.column_coverage(p.summ, ["first_party_std", "second_party_std", "province"]).select("column_name", *r6("coverage_pct"))


@query("a36_colour_domain", "SELECT election_key, round(max(abs(first_second_margin)), 6) AS diverging, round(min(turnout_pct), 6) AS low, round(max(turnout_pct), 6) AS high FROM summ GROUP BY 1")
def _(p):
    return p.summ.groupBy("election_key").agg(F.max(F.abs("first_second_margin")).alias("diverging"), F.min("turnout_pct").alias("low"), F.max("turnout_pct").alias("high")).select("election_key", *r6("diverging", "low", "high"))


@query("w01_dense_rank", "SELECT election_key, municipality_id, party_std, votes, CAST(dense_rank() OVER (PARTITION BY election_key, municipality_id ORDER BY votes DESC) AS INT) AS rank FROM std")
def _(p):
    return p.std.select("election_key", "municipality_id", "party_std", "votes", F.dense_rank().over(Window.partitionBy("election_key", "municipality_id").orderBy(F.desc("votes"))).alias("rank"))


@query("w02_row_rank", "SELECT election_key, municipality_id, party_std, rn AS rank FROM rk")
def _(p):
    return p.std.select("election_key", "municipality_id", "party_std", F.row_number().over(Window.partitionBy("election_key", "municipality_id").orderBy(F.desc("votes"), "party_std")).cast("long").alias("rank"))


@query("w04_dominance_changes", _VOL + " SELECT * FROM chg")
def _(p):
    return T.dominance_changes(p.summ)


@query("w05_volatility", _VOL + " SELECT municipality_id, round(volatility, 6) AS volatility FROM vol")
def _(p):
    return T.volatility(p.own).select("municipality_id", *r6("volatility"))


@query("w06_stability", _VOL + " SELECT municipality_id, round(CASE WHEN volatility IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - CAST(2.4 AS DOUBLE) * volatility - 6 * changes) END, 6) AS stability_index FROM chg LEFT JOIN vol USING (municipality_id)")
def _(p):
    return T.history(_cells(p)).select("municipality_id", *r6("stability_index"))


@query("w07_share_series", _OWN + " SELECT municipality_id, election_year, round(share, 6) AS share FROM own WHERE share IS NOT NULL")
def _(p):
    return p.own.filter("share is not null").select("municipality_id", "election_year", *r6("share"))


_SEG = _OWN + """, isl AS (SELECT *, sum(new) OVER (PARTITION BY municipality_id ORDER BY election_year) AS island FROM (SELECT municipality_id, election_year, own.share, coalesce(first_party_std, 'N/D') AS leader, CASE WHEN lag(coalesce(first_party_std, 'N/D')) OVER (PARTITION BY municipality_id ORDER BY election_year) = coalesce(first_party_std, 'N/D') THEN 0 ELSE 1 END AS new FROM summ JOIN own USING (election_key, municipality_id, election_year))),
 seg AS (SELECT municipality_id, leader, min(election_year) AS from_year, max(election_year) AS to_year, round(min(share), 6) AS min_share, round(max(share), 6) AS max_share, count(*) AS n FROM isl GROUP BY municipality_id, island, leader)"""


@query("w08_segments", _SEG + " SELECT * FROM seg")
def _(p):
    return T.segments(_cells(p)).select("municipality_id", "leader", "from_year", "to_year", *r6("min_share", "max_share"), "n")


@query("w09_longest_run", _SEG + " SELECT municipality_id, leader, from_year, to_year FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id ORDER BY to_year - from_year DESC, from_year) AS k FROM seg) WHERE k = 1")
def _(p):
    return T.longest_run(T.segments(_cells(p)))


@query("w10_leader_runs", """, x AS (SELECT municipality_id, election_year, first_party_std AS leader, CASE WHEN lag(first_party_std) OVER (PARTITION BY municipality_id ORDER BY election_year) = first_party_std THEN 0 ELSE 1 END AS new FROM summ WHERE first_party_std IS NOT NULL)
 SELECT municipality_id, leader, min(election_year) AS from_year, max(election_year) AS to_year, count(*) AS elections FROM (SELECT *, sum(new) OVER (PARTITION BY municipality_id ORDER BY election_year) AS island FROM x) GROUP BY municipality_id, island, leader""")
def _(p):
    return T.leader_runs(p.summ)


_CELLS = _OWN + ", cell AS (SELECT o.*, s.turnout_pct, s.first_party_std, s.dominant_block FROM own o JOIN summ s USING (election_key, municipality_id))"


def _cells(p: Panel) -> DataFrame:
    return P.own_share(p.cells, PARTY, "party_std", "turnout_pct", "first_party_std", "dominant_block", "first_second_margin")


@query("w11_breaks", _CELLS + """ SELECT municipality_id, from_year, to_year, round(d_share, 6) AS d_share, round(d_turnout, 6) AS d_turnout, leader_changed FROM (SELECT municipality_id, lag(election_year) OVER w AS from_year, election_year AS to_year, share - lag(share) OVER w AS d_share, turnout_pct - lag(turnout_pct) OVER w AS d_turnout, lag(first_party_std) OVER w IS DISTINCT FROM first_party_std AS leader_changed FROM cell WINDOW w AS (PARTITION BY municipality_id ORDER BY election_year)) WHERE from_year IS NOT NULL AND (leader_changed OR abs(d_share) >= 4 OR abs(d_turnout) >= 4)""")
def _(p):
    return T.breaks(_cells(p)).select("municipality_id", "from_year", "to_year", *r6("d_share", "d_turnout"), "leader_changed")


@query("w12_trend", _OWN + " SELECT municipality_id, CASE WHEN count(share) < 2 THEN 'trend n/d' WHEN arg_max(share, election_year) - arg_min(share, election_year) >= 5 THEN 'crescita netta' WHEN arg_max(share, election_year) - arg_min(share, election_year) <= -5 THEN 'calo netto' ELSE 'andamento stabile' END AS trend FROM own GROUP BY 1")
def _(p):
    return T.trend(p.own)


@query("w14_turnout_tier", "SELECT municipality_id, CASE WHEN avg(turnout_pct) >= 82 THEN 'alta' WHEN avg(turnout_pct) >= 72 THEN 'intermedia' WHEN avg(turnout_pct) IS NOT NULL THEN 'bassa' ELSE 'n/d' END AS tier FROM summ GROUP BY 1")
def _(p):
    return T.turnout_tier(p.summ)


@query("w15_compare_candidate", "SELECT election_key, coalesce(lag(election_key) OVER (ORDER BY election_year), lead(election_key) OVER (ORDER BY election_year)) AS compare_key FROM (SELECT DISTINCT election_key, election_year FROM tot)")
def _(p):
    return T.compare_candidate(p.tot.select("election_key", "election_year").distinct())


@query("w16_best_worst", "SELECT municipality_id, arg_max(election_year, turnout_pct * 10000 + election_year) AS best_year, arg_min(election_year, turnout_pct * 10000 + election_year) AS worst_year, min(election_year) AS first_year, max(election_year) AS last_year FROM summ GROUP BY 1")
def _(p):
    by = F.col("turnout_pct") * 10000 + F.col("election_year")
    return p.summ.groupBy("municipality_id").agg(F.max_by("election_year", by).alias("best_year"), F.min_by("election_year", by).alias("worst_year"), F.min("election_year").alias("first_year"), F.max("election_year").alias("last_year"))


@query("p12_metrics", _VOL + f""" SELECT s.municipality_id, s.first_party_std AS first_party, round(o.share, 6) AS party_share, round(s.turnout_pct, 6) AS turnout, round(s.first_second_margin, 6) AS margin, s.dominant_block, round(o.share - oc.share, 6) AS swing_compare, round(s.turnout_pct - c.turnout_pct, 6) AS delta_turnout, round(v.volatility, 6) AS volatility, g.changes AS dominance_changes,
 round(CASE WHEN volatility IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - CAST(2.4 AS DOUBLE) * volatility - 6 * changes) END, 6) AS stability_index FROM summ s JOIN own o USING (election_key, municipality_id) LEFT JOIN summ c ON c.election_key = '{BEFORE}' AND c.municipality_id = s.municipality_id LEFT JOIN own oc ON oc.election_key = '{BEFORE}' AND oc.municipality_id = s.municipality_id LEFT JOIN vol v ON v.municipality_id = s.municipality_id LEFT JOIN chg g ON g.municipality_id = s.municipality_id WHERE s.election_key = '{LATEST}'""")
def _(p):
    was = lambda c: F.max(F.when(F.col("election_key") == BEFORE, F.col(c))).over(Window.partitionBy("municipality_id"))
    m = T.with_history(_cells(p)).withColumns({"s0": was("share"), "t0": was("turnout_pct")}).filter(F.col("election_key") == LATEST)
    return m.select("municipality_id", F.col("first_party_std").alias("first_party"), F.round("share", 6).alias("party_share"), F.round("turnout_pct", 6).alias("turnout"), F.round("first_second_margin", 6).alias("margin"), "dominant_block", F.round(F.col("share") - F.col("s0"), 6).alias("swing_compare"), F.round(F.col("turnout_pct") - F.col("t0"), 6).alias("delta_turnout"), *r6("volatility"), F.col("changes").alias("dominance_changes"), *r6("stability_index"))


@query("p01_filtered_rows", f"SELECT municipality_id, province FROM summ WHERE election_key = '{LATEST}' AND province IN ('NATION_1', 'NATION_7', 'NATION_19') AND first_party_std IS NOT NULL")
def _(p):
    one = p.cells.filter((F.col("election_key") == LATEST) & F.col("province").isin("NATION_1", "NATION_7", "NATION_19"))
    return P.results(one).select("municipality_id", "province").distinct()


@query("p04_min_share", _OWN + f" SELECT municipality_id, round(share, 6) AS share FROM own WHERE election_key = '{LATEST}' AND coalesce(share, 0) >= 10")
def _(p):
    return p.own.filter((F.col("election_key") == LATEST) & (F.coalesce("share", F.lit(0.0)) >= 10)).select("municipality_id", *r6("share"))


@query("p05_search", f"SELECT municipality_id, province, first_party_std FROM summ WHERE election_key = '{LATEST}' AND contains(lower(concat_ws(' ', municipality_id, province, first_party_std)), 'an')")
def _(p):
    return p.summ.filter((F.col("election_key") == LATEST) & F.lower(F.concat_ws(" ", "municipality_id", "province", "first_party_std")).contains("an")).select("municipality_id", "province", "first_party_std")


@query("p16_detail", "SELECT election_year, electors, voters, round(turnout_pct, 6) AS turnout_pct FROM summ WHERE municipality_id = '42'")
def _(p):
    one = P.totals(p.cells.filter("municipality_id = '42'"))
    return one.select("election_year", "electors", "voters", F.round(P.pct(F.col("voters"), F.col("electors")), 6).alias("turnout_pct"))


@query("j01_compare", _CELLS + f" SELECT a.municipality_id, round(a.share - b.share, 6) AS swing, round(a.turnout_pct - b.turnout_pct, 6) AS d_turnout FROM cell a LEFT JOIN cell b ON b.municipality_id = a.municipality_id AND b.election_key = '{BEFORE}' WHERE a.election_key = '{LATEST}'")
def _(p):
    c = _cells(p)
    was = c.filter(F.col("election_key") == BEFORE).select("municipality_id", F.col("share").alias("s0"), F.col("turnout_pct").alias("t0"))
    return c.filter(F.col("election_key") == LATEST).join(was, "municipality_id", "left").select("municipality_id", F.round(F.col("share") - F.col("s0"), 6).alias("swing"), F.round(F.col("turnout_pct") - F.col("t0"), 6).alias("d_turnout"))


@query("j14_as_of_geometry", "SELECT y.election_year, coalesce(max(g.y), 1996) AS geometry_year FROM (SELECT DISTINCT election_year FROM tot) y LEFT JOIN (VALUES (1996), (1999)) g(y) ON g.y <= y.election_year GROUP BY 1")
def _(p):
    shapes = p.spark.createDataFrame([(1996,), (1999,)], "geometry_year int")
    return T.as_of(p.tot.select("election_year").distinct(), shapes)


@query("j15_u02_replace_by_key", f"SELECT election_key, municipality_id, CAST(CASE WHEN election_key = '{LATEST}' THEN 0 ELSE electors END AS BIGINT) AS electors FROM tot")
def _(p):
    t = p.tot.select("election_key", "municipality_id", "electors")
    return replace_by_key(t, t.filter(F.col("election_key") == LATEST).withColumn("electors", F.lit(0).cast("long")))


@query("j17_single_context", "SELECT party_std, CASE WHEN count(DISTINCT region) = 1 THEN min(region) END AS region FROM res WHERE election_key = 'e1995' AND votes > 120 GROUP BY 1")
def _(p):
    g = p.res.filter("election_key = 'e1995' and votes > 120").groupBy("party_std").agg(F.min("region").alias("lo"), F.max("region").alias("hi"))
    return g.select("party_std", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("region"))


_RAW_PLACES = "SELECT election_key, region, municipality_id, party_raw, CASE WHEN votes % 3 <> 0 THEN province END AS province FROM res"


@query("j17_fill_from_context", f", raw AS ({_RAW_PLACES}), one AS (SELECT election_key, region, party_raw, min(province) AS p FROM raw WHERE trim(province) <> '' GROUP BY ALL HAVING count(DISTINCT province) = 1) SELECT election_key, municipality_id, party_raw, coalesce(nullif(trim(raw.province), ''), one.p) AS province FROM raw LEFT JOIN one USING (election_key, region, party_raw)")
def _(p):
    raw = p.res.withColumn("province", F.when(F.col("votes") % 3 != 0, F.col("province")))  # the fixture has no blank provinces
    return P.fill_from_context(raw, ["election_key", "region", "party_raw"], "province").select("election_key", "municipality_id", "party_raw", "province")


@query("o02_page", f"SELECT municipality_id, round(turnout_pct, 6) AS turnout_pct, position FROM (SELECT municipality_id, turnout_pct, row_number() OVER (ORDER BY turnout_pct DESC NULLS LAST, municipality_id) AS position FROM summ WHERE election_key = '{LATEST}') WHERE position BETWEEN 26 AND 50")
def _(p):
    one = P.totals(p.cells.filter(F.col("election_key") == LATEST)).select("municipality_id", P.pct(F.col("voters"), F.col("electors")).alias("turnout_pct"))
    page = one.orderBy(F.desc_nulls_last("turnout_pct"), "municipality_id").limit(50)  # top-k first: the window sees two pages
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("turnout_pct"), "municipality_id")
    return page.withColumn("position", F.row_number().over(w).cast("long")).filter("position > 25").select("municipality_id", *r6("turnout_pct"), "position")


@query("o03_rankings", f"SELECT 'top' AS list, municipality_id, round(m, 6) AS margin FROM (SELECT municipality_id, first_second_margin AS m FROM summ WHERE election_key = '{LATEST}' AND first_second_margin IS NOT NULL ORDER BY m DESC, municipality_id LIMIT 6) UNION ALL SELECT 'tightest', municipality_id, round(m, 6) FROM (SELECT municipality_id, first_second_margin AS m FROM summ WHERE election_key = '{LATEST}' AND first_second_margin IS NOT NULL ORDER BY m, municipality_id LIMIT 6)")
def _(p):
    s = p.summ.filter((F.col("election_key") == LATEST) & F.col("first_second_margin").isNotNull())
    pick = lambda name, order: s.orderBy(order, "municipality_id").limit(6).select(F.lit(name).alias("list"), "municipality_id", F.round("first_second_margin", 6).alias("margin"))
    return pick("top", F.desc("first_second_margin")).unionByName(pick("tightest", F.asc("first_second_margin")))


@query("o04_gains", _OWN + f" SELECT municipality_id, round(swing, 6) AS swing FROM (SELECT a.municipality_id, a.share - b.share AS swing FROM own a JOIN own b USING (municipality_id) WHERE a.election_key = '{LATEST}' AND b.election_key = '{BEFORE}') WHERE swing IS NOT NULL ORDER BY round(swing, 6) DESC, municipality_id LIMIT 8")
def _(p):
    at = lambda k, c: p.own.filter(F.col("election_key") == k).select("municipality_id", F.col("share").alias(c))
    g = at(LATEST, "a").join(at(BEFORE, "b"), "municipality_id").select("municipality_id", F.round(F.col("a") - F.col("b"), 6).alias("swing")).filter("swing is not null")
    return g.orderBy(F.desc("swing"), "municipality_id").limit(8)


@query("r02_unpivot", "SELECT election_key, municipality_id, 'electors' AS measure, electors AS value FROM tot UNION ALL SELECT election_key, municipality_id, 'voters', voters FROM tot UNION ALL SELECT election_key, municipality_id, 'valid_votes', valid_votes FROM tot")
def _(p):
    return p.tot.unpivot(["election_key", "municipality_id"], ["electors", "voters", "valid_votes"], "measure", "value")


@query("r01_pivot", "SELECT province, CAST(sum(votes) FILTER (WHERE bloc = 'bloc_0') AS BIGINT) AS bloc_0, CAST(sum(votes) FILTER (WHERE bloc = 'bloc_1') AS BIGINT) AS bloc_1, CAST(sum(votes) FILTER (WHERE bloc = 'bloc_2') AS BIGINT) AS bloc_2, CAST(sum(votes) FILTER (WHERE bloc = 'bloc_3') AS BIGINT) AS bloc_3 FROM std GROUP BY 1")
def _(p):
    return p.std.groupBy("province").pivot("bloc", ["bloc_0", "bloc_1", "bloc_2", "bloc_3"]).agg(F.sum("votes"))


# The panel has no violations of its own; these rows have.
_BAD = ["election_key", "municipality_id", "CASE WHEN electors % 9 = 0 THEN ' ' ELSE province END AS province", "CASE WHEN electors % 7 = 0 THEN voters - 5 ELSE electors END AS electors", "voters", "CASE WHEN electors % 13 = 0 THEN voters + 1 ELSE valid_votes END AS valid_votes", "CASE WHEN electors % 4 = 0 THEN turnout_pct + 3 ELSE turnout_pct END AS turnout_pct", "CASE WHEN electors % 11 = 0 THEN 'other' ELSE first_party_std END AS first_party_std", "CASE WHEN electors % 5 = 0 THEN first_party_share + 1 ELSE first_party_share END AS first_party_share", "CASE WHEN electors % 2 = 0 THEN 'clean_ingest_turnout_only' WHEN electors % 3 = 0 THEN 'clean_ingest_party_results_checked' END AS completeness_flag", "CASE WHEN electors % 3 = 0 THEN 'x|party_rows_checked' END AS comparability_note"]
_CHECKS = f""", b AS (SELECT {", ".join(_BAD)} FROM summ), sh AS (SELECT s.election_key, s.municipality_id, s.party_std, s.votes, {_PCT} * s.votes / t.valid_votes + CASE WHEN s.votes % 17 = 0 THEN 60 ELSE 0 END AS vs FROM std s JOIN tot t USING (election_key, municipality_id)),
 c AS (SELECT election_key, municipality_id, sum(votes) AS votes, sum(vs) AS share, sum(CASE WHEN vs > 100.01 OR vs < -0.01 THEN 1 ELSE 0 END) AS bad, first(party_std ORDER BY votes DESC, party_std) AS lp, first(vs ORDER BY votes DESC, party_std) AS lv FROM sh GROUP BY ALL), j AS (SELECT * FROM b FULL JOIN c USING (election_key, municipality_id)),
 k AS (SELECT unnest(['turnout_out_of_range', 'electors_below_voters', 'valid_above_voters', 'turnout_mismatch', 'missing_province', 'misleading_checked_flag', 'missing_turnout_only_flag', 'share_out_of_range', 'share_sum_out_of_range', 'votes_differ_from_valid', 'leader_mismatch']) AS "check", unnest(['error', 'error', 'error', 'warning', 'warning', 'error', 'warning', 'error', 'warning', 'warning', 'error']) AS severity,
 unnest([count(*) FILTER (WHERE turnout_pct > 100.01 OR turnout_pct < -0.01), count(*) FILTER (WHERE electors < voters), count(*) FILTER (WHERE valid_votes > voters), count(*) FILTER (WHERE abs(turnout_pct - {_PCT} * voters / nullif(electors, 0)) > 1.5), count(*) FILTER (WHERE trim(province) = ''), count(*) FILTER (WHERE first_party_std IS NULL AND contains(comparability_note, 'party_rows_checked')), count(*) FILTER (WHERE first_party_std IS NULL AND NOT contains(coalesce(completeness_flag, ''), 'turnout_only')),
 CAST(sum(bad) AS BIGINT), count(*) FILTER (WHERE share < 90 OR share > 110), count(*) FILTER (WHERE abs(votes - valid_votes) / CAST(nullif(valid_votes, 0) AS DOUBLE) > 0.08), count(*) FILTER (WHERE coalesce(lp <> first_party_std, FALSE) OR coalesce(abs(lv - first_party_share) > 0.6, FALSE))]) AS affected FROM j)"""


def _checks(p: Panel, faulty: bool) -> DataFrame:
    share = P.by_party(p.cells, "valid_votes").select("election_key", "municipality_id", "party_std", "votes", (P.pct(F.col("votes"), F.col("valid_votes")) + F.when(F.lit(faulty) & (F.col("votes") % 17 == 0), 60).otherwise(0)).alias("vote_share"))
    return Q.validations(p.summ.selectExpr(*_BAD) if faulty else p.summ.withColumns({"completeness_flag": F.when(F.col("first_party_std").isNull(), "clean_ingest_turnout_only"), "comparability_note": F.lit(None).cast("string")}), share)


@query("v01_validations", _CHECKS + ' SELECT "check", severity, affected FROM k')
def _(p):
    return _checks(p, True)


@query("v02_readiness", _CHECKS + """ SELECT 'faulty' AS panel, CAST(greatest(0, 100 - 25 * count(*) FILTER (WHERE severity = 'error' AND affected > 0) - 10 * count(*) FILTER (WHERE severity = 'warning' AND affected > 0)) AS BIGINT) AS readiness FROM k
 UNION ALL SELECT 'without_errors', CAST(greatest(0, 100 - 10 * count(*) FILTER (WHERE severity = 'warning' AND affected > 0)) AS BIGINT) FROM k UNION ALL SELECT 'own', CAST(100 AS BIGINT)""")
def _(p):
    faulty = _checks(p, True)
    parts = {"faulty": faulty, "without_errors": faulty.filter("severity = 'warning'"), "own": _checks(p, False)}
    one, two, three = (Q.readiness(x).select(F.lit(k).alias("panel"), "readiness") for k, x in parts.items())
    return one.unionByName(two).unionByName(three)


# Numbers as texts of twelve kinds, made of a cell's counts, and what each parser makes of them.
_N, _M, _D = "(electors % 900 + 1)", "(voters % 900 + 100)", "(valid_votes % 9 + 1)"
_WHOLE = "CAST({} AS DOUBLE)".format
_POINT = "CAST(concat({}, '.', {}) AS DOUBLE)".format
_KINDS = [  # text, safe_float, safe_number, safe_count, archive_count
    (f"concat({_N}, '.', {_M}, ',', {_D})", _POINT(f"{_N} * 1000 + {_M}", _D), None, f"({_N} * 1000 + {_M}) * 10 + {_D}", None), (f"concat({_N}, ',', {_M}, '.', {_D})", _POINT(f"{_N} * 1000 + {_M}", _D), None, f"({_N} * 1000 + {_M}) * 10 + {_D}", None),
    (f"concat({_N}, ',', {_D})", _POINT(_N, _D), None, f"{_N} * 10 + {_D}", None), (f"concat({_N}, '.', {_M})", _WHOLE(f"{_N} * 1000 + {_M}"), _POINT(_N, _M), f"{_N} * 1000 + {_M}", None), (f"concat({_N}, '.0')", _WHOLE(_N), None, _N, None),
    (f"concat({_N}, '.000')", _WHOLE(f"{_N} * 1000"), _WHOLE(_N), _N, None), (f"concat({_N}, '.', {_D})", _POINT(_N, _D), None, f"{_N} * 10 + {_D}", f"{_N} * 1000 + {_D} * 100"), (f"concat(' -', {_N})", f"-{_WHOLE(_N)}", None, _N, None),
    (f"concat({_N}, ',', {_D}, '%')", _POINT(_N, _D), "NULL", f"{_N} * 10 + {_D}", None), ("''", "NULL", None, "NULL", None), ("concat('abc', province)", "NULL", None, "CAST(regexp_replace(province, '[^0-9]', '', 'g') AS BIGINT)", None), ("NULL", "NULL", None, "NULL", None),
]
_PARSED = [(text, f, f if n is None else n, c, c if a is None else a) for text, f, n, c, a in _KINDS]
_kind = lambda i: "CASE electors % 12 " + " ".join(f"WHEN {k} THEN {row[i]}" for k, row in enumerate(_PARSED)) + " END"


@query("f01_f05_number_parsing", f" SELECT election_key, municipality_id, {_kind(0)} AS raw, {_kind(1)} AS safe_float, {_kind(2)} AS safe_number, {_kind(3)} AS safe_count, {_kind(4)} AS archive_count FROM tot")
def _(p):
    t, c = p.tot.selectExpr("election_key", "municipality_id", f"{_kind(0)} AS raw"), F.col("raw")
    return t.select("election_key", "municipality_id", "raw", N.safe_float(c).alias("safe_float"), N.safe_number(c).alias("safe_number"), N.safe_count(c).alias("safe_count"), N.archive_count(c).alias("archive_count"))


@query("f20_slug_party", "SELECT DISTINCT party_raw, trim(regexp_replace(lower(party_raw), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM res")
def _(p):
    return p.res.select("party_raw").distinct().withColumn("slug", X.slug(F.col("party_raw")))


@query("f09_token", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(source)), '[^a-z0-9]+', ' ', 'g')) AS token FROM documents", prelude=False)
def _(p):
    return p.spark.read.parquet(f"{p.sf_dir}/documents.parquet").select("doc_id", X.token(F.col("source")).alias("token"))


@query("f28_election_labels", "SELECT DISTINCT concat('camera_', CAST(election_year - 6 AS VARCHAR)) AS key, CASE WHEN election_year - 6 <= 1992 THEN 'proportional' ELSE 'mixed' END AS system FROM tot")
def _(p):
    y = F.col("election_year") - 6  # so that some lie on either side of the change
    return p.tot.select("election_year").distinct().select(X.election_key(F.lit("Camera"), y).alias("key"), X.electoral_system(y).alias("system"))


_LABELS = "CASE WHEN votes % 9 = 0 THEN 'DC' WHEN votes % 9 = 1 THEN 'Rifondazione Comunista' WHEN votes % 9 = 2 THEN 'LEGA nord' WHEN votes % 9 = 3 THEN 'l''alleanza verdi' WHEN votes % 9 = 4 THEN ' fi ' WHEN votes % 9 = 5 THEN '' WHEN votes % 9 = 6 THEN 'Il Socialista' WHEN votes % 9 = 7 THEN NULL ELSE party_raw END AS label"


@query("f31_taxonomy", f""", l AS (SELECT DISTINCT {_LABELS} FROM res) SELECT label,
 CASE WHEN label = 'DC' THEN 'centro' WHEN contains(lower(label), 'azione') THEN 'centro' WHEN contains(lower(label), 'lega') THEN 'centro-destra' WHEN contains(lower(label), 'verdi') THEN 'sinistra' WHEN trim(label) = 'fi' THEN 'centro-destra' WHEN contains(lower(label), 'socialista') THEN 'centro-sinistra' ELSE 'altro' END AS party_bloc_by_rule FROM l""")
def _(p):
    return classify(p.res.selectExpr(_LABELS).distinct(), "label").select("label", "party_bloc_by_rule")


def vectors(p: Panel) -> DataFrame:
    """Six features per municipality, nulls as 0, not scaled; ``over`` is the latest election's share less the nation's."""
    nation = p.cells.groupBy("election_key").agg(P.pct(F.sum(P.own_votes(PARTY)), F.sum("valid_votes")).alias("nation_share"))  # one row an election
    last = F.max_by(F.struct(F.col("share") - F.col("nation_share")), "election_year").alias("last")
    v = T.history(_cells(p).join(F.broadcast(nation), "election_key"), F.avg("share").alias("mean_share"), F.avg("turnout_pct").alias("turnout"), last)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    return v.select("municipality_id", z("mean_share").alias("share"), z("volatility").alias("volatility"), z("stability_index").alias("stability"), z("turnout").alias("turnout"), z("changes").alias("changes"), z("last.col1").alias("over"))


_VECTORS = _VOL + f""", na AS (SELECT election_key, {_PCT} * v / d AS ns FROM (SELECT election_key, sum(valid_votes) AS d FROM tot GROUP BY 1) LEFT JOIN (SELECT election_key, sum(votes) AS v FROM std WHERE party_std = '{PARTY}' GROUP BY 1) USING (election_key)),
 ce AS (SELECT o.municipality_id, avg(share) AS share, avg(turnout_pct) AS turnout, arg_max_null(share - ns, o.election_year) AS over FROM own o JOIN summ s USING (election_key, municipality_id) JOIN na USING (election_key) GROUP BY 1),
 vec AS MATERIALIZED (SELECT ce.municipality_id, [coalesce(share, 0), coalesce(volatility, 0), coalesce(CASE WHEN volatility IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - CAST(2.4 AS DOUBLE) * volatility - 6 * changes) END, 0), coalesce(turnout, 0), CAST(changes AS DOUBLE), coalesce(over, 0)] AS f FROM ce JOIN chg USING (municipality_id) LEFT JOIN vol USING (municipality_id))"""
_NEAR = "list_transform(cs, lambda c: list_sum(list_transform(range(1, 7), lambda i: (f[i] - c[i]) * (f[i] - c[i]))))"
_LLOYD = """, k0 AS (SELECT CAST(greatest(3, least(5, round_even(sqrt(count(*) / CAST(6 AS DOUBLE)), 0) + 2)) AS BIGINT) AS k FROM vec), c0 AS MATERIALIZED (SELECT list(f ORDER BY municipality_id) AS cs FROM (SELECT *, row_number() OVER (ORDER BY municipality_id) AS i FROM vec) WHERE i <= (SELECT k FROM k0))""" + "".join(
    f""", a{i} AS MATERIALIZED (SELECT municipality_id, f, list_position(ds, list_min(ds)) AS a FROM (SELECT municipality_id, f, {_NEAR} AS ds FROM vec, c{i})), c{i + 1} AS MATERIALIZED (SELECT list(coalesce(m.f, c{i}.cs[j]) ORDER BY j) AS cs FROM c{i}, (SELECT unnest(range(1, k + 1)) AS j FROM k0) LEFT JOIN (SELECT a, [avg(f[1]), avg(f[2]), avg(f[3]), avg(f[4]), avg(f[5]), avg(f[6])] AS f FROM a{i} GROUP BY a) m ON m.a = j)"""
    for i in range(12)
) + f", kl AS MATERIALIZED (SELECT municipality_id, CAST(list_position(ds, list_min(ds)) - 1 AS INT) AS cluster FROM (SELECT municipality_id, {_NEAR} AS ds FROM vec, c12))"  # twelve rounds, one after the other


@query("m01_m02_clusters", _VECTORS + _LLOYD + " SELECT * FROM kl")
def _(p):
    return C.kmeans(vectors(p))


TARGETS = ["42", "43", "77"]


@query("m04_similarity", _CELLS + (_VECTORS + _LLOYD).removeprefix(_OWN) + f""", pr AS (SELECT t.municipality_id AS target, c.municipality_id, sum(coalesce(power((c.share - t.share) / 10, 2), 0) + coalesce(power((c.turnout_pct - t.turnout_pct) / 12, 2), 0) + CASE WHEN c.first_party_std <> t.first_party_std THEN CAST(0.45 AS DOUBLE) ELSE 0 END + CASE WHEN c.dominant_block <> t.dominant_block THEN CAST(0.35 AS DOUBLE) ELSE 0 END) AS sq,
  sum(CASE WHEN c.share IS NOT NULL AND t.share IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c.turnout_pct IS NOT NULL AND t.turnout_pct IS NOT NULL THEN 1 ELSE 0 END) AS n FROM cell c JOIN cell t ON t.election_year = c.election_year AND t.municipality_id IN ('42', '43', '77') AND t.municipality_id <> c.municipality_id GROUP BY ALL),
 sc AS (SELECT target, municipality_id, CAST(n AS BIGINT) AS n, round(sqrt(sq / n), 6) AS distance, round(greatest(CAST(0 AS DOUBLE), 100 - 28 * sqrt(sq / n)), 6) AS score FROM pr WHERE n > 0),
 li AS (SELECT 'nearest' AS list, * FROM sc UNION ALL SELECT 'same_cluster', sc.* FROM sc JOIN kl x ON x.municipality_id = target JOIN kl y ON y.municipality_id = sc.municipality_id AND y.cluster = x.cluster)
 SELECT target, list, municipality_id, n, distance, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target, list ORDER BY score DESC, municipality_id) AS INT) AS rank FROM li) WHERE rank <= 6""")
def _(p):
    return C.similarity(_cells(p), TARGETS, C.kmeans(vectors(p)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
