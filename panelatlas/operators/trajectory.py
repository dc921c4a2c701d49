"""Ordered sequences per municipality: changes, volatility, runs, breaks, trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by():
    return Window.partitionBy("municipality_id").orderBy("election_year", "election_key")


def dominance_changes(summ: DataFrame) -> DataFrame:
    """Times the leader differs from the one before, over rows with a leader; 0 without any."""
    led = summ.filter("first_party_std is not null").withColumn("before", F.lag("first_party_std").over(_by()))
    n = led.groupBy("municipality_id").agg(F.sum(F.when(F.col("before") != F.col("first_party_std"), 1).otherwise(0)).alias("changes"))
    return summ.select("municipality_id").distinct().join(n, "municipality_id", "left").select("municipality_id", F.coalesce("changes", F.lit(0)).cast("long").alias("changes"))


def volatility(shares: DataFrame) -> DataFrame:
    """Mean absolute step between consecutive shares that are not null; null with fewer than two."""
    step = shares.filter("share is not null").withColumn("step", F.abs(F.col("share") - F.lag("share").over(_by())))
    return step.groupBy("municipality_id").agg(F.avg("step").alias("volatility"))


def _history(of: Callable[[Column], Column]) -> dict[str, Column]:
    """volatility, changes and stability_index from the columns ``step`` and ``turn``; ``of`` says over which rows."""
    vol, changes = of(F.avg("step")), F.coalesce(of(F.sum("turn")), F.lit(0)).cast("long")
    return {"volatility": vol, "changes": changes, "stability_index": F.when(vol.isNotNull(), F.greatest(F.lit(0.0), 100 - 2.4 * vol - 6 * changes))}


def _steps(rows: DataFrame) -> DataFrame:
    """The step from the last known share, and 1 where the last known leader was another."""
    before = lambda c: F.last(c, ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"step": F.abs(F.col("share") - before("share")), "turn": F.when(before("first_party_std") != F.col("first_party_std"), 1)})


def history(rows: DataFrame, *more: Column) -> DataFrame:
    """W04, W05, W06 in one pass: a row per place with volatility, changes and stability_index, and ``more`` aggregates."""
    return _steps(rows).groupBy("municipality_id").agg(*[c.alias(k) for k, c in _history(lambda c: c).items()], *more)


def with_history(rows: DataFrame) -> DataFrame:
    """``rows`` with their place's volatility, changes and stability_index."""
    return _steps(rows).withColumns(_history(lambda c: c.over(Window.partitionBy("municipality_id")))).drop("step", "turn")


def stability(vol: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(vol, "municipality_id", "left").select("municipality_id", F.when(F.col("volatility").isNotNull(), F.greatest(F.lit(0.0), 100 - 2.4 * F.col("volatility") - 6 * F.col("changes"))).alias("stability_index"))


def _islands(rows: DataFrame, leader: str) -> DataFrame:
    new = F.when(F.lag(leader).over(_by()).eqNullSafe(F.col(leader)), 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("island", F.sum("new").over(_by().rowsBetween(Window.unboundedPreceding, 0)))


def segments(summ: DataFrame) -> DataFrame:
    """Stretches with the same leader (none counts as N/D): years from and to, lowest and highest ``share`` of the selected
    group, nulls left out."""
    rows = _islands(summ.withColumn("leader", F.coalesce("first_party_std", F.lit("N/D"))), "leader")
    return rows.groupBy("municipality_id", "island", "leader").agg(F.min("election_year").alias("from_year"), F.max("election_year").alias("to_year"), F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.count(F.lit(1)).alias("n")).drop("island")


def leader_runs(summ: DataFrame) -> DataFrame:
    """Stretches with the same leader, rows without one taken out first, with the number of elections."""
    rows = _islands(summ.filter("first_party_std is not null").withColumnRenamed("first_party_std", "leader"), "leader")
    return rows.groupBy("municipality_id", "island", "leader").agg(F.min("election_year").alias("from_year"), F.max("election_year").alias("to_year"), F.count(F.lit(1)).alias("elections")).drop("island")


def longest_run(seg: DataFrame) -> DataFrame:
    w = Window.partitionBy("municipality_id").orderBy((F.col("from_year") - F.col("to_year")), "from_year")
    return seg.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("municipality_id", "leader", "from_year", "to_year")


def breaks(rows: DataFrame) -> DataFrame:
    """Consecutive elections between which the leader, the share or the turnout (by 4 points) moved; over all rows."""
    lag = lambda c: F.lag(c).over(_by())
    d = rows.select("municipality_id", lag("election_year").alias("from_year"), F.col("election_year").alias("to_year"), (F.col("share") - lag("share")).alias("d_share"), (F.col("turnout_pct") - lag("turnout_pct")).alias("d_turnout"), (~lag("first_party_std").eqNullSafe(F.col("first_party_std"))).alias("leader_changed"))
    return d.filter("from_year is not null and (leader_changed or abs(d_share) >= 4 or abs(d_turnout) >= 4)")


def trend(shares: DataFrame) -> DataFrame:
    s = shares.filter("share is not null").groupBy("municipality_id").agg(F.min_by("share", "election_year").alias("first"), F.max_by("share", "election_year").alias("last"), F.count(F.lit(1)).alias("n"))
    d = F.col("last") - F.col("first")
    label = F.when(F.coalesce("n", F.lit(0)) < 2, "trend n/d").when(d >= 5, "crescita netta").when(d <= -5, "calo netto").otherwise("andamento stabile")
    return shares.select("municipality_id").distinct().join(s, "municipality_id", "left").select("municipality_id", label.alias("trend"))


def turnout_tier(summ: DataFrame) -> DataFrame:
    m = F.avg("turnout_pct")
    return summ.groupBy("municipality_id").agg(F.when(m >= 82, "alta").when(m >= 72, "intermedia").when(m.isNotNull(), "bassa").otherwise("n/d").alias("tier"))


def compare_candidate(elections: DataFrame) -> DataFrame:
    """The useful election before each, else the one after."""
    w = Window.partitionBy(F.lit(1)).orderBy("election_year")  # one row an election
    return elections.select("election_key", F.coalesce(F.lag("election_key").over(w), F.lead("election_key").over(w)).alias("compare_key"))


def as_of(years: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per election year the latest geometry year not after it, else the earliest one."""
    at = years.join(F.broadcast(shapes), F.col("geometry_year") <= F.col("election_year"), "left").groupBy("election_year").agg(F.max("geometry_year").alias("at"))
    first = shapes.agg(F.min("geometry_year").alias("first"))
    return at.join(F.broadcast(first)).select("election_year", F.coalesce("at", "first").alias("geometry_year"))
