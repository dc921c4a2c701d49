"""Report tables: groups of a place, small multiples, archetypes, coverage, context and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import MODES, own_votes, pct


def place_groups(std: DataFrame, tot: DataFrame, group: str, top: int) -> DataFrame:
    """Votes and share of every group of one place; rows without a share are left out."""
    d = tot.agg(F.sum("valid_votes").alias("d"))  # one row
    g = std.groupBy(F.col(group).alias("grp")).agg(F.sum("votes").alias("votes")).crossJoin(F.broadcast(d)).select("grp", "votes", pct(F.col("votes"), F.col("d")).alias("share"))
    return g.filter("share is not null").orderBy(F.desc("share"), "grp").limit(top)


def province_years(summ: DataFrame, std: DataFrame, party: str) -> DataFrame:
    """Per province and election year: weighted share of one party, mean turnout, most frequent leader."""
    by = ["province", "election_year"]
    means = summ.groupBy(*by).agg(F.avg("turnout_pct").alias("turnout"), F.sum("valid_votes").alias("d"))
    votes = std.filter(F.col("party_std") == party).groupBy(*by).agg(F.sum("votes").alias("v"))
    counts = summ.filter("first_party_std is not null").groupBy(*by, "first_party_std").agg(F.count(F.lit(1)).alias("c"))
    lead = counts.groupBy(*by).agg(F.min_by("first_party_std", F.struct(-F.col("c"), "first_party_std")).alias("leader"))
    return means.join(votes, by, "left").join(lead, by, "left").select(*by, pct(F.col("v"), F.col("d")).alias("party_share"), "turnout", "leader")


def label_distribution(labels: DataFrame, places: int, top: int) -> DataFrame:
    """Count per label and its first ``places`` identifiers. Only ranked rows within ``places`` are gathered."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy("municipality_id")  # a top-k filter follows, so tasks keep few rows before the shuffle
    first = labels.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= places).groupBy("label").agg(F.concat_ws("|", F.sort_array(F.collect_list("municipality_id"))).alias("first_places"))
    return counts.join(first, "label").orderBy(F.desc("n"), "label").limit(top)


def coverage(tot: DataFrame, res: DataFrame, geometry_year: int) -> DataFrame:
    """Per election: rows of both tables, whether shapes of ``geometry_year`` apply, and its status."""
    s = tot.groupBy("election_key", "election_year").agg(F.count(F.lit(1)).alias("n_summary"))
    r = res.groupBy("election_key").agg(F.count(F.lit(1)).alias("n_results"))
    return s.join(r, "election_key", "left").select(
        "election_key", "n_summary", "n_results", F.when(F.col("election_year") >= geometry_year, "covered").otherwise("before_geometry").alias("geometry"), F.when(F.col("n_results") > 0, "complete").otherwise("summary_only").alias("status"))


LEVELS = {"province": ["election_key", "province"], "nation": ["election_key"]}


def levels(cells: DataFrame, party: str, mode: str = "party_std") -> DataFrame:
    """Per election, for each province and the nation (province null): turnout, weighted margin and first share, and the share
    of one group. One pass over the cells."""
    rows = cells.withColumn("own", own_votes(party, mode))
    w = F.col("valid_votes")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(F.coalesce(w, F.lit(0))).cast("double")), F.avg(c))
    g = rows.groupingSets([LEVELS["province"], LEVELS["nation"]], "election_key", "province").agg(
        F.grouping("province").alias("all"), F.coalesce(pct(F.sum("voters"), F.sum("electors")), F.avg("turnout_pct")).alias("turnout"), weighted("first_second_margin").alias("margin"), weighted("first_party_share").alias("first_share"),
        F.when(F.count("own") > 0, pct(F.sum("own"), F.sum(w))).alias("share"))
    return g.select("election_key", F.when(F.col("all") == 1, "nation").otherwise("province").alias("level"), "province", "turnout", "margin", "first_share", "share")


def context_averages(cells: DataFrame, party: str, election: str, compare: str, stability: DataFrame, custom: DataFrame, mode: str = "party_std") -> DataFrame:
    """(municipality_id, level, metric, value): what each place of one election is held against, for its province and the
    nation, in every metric.

    Share, swing, turnout, its change and margin are the level's own; against its own level a place's level is 0 over, against
    the other it is the province less the nation; stability stays the place's; the custom indicator is the plain mean of the
    level's places; any other metric falls back to the weighted first share. ``stability``: municipality_id, stability_index;
    ``custom``: municipality_id, province, value.
    """
    at = levels(cells.filter(F.col("election_key").isin(election, compare)), party, mode)
    of = lambda k, c: F.max(F.when(F.col("election_key") == k, F.col(c)))
    now = at.groupBy("level", "province").agg(*[of(election, c).alias(c) for c in ("turnout", "margin", "first_share", "share")], of(compare, "share").alias("share0"), of(compare, "turnout").alias("turnout0"))
    mean = custom.groupingSets([["province"], []], "province").agg(F.avg("value").alias("custom"), F.grouping("province").alias("all")).select(F.when(F.col("all") == 1, "nation").otherwise("province").alias("level"), F.col("province").alias("p"), "custom")
    now = now.join(mean, (now["level"] == mean["level"]) & now["province"].eqNullSafe(mean["p"]), "left").drop(mean["level"]).drop("p")
    nation = now.filter("level = 'nation'").select(F.col("share").alias("nation_share"))  # one row
    now = now.crossJoin(F.broadcast(nation))
    province = now.filter("level = 'province'").select("province", F.col("share").alias("province_share"))
    places = cells.filter(F.col("election_key") == election).select("municipality_id", "province").join(stability, "municipality_id", "left")
    both = places.join(now.filter("level = 'province'"), "province").unionByName(places.join(F.broadcast(now.filter("level = 'nation'").drop("province"))))
    both = both.join(province, "province", "left")
    gap, zero, near = F.col("province_share") - F.col("nation_share"), F.lit(0.0), F.col("level") == "province"
    values = {
        "party_share": F.col("share"), "swing_compare": F.col("share") - F.col("share0"), "turnout": F.col("turnout"), "margin": F.col("margin"), "delta_turnout": F.col("turnout") - F.col("turnout0"), "over_performance_province": F.when(near, zero).otherwise(gap),
        "over_performance_region": F.when(near, gap).otherwise(zero), "stability_index": F.col("stability_index"), "custom_indicator": F.col("custom"), "volatility": F.col("first_share"),
    }
    return both.select("municipality_id", "level", *[v.cast("double").alias(k) for k, v in values.items()]).unpivot(["municipality_id", "level"], list(values), "metric", "value")


def mean_series(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Per election the plain means of share, turnout and stability over the rows of each group (a condition by name); one
    pass for all groups. ``rows``: election_year, share, turnout_pct, stability_index."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in groups.items()]))
    means = rows.withColumn("grp", F.explode(named)).groupBy("grp", "election_year")
    return means.agg(F.avg("share").alias("share"), F.avg("turnout_pct").alias("turnout"), F.avg("stability_index").alias("stability"), F.count(F.lit(1)).alias("n"))


def context(cells: DataFrame, parties: dict[str, str], place: str, stability: DataFrame) -> DataFrame:
    """(mode, level, measure, value): one place of one election against its province and the nation in the share of a group
    (``parties`` names one for each grouping mode), against its province in turnout, and its stability; nulls left out."""
    home = cells.filter(F.col("municipality_id") == place).select(F.col("province").alias("home"), "turnout_pct", *[pct(own_votes(v, k), F.col("valid_votes")).alias(f"own_{k}") for k, v in parties.items()])
    home = home.crossJoin(F.broadcast(stability.filter(F.col("municipality_id") == place).select("stability_index")))  # one row
    sums = cells.groupBy("province").agg(*[F.sum(c).alias(c) for c in ("electors", "voters", "valid_votes")], *[F.sum(own_votes(v, k)).alias(k) for k, v in parties.items()])
    near = F.col("province") == F.col("home")
    of = lambda cond, a, b: pct(F.sum(F.when(cond, F.col(a))), F.sum(F.when(cond, F.col(b))))
    agg = [of(near, "voters", "electors").alias("province_turnout")] + [of(c, k, "valid_votes").alias(f"{n}_{k}") for k in parties for n, c in (("province", near), ("nation", F.lit(True)))]
    one = sums.crossJoin(F.broadcast(home)).groupBy(*home.columns).agg(*agg)
    say = lambda mode, level, measure, c: F.struct(F.lit(mode).alias("mode"), F.lit(level).alias("level"), F.lit(measure).alias("measure"), F.col(c).cast("double").alias("value"))
    rows = [say(k, level, "share", f"{pre}_{k}") for k in parties for level, pre in (("municipality", "own"), ("province", "province"), ("nation", "nation"))]
    rows += [say("", "municipality", "turnout", "turnout_pct"), say("", "province", "turnout", "province_turnout"), say("", "municipality", "stability", "stability_index")]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("value is not null")


def ranked(std: DataFrame) -> DataFrame:
    w = Window.partitionBy("election_key", "municipality_id").orderBy(F.desc("votes"), "party_std")
    return std.select("municipality_id", "party_std", "votes", F.row_number().over(w).cast("long").alias("rank"))


def trajectory(cells: DataFrame, place: str, parties: dict[str, str], top: int = 5) -> DataFrame:
    """(mode, series, election_year, value), nulls left out, in the three modes of one place's chart.

    ``selected_vs_context``: turnout, and for each grouping mode the share of its group in ``parties`` at the place, in its
    province of that year and in the nation. ``top_groups``: the share of the ``top`` groups by votes over all years in each
    grouping mode; ``top_parties``: the same by raw party.
    """
    own = cells.filter(F.col("municipality_id") == place)
    sums = cells.groupBy("election_year", "province").agg(F.sum("valid_votes").alias("valid_votes"), *[F.sum(own_votes(v, k)).alias(k) for k, v in parties.items()])
    nation = sums.groupBy("election_year").agg(*[pct(F.sum(k), F.sum("valid_votes")).alias(f"nation_{k}") for k in parties])
    near = sums.select("election_year", "province", *[pct(F.col(k), F.col("valid_votes")).alias(f"province_{k}") for k in parties])
    wide = own.select("election_year", "province", "turnout_pct", *[pct(own_votes(v, k), F.col("valid_votes")).alias(f"own_{k}") for k, v in parties.items()]).join(near, ["election_year", "province"], "left").join(nation, "election_year", "left")
    say = lambda series, c: F.struct(F.lit("selected_vs_context").alias("mode"), F.lit(series).alias("series"), F.col(c).alias("value"))
    series = F.array(say("turnout", "turnout_pct"), *[say(f"{pre} {k}", f"{pre}_{k}") for k in parties for pre in ("own", "province", "nation")])
    context = wide.select("election_year", F.explode(series).alias("s")).select("s.mode", "s.series", "election_year", "s.value")

    rows = own.select("election_year", "valid_votes", F.inline("raws"))
    long = rows.select("election_year", "valid_votes", "votes", F.explode(F.array(*[F.struct(F.lit("top_parties" if c == "party_raw" else f"top_groups {c}").alias("mode"), F.col(c).alias("series")) for c in MODES])).alias("g")).select("election_year", "valid_votes", "votes", "g.*")
    votes = long.groupBy("mode", "series", "election_year").agg(pct(F.sum("votes"), F.max("valid_votes")).alias("value"), F.sum("votes").alias("votes"))  # rows of one place
    w = Window.partitionBy("mode").orderBy(F.desc("total"), "series")
    first = votes.groupBy("mode", "series").agg(F.sum("votes").alias("total")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).select("mode", "series")
    return context.unionByName(votes.join(first, ["mode", "series"]).select("mode", "series", "election_year", "value")).filter("value is not null")
