"""Feature vectors, deterministic k-means, trajectory similarity, archetypes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel_store import stored

FEATURES = ["share", "volatility", "stability", "turnout", "changes", "over"]


def cluster_count(n: int) -> int:
    """None below 6 rows, else 3 to 5."""
    return 0 if n < 6 else max(3, min(5, round(math.sqrt(n / 6)) + 2))


def kmeans(vectors: DataFrame, rounds: int = 12) -> DataFrame:
    """municipality_id, cluster: Lloyd's rounds from the first k vectors by identifier, ties to the lowest number, an empty
    cluster keeps its centroid. Vectors are written once and read once a round; only k centroids go between driver and tasks."""
    vectors = stored(vectors, "vectors")
    k = cluster_count(vectors.count())
    centroids = [tuple(float(r[c]) for c in FEATURES) for r in vectors.orderBy("municipality_id").limit(k).collect()]

    def assigned():
        d = F.array(*[F.struct(sum(((F.col(c) - F.lit(m)) ** 2 for c, m in zip(FEATURES, one)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, one in enumerate(centroids)])
        return vectors.withColumn("cluster", F.array_min(d)["i"])

    if not k:
        return vectors.select("municipality_id", F.lit(0).alias("cluster")).limit(0)
    for _ in range(rounds):
        means = {r["cluster"]: tuple(float(r[c]) for c in FEATURES) for r in assigned().groupBy("cluster").agg(*[F.avg(c).alias(c) for c in FEATURES]).collect()}
        centroids = [means.get(i, c) for i, c in enumerate(centroids)]
    return assigned().select("municipality_id", "cluster")


def similarity(rows: DataFrame, targets: list[str], groups: DataFrame, top: int = 6) -> DataFrame:
    """For each target the ``top`` places whose trajectory is closest over common years, of all places (list ``nearest``)
    and of its own group (``same_cluster``): target, list, municipality_id, n, distance, score, rank.

    Each common year adds squared differences of share in steps of 10 and of turnout in steps of 12, 0.45 for another leader
    and 0.35 for another bloc; score = max(0, 100 - 28 * sqrt(sum / n)), n counting the shares and turnouts compared. A place's
    years are put in one row first, so pairs of places move nothing; ``targets`` is a short stated list, ``groups`` has
    municipality_id and cluster, and places without one have no same_cluster.
    """
    year = F.struct("election_year", "share", "turnout_pct", F.col("first_party_std").alias("leader"), F.col("dominant_block").alias("block"))
    paths = lambda df: df.groupBy("municipality_id").agg(F.collect_list(year).alias("years")).join(groups, "municipality_id", "left")
    asked = paths(rows.filter(F.col("municipality_id").isin(targets))).select(F.col("municipality_id").alias("target"), F.col("years").alias("theirs"), F.col("cluster").alias("own"))
    pairs = paths(rows).crossJoin(F.broadcast(asked)).filter("municipality_id <> target")  # a stated list against all places
    at = lambda x: F.get(F.filter("theirs", lambda t: t["election_year"] == x["election_year"]), F.lit(0))
    both = F.filter(F.transform("years", lambda x: F.struct(x.alias("a"), at(x).alias("b"))), lambda x: x["b"].isNotNull())
    gap = lambda x, c, k: F.pow((x["a"][c] - x["b"][c]) / k, 2)
    other = lambda x, c, k: F.when(x["a"][c] != x["b"][c], k).otherwise(0.0)
    known = lambda x, c: F.when(x["a"][c].isNotNull() & x["b"][c].isNotNull(), 1).otherwise(0)
    term = lambda x: F.coalesce(gap(x, "share", 10.0), F.lit(0.0)) + F.coalesce(gap(x, "turnout_pct", 12.0), F.lit(0.0)) + other(x, "leader", 0.45) + other(x, "block", 0.35)
    pairs = pairs.select("target", "municipality_id", "own", "cluster", both.alias("both"))
    sq, n = F.aggregate("both", F.lit(0.0), lambda a, x: a + term(x)), F.aggregate("both", F.lit(0), lambda a, x: a + known(x, "share") + known(x, "turnout_pct"))
    scored = pairs.select("target", "municipality_id", n.cast("long").alias("n"), F.sqrt(F.try_divide(sq, n)).alias("d"), (F.col("own") == F.col("cluster")).alias("same")).filter("n > 0")
    lists = F.when(F.col("same"), F.array(F.lit("nearest"), F.lit("same_cluster"))).otherwise(F.array(F.lit("nearest")))
    scored = scored.select("target", F.explode(lists).alias("list"), "municipality_id", "n", F.round("d", 6).alias("distance"), F.round(F.greatest(F.lit(0.0), 100 - 28 * F.col("d")), 6).alias("score"))
    order = Window.partitionBy("target", "list").orderBy(F.desc("score"), "municipality_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def cluster_label() -> Column:
    """What a cluster's centroid says, over the columns of FEATURES."""
    share, stable = F.col("share"), F.col("stability") >= 60
    return F.concat_ws(
        " · ", F.when(share >= 20, "quota alta").when(share >= 10, "quota media").otherwise("quota bassa"), F.when(F.col("volatility") >= 8, "volatile").otherwise("più stabile"),
        F.when(stable, "dominanza stabile").when(F.col("changes") >= 3, "leader mobili").otherwise("equilibrato"), F.when(F.col("turnout") >= 75, "alta affluenza").otherwise("affluenza intermedia"),
    )


def fallback_label(block: Column, tier: Column, volatility: Column, changes: Column) -> Column:
    """A place's label where there are too few for clusters."""
    moved = F.when(volatility.isNull(), "volatilità n/d").when(volatility >= 10, "alta volatilità").when(volatility >= 5, "volatilità media").otherwise("bassa volatilità")
    return F.concat_ws(" · ", block, tier, moved, F.when(changes >= 4, "molti cambi").when(changes >= 2, "alcuni cambi").otherwise("stabile"))
