"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's rows, in the order of their identifiers, are dealt into blocks. With shares a(s) that sum to W, block j of
source s may not run before its release ``floor(j * W / a)`` and not after its deadline ``ceil((j + 1) * W / a)``. In each
slot the released block with the earliest deadline runs. As the weights sum to one, every block meets its deadline, so at
any slot t each source has had within one block of its target ``t * a / W``. The schedule repeats every W slots; only that
one period is worked out (shares over their common divisor; more than ``max_period`` rows raise an error, as the plan is made
on the driver and broadcast), and every row's slot follows from it by arithmetic.

A source that runs out leaves its later slots empty; the others keep their ratios. No row is dropped or repeated.

Numbering a source's rows doesn't gather the source: rows are range-partitioned by (source, identifier), numbered inside
each partition, and moved up by the counts of the partitions before. A null source is a source; null identifiers come
first; rows repeated as a whole get numbers of their own; an empty table gives an empty result. Texts are not read by the
schedule. Columns besides the two named may have any names: helper columns take names that are free.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise


def _key(source: Column) -> Column:
    """A source as a text that is never null: ``=`` and its name, or ``-``."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def edf_period(shares: Mapping[str, int], max_period: int = 1_000_000) -> list[tuple[str, int, int, int, int]]:
    """One period: (source, block in the period, slot, release, deadline), by earliest deadline among the released blocks.

    Ties go to the smaller source name.
    """
    period = sum(shares.values())
    if period > max_period or any(a <= 0 for a in shares.values()):
        raise ValueError(f"shares must be positive and sum to at most {max_period}, not {period}")
    window = lambda s, j: (j * period // shares[s], -(-(j + 1) * period // shares[s]))
    waiting = [(0, window(s, 0)[1], s, 0) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, slot, release, deadline))
        if j + 1 < shares[s]:
            heapq.heappush(waiting, (*window(s, j + 1), s, j + 1))
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """(source_key, doc_id) with ``rank``, the row's number in its source, from 0."""
    dealt = rows.repartitionByRange(F.col("source_key"), F.col("doc_id")).sortWithinPartitions("source_key", "doc_id")
    at = F.monotonically_increasing_id()
    dealt = materialise(dealt.select("source_key", "doc_id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "mix-numbers")
    parts = dealt.groupBy("source_key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(parts, ["source_key", "part"]).select("source_key", "doc_id", (F.col("row") + F.col("shift")).alias("rank"))


def mix(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", max_period: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, source_rank, block, release_slot, deadline_slot, slot, place_in_block.

    (slot, place_in_block) is the order of the mixture. ``shares`` are whole numbers; a source not named has ``default_share``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(F.col(source_col)).alias("source_key"))
    names = [r[0] for r in rows.select("source_key").distinct().limit(max_period + 1).collect()]  # more than max_period fail just below
    shares = {s: shares.get(s[1:], default_share) if s[0] == "=" else default_share for s in names}
    common = math.gcd(*shares.values()) if shares else 1
    shares = {s: a // common for s, a in shares.items()}
    period = edf_period(shares, max_period)
    width = len(period)
    spark = docs.sparkSession
    table = spark.createDataFrame([(s, shares[s], j, slot, release, deadline) for s, j, slot, release, deadline in period], "source_key string, share long, in_period long, slot0 long, release0 long, deadline0 long")
    share = F.broadcast(table.select("source_key", "share").distinct())
    block = numbered(rows).withColumn("block", F.floor(F.col("rank") / F.lit(block_rows))).join(share, "source_key")
    block = block.withColumn("in_period", F.col("block") % F.col("share")).withColumn("start", F.floor(F.col("block") / F.col("share")) * F.lit(width))
    out = block.join(F.broadcast(table.drop("share")), ["source_key", "in_period"])
    return out.select(
        "doc_id", F.when(F.col("source_key") != "-", F.substring("source_key", 2, 1 << 30)).alias("source"), F.col("rank").alias("source_rank"), "block",
        (F.col("start") + F.col("release0")).alias("release_slot"), (F.col("start") + F.col("deadline0")).alias("deadline_slot"), (F.col("start") + F.col("slot0")).alias("slot"), (F.col("rank") % block_rows).alias("place_in_block"),
    )


def placed(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, str, str]:
    """``docs`` with their place in the mixture in two more columns, and these columns' names, which no other has."""
    key, slot, place, at = fresh(docs, "mix_id", "mix_slot", "mix_place", "mix_at")
    order = mix(docs, shares, default_share, block_rows, id_col, source_col).select(F.col("doc_id").alias(key), F.col("slot").alias(slot), F.col("place_in_block").alias(place))
    order = order.groupBy(key).agg(F.min(F.struct(slot, place)).alias(at))  # rows of one identifier share their first place
    out = docs.join(order, docs[id_col].eqNullSafe(order[key])).select(*[docs[c] for c in docs.columns], order[at][slot].alias(slot), order[at][place].alias(place))
    return out, slot, place


def in_mixed_order(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs``, columns unchanged, range-partitioned and sorted by the order of the mixture: each partition, and so each
    file written from it, holds one stretch of the schedule."""
    rows, slot, place = placed(docs, shares, default_share, block_rows, id_col, source_col)
    return rows.repartitionByRange(slot, place).sortWithinPartitions(slot, place, id_col).drop(slot, place)
