"""Validations, readiness, and trust scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_meaningful_note, notes, squeeze


#: The rules, and whether a failing one is an error or a warning.
RULES = {
    "turnout_out_of_range": "error", "electors_below_voters": "error", "valid_above_voters": "error", "turnout_mismatch": "warning", "missing_province": "warning", "misleading_checked_flag": "error", "missing_turnout_only_flag": "warning",
    "share_out_of_range": "error", "share_sum_out_of_range": "warning", "votes_differ_from_valid": "warning", "leader_mismatch": "error",
}


def validations(summ: DataFrame, res: DataFrame) -> DataFrame:
    """One row per rule: check, severity, affected. ``summ`` has counts, leader, completeness_flag and comparability_note of each cell, ``res``
    its parties with votes and vote_share. The tables meet once; the rules are conditional counts, unpivoted at the end."""
    keys = ["election_key", "municipality_id"]
    best = F.min_by(F.struct("party_std", "vote_share"), F.struct(-F.col("votes"), F.col("party_std")))
    cells = res.groupBy(*keys).agg(F.sum("votes").alias("votes"), F.sum("vote_share").alias("share"), F.sum(F.when((F.col("vote_share") < -0.01) | (F.col("vote_share") > 100.01), 1).otherwise(0)).alias("bad"), best.alias("lead"))
    both = summ.select(*keys, "province", "electors", "voters", "valid_votes", "turnout_pct", "first_party_std", "first_party_share", "completeness_flag", "comparability_note", F.lit(True).alias("known")).join(cells, keys, "full")
    flag, none = F.coalesce("completeness_flag", F.lit("")), F.col("known") & (F.trim(F.coalesce("first_party_std", F.lit(""))) == "")
    off = F.coalesce(F.col("lead.party_std") != F.col("first_party_std"), F.lit(False)) | F.coalesce(F.abs(F.col("lead.vote_share") - F.col("first_party_share")) > 0.6, F.lit(False))
    when = {
        "turnout_out_of_range": (F.col("turnout_pct") < -0.01) | (F.col("turnout_pct") > 100.01), "electors_below_voters": F.col("electors") < F.col("voters"), "valid_above_voters": F.col("valid_votes") > F.col("voters"),
        "turnout_mismatch": F.abs(F.col("turnout_pct") - F.try_divide(F.lit(100.0) * F.col("voters"), F.col("electors"))) > 1.5, "missing_province": F.col("known") & (F.coalesce(F.trim("province"), F.lit("")) == ""),
        "misleading_checked_flag": none & F.col("comparability_note").contains("party_rows_checked"), "missing_turnout_only_flag": none & ~flag.contains("turnout_only"),
        "share_sum_out_of_range": (F.col("share") < 90) | (F.col("share") > 110), "votes_differ_from_valid": F.try_divide(F.abs(F.col("votes") - F.col("valid_votes")), F.col("valid_votes")) > 0.08, "leader_mismatch": off,
    }
    n = {k: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)) for k, c in when.items()} | {"share_out_of_range": F.coalesce(F.sum("bad"), F.lit(0))}
    wide = both.agg(*[n[k].cast("long").alias(k) for k in RULES])
    severity = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    return wide.unpivot([], list(RULES), "check", "affected").select("check", severity[F.col("check")].alias("severity"), "affected")


def readiness(checks: DataFrame) -> DataFrame:
    """100 less 25 per failing error check and 10 per failing warning check; by check, not by row."""
    n = lambda s: F.sum(F.when((F.col("affected") > 0) & (F.col("severity") == s), 1).otherwise(0))
    return checks.agg(F.greatest(F.lit(0), 100 - 25 * n("error") - 10 * n("warning")).cast("long").alias("readiness"))


def band(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 55, "caution").otherwise("fragile")


# Word stems that name a change of territory.
CHANGED = ["supp", "fuso", "merge", "rename", "stor", "harmon", "scorpor", "derived"]


def _flag() -> Column:
    return squeeze(F.coalesce("completeness_flag", F.lit("")))


def row_trust(rows: DataFrame, geometry_loaded: bool = True, compare_missing: bool = False) -> DataFrame:
    """Add trust_score, trust_status and trust_reasons. Reads completeness_flag, comparability_note, territorial_mode,
    territorial_status, lineage_note and has_geometry. Of partial, undeclared and turnout-only the first alone counts."""
    flag, no = _flag(), F.lit(False)
    partial, undeclared = flag.contains("partial"), (flag == "") | (flag == "unknown")
    rules = [
        (~F.coalesce("has_geometry", no) if geometry_loaded else no, 22, "no_geometry"), (partial, 28, "partial"), (~partial & undeclared, 12, "undeclared"), (~partial & ~undeclared & flag.contains("turnout_only"), 12, "turnout_only"),
        (F.array_contains(notes(F.col("comparability_note")), "no_party_rows_detected"), 8, "no_party_rows"), (has_meaningful_note(F.col("comparability_note")), 12, "note"), (squeeze(F.coalesce("territorial_status", F.lit(""))).rlike("|".join(CHANGED)), 10, "transformed"),
        (F.coalesce(F.trim("lineage_note"), F.lit("")) != "", 6, "lineage"), (F.lit(compare_missing), 18, "no_compare"), (F.coalesce(F.col("territorial_mode"), F.lit("")) == "harmonized", 4, "harmonized"),
    ]
    score = F.greatest(F.lit(0), 100 - sum((F.when(c, k).otherwise(0) for c, k, _ in rules), F.lit(0)))
    return rows.select("*", score.alias("trust_score"), band(score).alias("trust_status"), F.array_compact(F.array(*[F.when(c, name) for c, _, name in rules])).alias("trust_reasons"))


def view_trust(rows: DataFrame, geometry_loaded: bool = True, compare_missing: bool = False, harmonized: bool = False) -> DataFrame:
    """Trust of a whole view; nothing in view scores 0."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    flag = _flag()
    a = rows.agg(F.count(F.lit(1)).alias("n"), share(F.coalesce("has_geometry", F.lit(False))).alias("geo"), share(flag.contains("partial")).alias("partial"), share(flag.contains("turnout_only")).alias("only"), share((flag == "") | (flag == "unknown")).alias("unknown"))
    geo = F.when(F.col("geo") < 0.5, 28).when(F.col("geo") < 0.9, 14).otherwise(0) if geometry_loaded else F.lit(18)
    lost = geo + F.when(F.col("partial") > 0.25, 22).when(F.col("partial") > 0, 10).otherwise(0) + F.when(F.col("only") > 0.3, 10).when(F.col("only") > 0, 4).otherwise(0) + F.when(F.col("unknown") > 0.3, 8).otherwise(0)
    lost = lost + F.lit(20 * compare_missing + 4 * harmonized)
    score = F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(0), 100 - lost))
    return a.select("n", score.alias("trust_score"), band(score).alias("trust_status"))


def evidence(trust: DataFrame, substantive: int, compare_ready: bool = True, party_ready: bool = True, geometry_ready: bool = True) -> DataFrame:
    """How much a view can be leant on. A strong trust status stands for the level that the rule asks for."""
    n, status = F.col("n"), F.col("trust_status")
    strong = (status == "strong") & (n >= 20) & F.lit(substantive >= 40 and compare_ready and party_ready and geometry_ready)
    return trust.select("n", "trust_status", F.when(strong, "strong").when((status != "fragile") & (n >= 5) & F.lit(compare_ready), "cautious").otherwise("exploratory").alias("evidence"))


def column_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the percentage of values that aren't blank; 0 for an empty table."""
    filled = rows.agg(*[F.coalesce(F.avg(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", 100.0).otherwise(0.0)), F.lit(0.0)).alias(c) for c in columns])
    return filled.unpivot([], columns, "column_name", "coverage_pct")
