"""Ingest arithmetic on raw rows: counts repaired, duplicates collapsed, segments added up, masters and reports built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_notes, squeeze

CELL = ["election_key", "municipality_id"]
# Notes that the published data carries.
NULLIFIED, COLLAPSED = "official_turnout_counts_anomalous_nullified", "party_duplicates_collapsed_max"


def fill_counts(rows: DataFrame) -> DataFrame:
    """electors from voters and turnout where they are missing or too few, voters from electors where missing; halves to even."""
    e, v, t = F.col("electors"), F.col("voters"), F.col("turnout_pct")
    from_voters = F.when(v != 0, F.bround(v / (t / 100)).cast("long"))
    from_electors = F.when(e != 0, F.bround(e * t / 100).cast("long"))
    new_e = F.when((t > 0) & (v != 0) & (e.isNull() | (e < v)), from_voters).otherwise(e)
    new_v = F.when((t > 0) & (new_e != 0) & v.isNull(), from_electors).otherwise(v)
    return rows.withColumns({"electors": new_e, "voters": new_v})


def valid_from_invalid(rows: DataFrame) -> DataFrame:
    """invalid votes are the table's total, else contested, null and blank ones together (nothing counts as missing);
    valid votes are voters less these, if not negative."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    invalid = F.coalesce("invalid_total", F.nullif(z("contested") + z("null_ballots") + z("blank"), F.lit(0)))
    return rows.withColumn("invalid", invalid).withColumn("valid_votes", F.when(F.col("voters") >= F.col("invalid"), F.col("voters") - F.col("invalid")))


def nullify_anomalous(rows: DataFrame) -> DataFrame:
    """where there are fewer electors than voters or more valid votes than voters, these counts go and a note says so."""
    bad = F.coalesce(F.col("electors") < F.col("voters"), F.lit(False)) | F.coalesce(F.col("valid_votes") > F.col("voters"), F.lit(False))
    keep = lambda c: F.when(~bad, F.col(c))
    return rows.withColumns({
        "electors": keep("electors"), "voters": keep("voters"), "turnout_pct": keep("turnout_pct"), "total_votes": F.when(bad, F.col("valid_votes")).otherwise(F.col("total_votes")),
        "comparability_note": F.when(bad, join_notes(F.col("comparability_note"), F.lit(NULLIFIED))).otherwise(F.col("comparability_note")),
    })


def collapse_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the same keys (none null) become one: votes added (none: 0), first text and note by ``ord``, mean raw share."""
    first = lambda c: F.min_by(c, "ord").alias(c)
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"), first("votes_raw_text"), F.avg("vote_share_raw").alias("vote_share_raw"), first("comparability_note"))


def collapse_implausible(rows: DataFrame) -> DataFrame:
    """Cells with more rows than parties and a share over 100.01 or a sum over 150 keep, per party, the most votes and
    the highest raw share; the first label is that of the row with most votes."""
    stats = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("party_std").alias("parties"), F.sum("vote_share").alias("total"), F.max("vote_share").alias("top"))
    bad = stats.filter((F.col("n") > F.col("parties")) & ((F.col("top") > 100.01) | (F.col("total") > 150))).select(*CELL)
    good = rows.join(bad, CELL, "left_anti").select(*CELL, "party_std", "party_raw", "votes", "vote_share_raw", "comparability_note")
    order = F.struct(-F.coalesce("votes", F.lit(-1)), -F.coalesce("vote_share_raw", F.lit(-1.0)), "party_raw")
    merged = rows.join(bad, CELL).groupBy(*CELL, squeeze(F.coalesce("party_std", "party_raw")).alias("party_key")).agg(
        F.min_by("party_std", order).alias("party_std"), F.min_by("party_raw", order).alias("party_raw"), F.max("votes").alias("votes"), F.max("vote_share_raw").alias("vote_share_raw"))
    return good.unionByName(merged.drop("party_key").withColumn("comparability_note", F.lit(COLLAPSED)))


def segment_totals(rows: DataFrame, counts: Sequence[str]) -> DataFrame:
    """A segment repeats its counts on each row, so the highest within a segment, added over segments; 0 is none."""
    per = rows.groupBy(*CELL, "segment").agg(*[F.max(c).alias(c) for c in counts])
    return per.groupBy(*CELL).agg(*[F.nullif(F.sum(c), F.lit(0)).alias(c) for c in counts])


def party_votes(rows: DataFrame) -> DataFrame:
    """Positive votes per cell and party; the first raw label by ``ord`` and, with it, all of them."""
    return rows.filter("votes > 0").groupBy(*CELL, "party_std").agg(F.sum("votes").alias("votes"), F.min_by("party_raw", "ord").alias("party_raw"), F.array_join(F.array_sort(F.collect_set("party_raw")), "|").alias("all_raw"))


def valid_or_party_sum(valid: Column, party_sum: Column, top: Column) -> Column:
    """The parties' sum stands for valid votes that are missing, below the largest party, or below half of the sum."""
    return F.when(valid.isNull() | (valid < top) | (valid < F.floor(0.5 * party_sum)), party_sum).otherwise(valid)


def canonical_places(rows: DataFrame) -> DataFrame:
    """Per identifier its latest row's name, its names in order of year, and the first that isn't the current one."""
    latest = F.max_by("municipality_name", F.struct("election_year", "municipality_name")).alias("municipality_name")
    names = rows.groupBy("municipality_id", "municipality_name").agg(F.min("election_year").alias("since"))
    listed = names.groupBy("municipality_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("since", "municipality_name"))), lambda x: x["municipality_name"]).alias("aliases"))
    current = rows.groupBy("municipality_id").agg(latest)
    other = F.filter("aliases", lambda x: x != F.col("municipality_name"))
    return current.join(listed, "municipality_id").select("municipality_id", "municipality_name", F.array_join("aliases", "|").alias("alias_names"), F.get(other, F.lit(0)).alias("name_historical"))


def coverage_score(summary: DataFrame, results: DataFrame, elections: DataFrame) -> DataFrame:
    """70 parts for elections with summary rows, 30 for those with results; halves to even."""
    n = lambda df, name: df.agg(F.count_distinct("election_key").cast("double").alias(name))  # noqa: E731  # one row each
    one = n(summary, "s").crossJoin(n(results, "r")).crossJoin(n(elections, "t"))
    return one.select(F.bround((0.7 * F.col("s") / F.col("t") + 0.3 * F.col("r") / F.col("t")) * 100).cast("long").alias("coverage"))


def gap_report(expected: DataFrame, summary: DataFrame) -> DataFrame:
    """Per election the places found against those expected, and what is wrong with it."""
    found = summary.groupBy("election_key").agg(F.count_distinct("municipality_id").alias("found"))
    both = expected.join(found, "election_key", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    e, f = F.col("expected"), F.col("found")
    flags = [((e > 0) & (f == 0), "bundle_empty_archive_nonempty"), ((e > 0) & (f < e), "bundle_below_archive_positive_tables"), ((e > 0) & (f / e < 0.9), "bundle_severely_partial_vs_archive"), (F.coalesce("unresolved", F.lit(0)) > 0, "bundle_rows_without_geometry_join")]
    return both.select("election_key", "expected", "found", F.when(e > 0, F.bround(f / e, 4)).alias("ratio"), F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in flags])), "|").alias("flags"))


def gap_counts(report: DataFrame) -> DataFrame:
    """Elections per flag, and those with any."""
    any_flag = report.filter("flags <> ''").select(F.lit("with_any_flags").alias("flag"))
    return report.select(F.explode(F.split("flags", r"\|")).alias("flag")).filter("flag <> ''").unionByName(any_flag).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def invalid_from_tables(cells: DataFrame) -> DataFrame:
    """Per url, of the rows of its tables joined to texts, the last that names invalid votes and the first that names
    blank ones. ``cells`` has url, table_idx, rownum, column_name, cell_value."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("column_name", "cell_value"))), lambda x: x["cell_value"])
    rows = cells.filter("trim(cell_value) <> '' and lower(cell_value) <> 'nan'").groupBy("url", "table_idx", "rownum").agg(F.array_join(parts, " ").alias("text"))
    low, at = squeeze(F.col("text")), F.struct("table_idx", "rownum")
    invalid = low.contains("non valide")
    return rows.groupBy("url").agg(F.max_by("text", F.when(invalid, at)).alias("invalid_text"), F.min_by("text", F.when(~invalid & low.contains("bianche"), at)).alias("blank_text"))


def completeness_flag(base: Column, party_rows: Column, first_party: Column) -> Column:
    """whether party results are there, and whether the source is partial."""
    has = (party_rows > 0) & (F.trim(F.coalesce(first_party, F.lit(""))) != "")
    partial = F.coalesce(F.nullif(base, F.lit("")), F.lit("partial_clean_ingest")).contains("partial")
    return F.concat(F.when(partial, "partial_").otherwise(""), F.when(has, "clean_ingest_party_results_checked").otherwise("clean_ingest_turnout_only"))


def registry(elections: DataFrame, summary: DataFrame, results: DataFrame) -> DataFrame:
    """Row counts of each election, whether it is usable, and what a completed one without rows becomes."""
    n = lambda df, c: df.groupBy("election_key").agg(F.count(F.lit(1)).alias(c))
    both = elections.join(n(summary, "summary_rows"), "election_key", "left").join(n(results, "result_rows"), "election_key", "left").fillna(0, ["summary_rows", "result_rows"])
    s, r = F.col("summary_rows") > 0, F.col("result_rows") > 0
    label = F.when(s & r, "summary+results").when(s, "summary_only").when(r, "results_only").otherwise("empty")
    lacking = (F.col("status") == "completed") & ~s
    return both.select("election_key", "summary_rows", "result_rows", F.when(s | r, "usable").otherwise("empty").alias("registry_status"), label.alias("coverage_label"), F.when(lacking, "completed_without_rows").otherwise(F.col("status")).alias("status"), F.when(lacking, "false").otherwise(F.col("is_complete")).alias("is_complete"))


def first_of(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first by ``order``."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def unique_names(rows: DataFrame, name: str, of: Sequence[str]) -> DataFrame:
    """Names that stand for one identity only, and which."""
    who = F.struct(*of)
    return rows.groupBy(name).agg(F.min(who).alias("lo"), F.max(who).alias("hi")).filter("lo = hi").select(name, "lo.*")
