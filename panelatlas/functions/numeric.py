"""Number parsing and repair as Column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(text: Column, drop: str) -> Column:
    return F.trim(F.regexp_replace(text, drop, ""))


def safe_float(text: Column) -> Column:
    """Ingest parser: the last of comma and point is the decimal mark; grouped thousands by points alone are whole numbers."""
    t = _clean(text, r"[%\s]")
    comma, point = t.contains(","), t.contains(".")
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    both = F.when(comma_last, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))
    fixed = F.when(comma & point, both).when(comma, F.translate(F.translate(t, ".", ""), ",", ".")).when(t.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.translate(t, ".", "")).otherwise(t)
    return fixed.try_cast("double")


def safe_number(text: Column) -> Column:
    """Reader parser: as above, but ``1.234`` stays a decimal, only the first comma turns into a point, and % is not read."""
    t = _clean(text, r"\s")
    comma, point = t.contains(","), t.contains(".")
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    both = F.when(comma_last, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))
    return F.when(comma & point, both).when(comma, F.regexp_replace(t, "^([^,]*),", "$1.")).otherwise(t).try_cast("double")


def safe_pct(value: Column, basis_points: bool = False) -> Column:
    """Percentages that may come in basis points."""
    if basis_points:
        return F.when(value > 1, value / 100).otherwise(value)
    return F.when((value > 100) & (value <= 10000), value / 100).otherwise(value)


def safe_count(text: Column, thousands_first: bool = False) -> Column:
    """a whole number: ``d.0`` is rounded, else all but digits is dropped. ``thousands_first`` reads ``1.000`` as 1000."""
    t = F.trim(text)
    digits = F.regexp_replace(t, r"\D", "")
    whole = F.when(t.rlike(r"^-?\d+\.0+$"), F.round(t.try_cast("double")).cast("long")).otherwise(F.when(digits != "", digits).try_cast("long"))
    return F.when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), digits.try_cast("long")).otherwise(whole) if thousands_first else whole


def archive_count(text: Column) -> Column:
    """``safe_count``, but up to three decimals that aren't zero are thousands: ``1.5`` is 1500."""
    t = F.trim(text)
    whole, part = F.regexp_extract(t, r"^(\d+)\.(\d{1,3})$", 1), F.regexp_extract(t, r"^(\d+)\.(\d{1,3})$", 2)
    return F.when(t.rlike(r"^\d+\.\d{1,3}$") & ~part.rlike("^0+$"), F.concat(whole, F.rpad(part, 3, "0")).try_cast("long")).otherwise(safe_count(text))


def share_denominator(valid: Column, party_sum: Column, voters: Column, raw_share: Column) -> Column:
    """struct(denominator, method): valid votes if plausible against the parties' sum, else that sum, else voters."""
    plausible = (valid > 0) & (party_sum >= valid * 0.5) & (party_sum <= valid * 1.05)
    said = lambda d, m: F.struct(d.cast("double").alias("denominator"), F.lit(m).alias("method"))
    return F.when(plausible, said(valid, "share_recomputed_from_valid_votes")).when(party_sum > 0, said(party_sum, "share_recomputed_from_party_sum")).when((voters > 0) & raw_share.isNotNull(), said(voters, "share_fallback_on_voters")).otherwise(said(F.lit(None), "share_raw_fallback"))


def repair_magnitude(votes: Column, raw_share: Column, denominator: Column) -> Column:
    """Of votes times 1, 10, 100, 1000 the one closest to the raw share, if closer than votes by more than 0.02; a raw share
    outside 0 to 100.01 says nothing."""
    aim = raw_share * denominator / 100
    off = lambda k: F.try_divide(F.abs(votes * k - aim), aim)
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(i).alias("i"), (votes * k).cast("long").alias("v")) for i, k in enumerate((1, 10, 100, 1000))]))
    return F.when((aim > 0) & raw_share.between(0, 100.01) & (best["off"] < off(1) - 0.02), best["v"]).otherwise(votes)


def clamp100(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))
