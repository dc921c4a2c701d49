"""Party labels to display name, family and bloc by ordered rules, first match wins."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from importlib.resources import files
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str, str]  # pattern, display, family, bloc


def read_rules(path: str | None = None, shipped: str = "ingest") -> tuple[Rule, ...]:
    """Rules of a CSV file with a header; lines that begin with # are comments. Without a path, the shipped ones: ``ingest``,
    or ``view`` (F30)."""
    text = Path(path).read_text("utf-8") if path else files("panelatlas").joinpath(f"data/party_rules_{shipped}.csv").read_text("utf-8")
    rows = csv.DictReader(line for line in text.splitlines() if not line.startswith("#"))
    return tuple((r["pattern"], r["display"], r["family"], r["bloc"]) for r in rows)


INGEST_V1 = read_rules()
VIEW_V1 = read_rules(shipped="view")


def party_meta(label: Column, rules: Sequence[Rule] = INGEST_V1) -> Column:
    """struct(display, family, bloc) of a label; without a match its own text and ``altro``."""
    t = F.trim(F.coalesce(label, F.lit("")))
    said = lambda d, f, b: F.struct(d.alias("display"), F.lit(f).alias("family"), F.lit(b).alias("bloc"))
    out = None
    for pattern, display, family, bloc in rules:
        hit = t.rlike("(?i)" + pattern)
        out = F.when(hit, said(F.lit(display), family, bloc)) if out is None else out.when(hit, said(F.lit(display), family, bloc))
    rest = said(F.coalesce(F.nullif(t, F.lit("")), F.lit("N/D")), "altro", "altro")
    return rest if out is None else out.otherwise(rest)


def classify(rows: DataFrame, label: str, rules: Sequence[Rule] = INGEST_V1) -> DataFrame:
    """Add party_display, party_family and party_bloc; rules run over distinct labels only."""
    known = rows.select(label).distinct().withColumn("m", party_meta(F.col(label), rules))
    known = known.select(F.col(label).alias("__label"), F.col("m.display").alias("party_display"), F.col("m.family").alias("party_family_by_rule"), F.col("m.bloc").alias("party_bloc_by_rule"))
    return rows.join(known, rows[label].eqNullSafe(known["__label"]), "left").drop("__label")
