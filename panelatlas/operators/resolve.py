"""Names resolved against reference tables: by whole keys, by prefixes, by near spelling, one round after the other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.panel_store import stored
from .fuzzy import fuzzy_match
from .ingest import unique_names

# What a resolution is called, in the order of precedence.
STRATEGIES = [
    "manual_override", "geometry_name_province", "geometry_name_region", "geometry_name", "historical_geometry_name_province", "historical_geometry_name_region", "historical_geometry_name",
    "historical_geometry_prefix_province", "historical_geometry_prefix", "geometry_name_region_fuzzy",
]


def _prefix_bounds(names: DataFrame, known: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(name, *on, lo, hi): the lowest and highest identifier of the known names that begin a name or begin with it."""
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))).alias("prefix")
    lo_hi = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    same = names.filter("name <> ''").select("name", *on).distinct()
    known = known.filter("known_name <> ''").select("known_name", *on, F.col("id").alias("lo"), F.col("id").alias("hi"))
    begun = known.select(prefixes("known_name"), *on, "lo", "hi").groupBy("prefix", *on).agg(*lo_hi).withColumnRenamed("prefix", "name")
    whole = known.groupBy(F.col("known_name").alias("prefix"), *on).agg(*lo_hi)
    longer = same.select("name", *on, prefixes("name")).join(whole, ["prefix", *on]).select("name", *on, "lo", "hi")
    return same.join(begun, ["name", *on]).select("name", *on, "lo", "hi").unionByName(longer).groupBy("name", *on).agg(*lo_hi)


def prefix_match(names: DataFrame, known: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(name, *on, id) of a name that begins a known one, or begins with it, if all such agree on one identifier.

    ``names`` has name and the columns ``on``, ``known`` has known_name, id and ``on``; names of any length take part, empty
    and null ones meet nothing. A name is joined with known names' prefixes, and its own prefixes with known names; of a prefix
    only its lowest and highest identifier count, so a prefix that many known names share stays one row and no pairs arise.
    """
    return _prefix_bounds(names, known, on).filter("lo = hi").select("name", *on, F.col("lo").alias("id"))


def _one(rows: DataFrame, on: list[str]) -> DataFrame:
    """One identifier for each key: the smallest."""
    return rows.groupBy(*on).agg(F.min("id").alias("id"))


def cascade(names: DataFrame, overrides: DataFrame, geometry: DataFrame, historical: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: stored(df, "resolved")) -> DataFrame:
    """(row, candidate, strategy, id) of the rows that any of the ten strategies resolves.

    ``names``: row, candidate (its order), key, province, region; the candidate 0 is the row's own name. ``overrides``: key, id.
    ``geometry`` and ``historical``: key, province, region, id. All keys are normalised.

    Seven strategies meet whole keys; the first candidate that any of them knows counts, by the first that does, so a weak one
    of an early candidate goes before a strong one of a late candidate. By name alone only names of one identifier count; of
    several in a province or region the smallest does. What is left is tried by prefix within the province, over all candidates
    of a row together, then by prefix anywhere, then by near spelling of the row's own name within its region; each must meet
    one identifier only. Each round gets only what is unresolved; ``keep`` writes the names and each round's outcome, so that
    no round is worked out again by the next.
    """
    names, alone = keep(names), lambda t: unique_names(t, "key", ["id"])
    tables = [(overrides, ["key"]), *((_one(t, on) if len(on) > 1 else alone(t), on) for t in (geometry, historical) for on in (["key", "province"], ["key", "region"], ["key"]))]
    hits = [names.filter("key <> ''").join(t, on).select("row", F.struct("candidate", F.lit(i).alias("strategy"), "id").alias("hit")) for i, (t, on) in enumerate(tables)]
    done = keep(reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.min("hit").alias("hit")).select("row", "hit.candidate", "hit.strategy", "hit.id"))

    known = historical.withColumnRenamed("key", "known_name")
    for i, on in ((7, ("province",)), (8, ())):
        left = names.join(done.select("row"), "row", "left_anti").filter("key <> ''").withColumnRenamed("key", "name")
        # A candidate without any match says nothing; one with several identifiers spoils the row, as all candidates count together.
        met = _prefix_bounds(left, known, on)
        found = left.join(met, ["name", *on]).groupBy("row").agg(F.min("lo").alias("id"), F.max("hi").alias("hi"), F.min("candidate").alias("candidate")).filter("id = hi")
        done = keep(done.unionByName(found.select("row", "candidate", F.lit(i).alias("strategy"), "id")))

    left = names.filter("candidate = 0").join(done.select("row"), "row", "left_anti")
    each = left.select("key", "region").distinct().select(F.concat_ws("\x00", "key", "region").alias("name_id"), F.col("key").alias("name"), "region")
    near = fuzzy_match(each, geometry.select(F.col("id").alias("place_id"), F.col("key").alias("name"), "region"))
    found = left.withColumn("name_id", F.concat_ws("\x00", "key", "region")).join(near, "name_id").select("row", "candidate", F.lit(9).alias("strategy"), F.col("place_id").alias("id"))
    names_of = F.array(*[F.lit(x) for x in STRATEGIES])
    return done.unionByName(found).select("row", "candidate", names_of[F.col("strategy")].alias("strategy"), "id")


def search(queries: DataFrame, *sources: DataFrame) -> DataFrame:
    """(query, source, id): per query the first record that holds it, of the first source that has one. A source has id, ord
    and text; texts and queries are compared in lower case, trimmed, empty queries find nothing.

    Texts are indexed by their pieces of one to three letters; a query is looked up by its rarest piece alone, and what that
    finds is compared in full. So no query meets all texts, unless it is a letter that all hold.
    """
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n) if isinstance(n, int) else n)))
    texts = [s.select(F.lit(i).alias("source"), "id", "ord", F.lower("text").alias("text")) for i, s in enumerate(sources)]
    texts = reduce(DataFrame.unionByName, texts).filter("text <> ''")
    sized = [F.when(F.length("text") >= n, pieces("text", n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    index = texts.select("*", F.explode(F.concat(*sized)).alias("piece"))
    asked = queries.select("query", F.lower(F.trim("query")).alias("said")).filter("said <> ''").distinct()
    keys = asked.select("query", "said", F.explode(pieces("said", F.least(F.lit(3), F.length("said")))).alias("piece"))
    seen = index.join(keys.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.join(seen, "piece", "left").groupBy("query", "said").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    hits = index.join(rarest, "piece").filter(F.contains("text", F.col("said")))
    return hits.groupBy("query").agg(F.min(F.struct("source", "ord", "id")).alias("hit")).select("query", "hit.source", "hit.id")


def alias_rows(places: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """(municipality_id, alias, alias_type): each place's current name, its former one where that is another, and of each
    its ``normal`` form where that is new; blank names and the text nan are none."""
    tidy = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan"), None).otherwise(F.trim(c))
    current, former = tidy("name_current"), tidy("name_historical")
    said = lambda c, kind, at: F.struct(c.alias("alias"), F.lit(kind).alias("alias_type"), F.lit(at).alias("at"))
    kinds = [said(current, "current_name", 0), said(F.nullif(normal(current), F.lit("")), "normalized_name", 1), said(former, "historical_name", 2), said(F.nullif(normal(former), F.lit("")), "normalized_name", 3)]
    rows = places.select("municipality_id", F.explode(F.array(*kinds)).alias("a")).select("municipality_id", "a.*").filter("alias is not null")
    return rows.groupBy("municipality_id", "alias").agg(F.min_by("alias_type", "at").alias("alias_type")).select("municipality_id", "alias", "alias_type")
