"""Names met by a near spelling in the same region."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.panel_store import stored

LEAST = 0.91
SPARE = (1 - LEAST) * (1 + (2 - LEAST) / LEAST)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


MOST = {0: 1 << 31, 1: 1000, 2: 45, 3: 19}  # of so many letters a name may have to be shortened by 0 to 3 of them


def _letters(rows: DataFrame, c: str) -> DataFrame:
    """The letters of all texts of a column, as one text."""
    each = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
    return rows.select(F.explode(F.array_distinct(each)).alias("letter")).distinct().agg(F.array_join(F.collect_list("letter"), "").alias("known"))  # one row


def _kept(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their lengths (m, n) and what is left of each text without the letters that no text of the other side has, and
    that length (mk, nk): such letters are over in any match."""
    if "mk" in left.columns:
        return left, right
    own = lambda rows, c, known, text, size: rows.crossJoin(F.broadcast(known)).withColumn(text, F.expr(f"translate({c}, translate({c}, known, ''), '')")).withColumn(size, F.length(c)).withColumn(f"{size}k", F.length(text)).drop("known")
    return own(left, "name", _letters(right, "place"), "kept", "m"), own(right, "place", _letters(left, "name"), "kept", "n")


def _levels(names: DataFrame, places: DataFrame) -> DataFrame:
    """(m, mk, n, nk, whole, few): the lengths that may meet, the least letters their match holds, and whether few letters are over."""
    names, places = _kept(names, places)
    m, n = F.col("m"), F.col("n")
    pairs = names.select("m", "mk").distinct().crossJoin(F.broadcast(places.select("n", "nk").distinct()))  # a row a length
    pairs = pairs.filter((F.abs(m - n) <= 8) & (2 * F.least(m, n) >= LEAST * (m + n) - 1e-9))
    pairs = pairs.withColumn("whole", F.ceil(LEAST * (m + n) / 2 - 1e-9).cast("int")).filter("whole <= least(mk, nk)")
    few = lambda c: reduce(lambda a, b: a | b, [(F.col(c) - F.col("whole") == k) & (F.col(c) <= most) for k, most in MOST.items()])
    return pairs.withColumn("few", few("mk") & few("nk"))


def _shortened(c: str, by: Column) -> Column:
    """All texts that ``by`` letters fewer (up to 3) leave of a text."""
    less = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    more = lambda ts: F.array_distinct(F.flatten(F.transform(ts, less)))
    one = F.array_distinct(less(F.col(c)))
    return F.when(by == 0, F.array(c)).when(by == 1, one).when(by == 2, more(one)).otherwise(more(more(one)))


PARTS = 4  # of the rests, by their hash
ROUNDS = [(0, 1), (1, PARTS)]  # first a part of them, the others for the names that it leaves


def _by_letters(left: DataFrame, right: DataFrame, levels: DataFrame, rests: tuple[int, int] = (0, PARTS)) -> DataFrame:
    """Pairs with a common rest after the letters that may be over are left out; ``rests`` says which parts of the rests. Rests
    meet by their hash, as pairs are scored."""
    left, right = _kept(left, right)
    few = levels.filter("few")

    def rest(rows: DataFrame, size: str, *cols: str | Column) -> DataFrame:
        rows = rows.join(F.broadcast(few.select(size, f"{size}k", "whole").distinct()), [size, f"{size}k"])
        rows = rows.withColumn("rest", F.explode(_shortened("kept", F.col(f"{size}k") - F.col("whole")))).select(F.xxhash64("region", "rest").alias("h"), *cols)
        return rows if rests == (0, PARTS) else rows.filter(F.pmod("h", F.lit(PARTS)).between(rests[0], rests[1] - 1))

    a, b = rest(left, "m", "name_id", "name", "region"), rest(right, "n", "place_id", "place", F.col("region").alias("r"))
    return a.join(b, "h").filter("region = r").select("name_id", "place_id", "name", "place")


def _alike(pairs: DataFrame) -> DataFrame:
    """Matching blocks can't hold more than the letters both have, however they stand: pairs whose letters would do."""
    times = lambda c, letter: F.length(c) - F.length(F.replace(F.col(c), letter, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split("name", "")), F.lit(0), lambda n, x: n + F.least(times("name", x), times("place", x)))
    return pairs.filter(2 * shared >= LEAST * (F.length("name") + F.length("place")) - 1e-9)


def _step() -> Column:
    """All pieces of a name of ``m`` letters but the last are so long."""
    return F.greatest(F.lit(1), F.floor(F.col("m") / (F.floor(F.col("m") * SPARE + 1e-9) + 1))).cast("int")


def _by_pieces(left: DataFrame, right: DataFrame, levels: DataFrame) -> DataFrame:
    """Pairs with a common piece, of the lengths that leave many letters over."""
    many = levels.filter("not few")
    left = left.join(F.broadcast(many.select("m", "mk").distinct()), ["m", "mk"], "left_semi")
    right = right.join(F.broadcast(many.select("n", "nk", _step().alias("k")).distinct()), ["n", "nk"])
    cut = lambda c, at, n: F.substring(c, at, n)
    left = left.withColumn("step", _step())
    starts = F.sequence(F.lit(1), F.col("m") - F.col("step") + 1, F.col("step"))
    left = left.withColumn("piece", F.explode(F.array_distinct(F.transform(starts, lambda i: cut(F.col("name"), i, F.col("step"))))))
    right = right.filter("k <= n")
    right = right.withColumn("piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1), lambda i: cut(F.col("place"), i, F.col("k"))))))
    pairs = _alike(left.join(right, ["region", "piece"]).join(F.broadcast(many.select("m", "mk", "n", "nk")), ["m", "mk", "n", "nk"]))  # before they are moved
    return pairs.select("name_id", "place_id", "name", "place")


def fuzzy_match(names: DataFrame, places: DataFrame) -> DataFrame:
    """Of ``names`` (name_id, name, region) those that meet exactly one place of ``places`` (place_id, name, region): name_id,
    place_id, score. Met: same region, lengths at most 8 apart, and a matching-blocks ratio of 0.91 or more.

    Two lengths say how many letters the match of such a ratio holds at least, and it holds them in the same order in both names.
    So names of some 20 letters (45 where two are over) are left without each choice of the letters that may be over, and meet by
    what is left: pieces that all names share don't bring them together.

    Of longer names, or lengths far apart, the bound is by pieces. A ratio r of lengths m and n leaves (1 - r) * (m + n) letters
    out of the match, and n <= m * r' with r' = (2 - r) / r. So of a name cut into one piece more than that, one piece stands
    whole in the other name: pieces are joined with the other's substrings of the same length. Null names and regions meet nothing.

    A name that has met two places is out, whatever else it may meet. So pairs are made in rounds, and what a round has scored
    tells which names go on: a part of the rests, the other rests, then pieces.
    """
    left = names.filter("name <> '' AND region IS NOT NULL").select("name_id", "name", "region")
    right = places.filter("name <> '' AND region IS NOT NULL").select("place_id", F.col("name").alias("place"), "region")
    left, right = (stored(rows, "names") for rows in _kept(left, right))
    levels = stored(_levels(left, right), "lengths")
    rounds = [lambda rows, rests=rests: _by_letters(rows, right, levels, rests) for rests in ROUNDS]
    if not levels.filter("not few").isEmpty():
        rounds.append(lambda rows: _by_pieces(rows, right, levels))
    hits, going = None, left
    for k, made in enumerate(rounds):
        new = _alike(made(going).distinct()).withColumn("score", _ratio("name", "place")).filter(F.col("score") >= LEAST).select("name_id", "place_id", "score")
        new = stored(new, "names-met") if k + 1 < len(rounds) else new
        hits = new if hits is None else hits.unionByName(new)
        out = hits.groupBy("name_id").agg(F.min("place_id").alias("a"), F.max("place_id").alias("b")).filter("a < b")
        going = left.join(out.select("name_id"), "name_id", "left_anti")
    one = hits.groupBy("name_id").agg(F.min("place_id").alias("place_id"), F.max("place_id").alias("last"), F.max("score").alias("score"))
    return one.filter("place_id = last").drop("last")
