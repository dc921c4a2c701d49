"""Place names: repair, lookup keys, title case, and what a page's text says of place and turnout."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NFKD, token

#: Fixed values of the sources' texts, from a data file.
FIXED = json.loads((Path(__file__).parents[1] / "data" / "names.json").read_text(encoding="utf-8"))
MOJIBAKE, TURNOUT_TEXT = FIXED["mojibake"], FIXED["turnout_text"]
#: Small words between spaces, and those that an apostrophe ends.
PARTICLES, ELIDED = [x for x in FIXED["particles"] if not x.endswith("'")], [x for x in FIXED["particles"] if x.endswith("'")]


def repaired(text: Column) -> Column:
    """mojibake of the fixed table mended; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for old, new in MOJIBAKE.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def lookup_key(text: Column, fixed: dict = FIXED) -> Column:
    """F16: the key that spellings of one name share. Compatible forms are decomposed (NFKD), marks go, and other letters
    beyond ASCII become spaces."""
    plain = F.regexp_replace(F.trim(repaired(text)), fixed["section_of_place"], "")
    sign, word = fixed["and_sign"]
    return token(F.translate(F.replace(plain, F.lit(sign), F.lit(word)), fixed["apostrophes"], " " * len(fixed["apostrophes"])), NFKD)


def lookup_keys(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """distinct keys to try, in order: the name's, those of its parts between slashes, its alias's; each also without
    spaces where that has five letters or more."""

    # A lambda's argument is worked out once, however often it is named, so no key is made again for each of its uses.
    once = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    compact = lambda key: F.replace(key, F.lit(" "), F.lit(""))
    both = lambda key: once(compact(key), lambda c: F.array_compact(F.array(F.nullif(key, F.lit("")), F.when(F.length(c) >= 5, c))))

    def keys(t: Column) -> Column:
        return once(lookup_key(t), both)

    parts = F.flatten(F.transform(F.split(repaired(text), "/"), keys))
    parts = F.when(F.contains(text, F.lit("/")), parts).otherwise(F.array().cast("array<string>"))
    if not aliases:
        return F.array_distinct(F.concat(keys(text), parts))
    # Names that have no alias, as nearly all, need none of its keys.
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    also = lambda key: F.when(key.isin(*aliases), keys(F.try_element_at(known, key))).otherwise(F.array().cast("array<string>"))
    return once(lookup_key(text), lambda key: F.array_distinct(F.concat(both(key), parts, also(key))))


def _titled(text: Column) -> Column:
    """A capital after every sign that is no letter, as words' starts."""
    apart = F.regexp_replace(F.lower(text), r"([^\p{L} ])", "$1\u0001 ")
    return F.replace(F.initcap(apart), F.lit("\u0001 "), F.lit(""))


def smart_title(text: Column) -> Column:
    """names in capitals alone get title case with small particles; others only lose spare white space."""
    t = F.regexp_replace(F.trim(repaired(text)), '^"+|"+$', "")
    out = _titled(t)
    for word in PARTICLES:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {word.lower()} "))
    for word in ELIDED:
        out = F.replace(out, F.lit(f" {word}"), F.lit(f" {word.lower()}"))
    rest = F.substring(out, 3, 1 << 20)
    out = F.when(out.rlike(FIXED["elided"]), F.concat(F.left(out, F.lit(2)), F.upper(F.left(rest, F.lit(1))), F.lower(F.substring(rest, 2, 1 << 20)))).otherwise(out)
    return F.trim(F.regexp_replace(F.when(t.rlike(r"\p{Ll}"), t).otherwise(out), r"\s+", " "))


def municipality_name(text: Column, fixed: dict = FIXED) -> Column:
    """what follows the word Comune, in title case; else empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return _titled(F.trim(F.regexp_extract(flat, fixed["place_after"], 1)))


def province_named(text: Column, municipality: Column, hints: dict[str, str] | None = None, known: dict[str, str] | None = None, fixed: dict = FIXED) -> Column:
    """the province after the word Provincia, else in brackets before Comune, else of the first pattern of ``hints``
    that is met, else of the municipality's key in ``known``; else empty."""
    t = F.coalesce(text, F.lit(""))
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), token(municipality)) if known else F.lit(None).cast("string")
    for pattern, province in reversed(list((hints or {}).items())):
        out = F.when(t.rlike("(?i)" + pattern), F.lit(province)).otherwise(out)
    tidy = lambda x: _titled(F.trim(F.regexp_replace(x, r"\s+", " ")))
    for pattern in fixed["province_patterns"]:  # the last is asked first
        out = F.when(t.rlike(pattern), tidy(F.regexp_extract(t, pattern, 1))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def turnout_figures(text: Column) -> list[Column]:
    """the figures as text, one column each; empty where the text has none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return [F.regexp_extract(flat, "(?i)" + pattern, 1).alias(name) for name, pattern in TURNOUT_TEXT.items()]


def row_kind(primary: Column, secondary: Column, tertiary: Column, votes: Column, stop: list[str], fixed: dict = FIXED) -> Column:
    """struct(kind, label) of a table's row: ``list_total``, ``party`` with its label, or ``skip``."""
    full = [F.coalesce(c, F.lit("")) for c in (primary, secondary, tertiary)]
    a, b = token(full[0]), token(full[1])
    label = F.coalesce(*[F.nullif(full[i], F.lit("")) for i in (1, 2, 0)])
    totals, people = fixed["total_labels"], fixed["candidate_labels"]
    total = (a.isin(totals) & b.isin(fixed["list_labels"])) & votes.isNotNull()
    never = b.isin(fixed["coalition_totals"]) | ((a == fixed["total_label"]) & b.isin(people)) | ((a != "") & (a == b))
    no_party = label.isNull() | votes.isNull() | (votes <= 0) | token(label).isin(*stop, *totals, *people)
    said = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("label"))
    return F.when(total, said("list_total", F.lit(None))).when(never | no_party, said("skip", F.lit(None))).otherwise(said("party", F.trim(label)))
