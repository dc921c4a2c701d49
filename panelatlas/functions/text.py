"""Text, note and label expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "".join(map(chr, range(0x300, 0x370)))
COMBINING = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.combining(c))


def plain_letters(form: str = "NFD", marks: str = MARKS) -> tuple[str, str, dict[str, str]]:
    """Characters of Unicode that decompose to one ASCII letter or digit and marks, and what they decompose to; the marks
    themselves follow the first, as they have no counterpart and so go. Then the characters that decompose to more, such as
    ligatures and fractions, with their letters and digits."""
    gone = dict.fromkeys(map(ord, marks))
    bare = {c: unicodedata.normalize(form, c).translate(gone) for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.decomposition(c)}
    said = lambda d: any(x.isascii() and x.isalnum() for x in d)
    plain = {c: d for c, d in bare.items() if len(d) == 1 and said(d)}
    return "".join(plain) + marks, "".join(plain.values()), {c: d for c, d in bare.items() if len(d) > 1 and said(d)}


NFD, NFKD = plain_letters(), plain_letters("NFKD", COMBINING)


def _expanded(text: Column, more: dict[str, str]) -> Column:
    """Each character of ``more`` replaced; the table is one literal, as the expression may stand in many places."""
    pairs = F.split(F.lit("\x01".join(c + d for c, d in more.items())), "\x01")
    return F.when(text.rlike("[" + "".join(more) + "]"), F.aggregate(pairs, text, lambda t, x: F.replace(t, F.left(x, F.lit(1)), F.substring(x, 2, 1 << 20)))).otherwise(text) if more else text


# Note tokens that say nothing about quality.
ROUTINE_NOTES = ["turnout_from_clean", "counts_corrected_from_turnout", "party_rows_checked"]


def token(text: Column, table: tuple[str, str, dict[str, str]] = NFD) -> Column:
    """decomposed, without marks, lower case, everything but ASCII letters and digits a space, trimmed. ``table`` says how
    far: NFD, or NFKD for compatible forms as well."""
    letters, plain, more = table
    return F.trim(F.regexp_replace(F.lower(F.translate(_expanded(text, more), letters, plain)), "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def slug(text: Column, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def iso_date(text: Column) -> Column:
    """dd/mm/yyyy to a date; null where it is none."""
    return F.try_to_date(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), "d/M/y")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def base_name(text: Column) -> Column:
    """A municipality's name without a trailing section number."""
    return F.trim(F.regexp_replace(text, r"\s+\d+$", ""))


def notes(text: Column) -> Column:
    """distinct tokens of a pipe-separated note, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def join_notes(*texts: Column) -> Column:
    return F.array_join(F.array_distinct(F.concat(*[notes(t) for t in texts])), "|")


def has_meaningful_note(text: Column) -> Column:
    return F.exists(notes(text), lambda x: ~x.isin(ROUTINE_NOTES))


def is_complete(flag: Column, mode: str = "all") -> Column:
    """Completeness predicate; a mode that is not known passes everything."""
    t = F.coalesce(F.nullif(F.lower(F.trim(flag)), F.lit("")), F.lit("unknown"))
    return {
        "complete": t.contains("party_results_checked") | t.contains("complete") | (t == "ok"),
        "non_partial": ~t.contains("partial") & (t != "unknown"),
        "partial": t.contains("partial"),
        "unknown": t == "unknown",
    }.get(mode, F.lit(True))


def election_key(kind: Column, year: Column) -> Column:
    return F.concat_ws("_", F.lower(kind), year.cast("string"))


def electoral_system(year: Column) -> Column:
    return F.when(year <= 1992, "proportional").otherwise("mixed")


def last_label(labels: Column, stop: list[str]) -> Column:
    """P10: of labels that aren't stop words or blank: none if the last is a number, the last if it isn't the first, else the first."""
    kept = F.filter(labels, lambda x: ~F.lower(x).isin(*stop, ""))
    first, last = F.get(kept, F.lit(0)), F.try_element_at(kept, F.lit(-1))
    return F.when(last.rlike("^[0-9]+$"), F.lit(None)).when((F.size(kept) >= 2) & (last != first), last).otherwise(first)


def code_from_url(url: Column) -> Column:
    """of the parameters lev4, lev3, ne4 and ne3 the first that is neither missing nor 0, up to its first dash; else empty."""
    values = [F.nullif(F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), F.lit("0")), F.lit("")) for k in ("lev4", "lev3", "ne4", "ne3")]
    return F.coalesce(F.split_part(F.coalesce(*values), F.lit("-"), F.lit(1)), F.lit(""))


def canonical_url(url: Column) -> Column:
    """without the parameters that name the same page."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"([?&])unipro=uni(?=&|$)", "$1"), r"([?&])levsut0=\d+(?=&|$)", "$1")
    return F.replace(F.replace(F.regexp_replace(t, "[?&]+$", ""), F.lit("?&"), F.lit("?")), F.lit("&&"), F.lit("&"))


def historical_url(url: Column) -> Column:
    """a url whose parameters lev1 to ne4 hold tokens ``entity-levNvalue`` gets them as parameters neN and levN (with esN and
    levsutN where they are missing), tpe=C where lev3 says something, and its query sorted by name; the fragment goes.

    Of parameters of one name the last counts, blank ones stay; the parameters are asked in order, and later ones see what
    earlier ones set. Null counts as empty; what can't be decoded stays as it is."""
    url = F.coalesce(url, F.lit(""))
    head, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    read = lambda t: F.coalesce(F.try_url_decode(t), t)
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    given = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: pair(read(F.split_part(x, F.lit("="), F.lit(1))), read(F.regexp_extract(x, "(?s)^[^=]*=?(.*)$", 1))))
    last = F.filter(given, lambda x, i: ~F.exists(F.slice(given, i + 2, F.size(given)), lambda y: y["k"] == x["k"]))
    has = lambda held, k: F.exists(held, lambda x: x["k"] == k)
    value = lambda held, k: F.coalesce(F.get(F.filter(held, lambda x: x["k"] == k), F.lit(0))["v"], F.lit(""))
    put = lambda held, k, v: F.concat(F.filter(held, lambda x: x["k"] != k), F.array(pair(k, v)))
    default = lambda held, k, v: F.when(has(held, k), held).otherwise(F.concat(held, F.array(pair(k, v))))

    def step(held: Column, key: Column) -> Column:
        token = r"^(.+?)-lev(\d)(\d+)$"
        said = F.trim(value(held, key))
        part = lambda i: F.regexp_extract(said, token, i)
        name = lambda mark: F.concat(F.lit(mark), part(2))
        out = put(put(held, name("ne"), part(1)), name("lev"), part(3))
        return F.when(said.rlike(token), default(default(out, name("es"), F.lit("N")), name("levsut"), part(2))).otherwise(held)

    keys = F.array(*[F.lit(f"{mark}{level}") for level in "1234" for mark in ("lev", "ne")])
    write = lambda t: F.replace(F.replace(F.url_encode(t), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    done = F.aggregate(keys, last, step, lambda held: F.when(value(held, F.lit("lev3")).isin("", "0"), held).otherwise(put(held, F.lit("tpe"), F.lit("C"))))
    text = F.array_join(F.transform(F.array_sort(done), lambda x: F.concat(write(x["k"]), F.lit("="), write(x["v"]))), "&")
    scheme = F.regexp_extract(head, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    head = F.concat(F.lower(scheme), F.substring(head, F.length(scheme) + 1, F.length(head)))
    return F.concat(head, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def redacted_path(text: Column) -> Column:
    """a text that holds a local path becomes the last part of it."""
    parts = F.filter(F.split(text, r"[\\\\/]"), lambda x: x != "")
    said = F.when(F.lower(text).contains("python") & text.contains(" "), "[redacted-path-string]").otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("[redacted-path]")))
    return F.when(text.rlike(r"([A-Za-z]:\\|/mnt/|/Users/|/home/)"), said).otherwise(text)


def named_region(text: Column, regions: dict[str, str]) -> Column:
    """the region of the longest key that the normalised text is, begins with, or holds as words; else empty."""
    key, out = token(text), F.lit("")
    for name in sorted(regions, key=lambda x: (len(x), x)):  # the longest is asked first
        out = F.when(key.startswith(name) | F.concat(F.lit(" "), key, F.lit(" ")).contains(f" {name} "), regions[name]).otherwise(out)
    return out
