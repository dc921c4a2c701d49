"""URL filter: allow and block rules, and for urls without a rule a logistic regression on hashed character n-grams.

1. Host and path come from the url by one pattern; rules are compared by suffix of the host and prefix of the path, the longest
   first. Both are column expressions.
2. ``fit`` learns a logistic regression from a small labelled table of urls (``max_rows`` at most): binary features are the 3- to
   5-grams of bytes of host and path, each with its part and edges, hashed to ``2 ** bits``. The classes weigh the same and there
   is no intercept, so a url without any known n-gram scores 0.5; the threshold is above that.
3. ``judge`` scores whole urls in Arrow batches: the n-grams of a batch are hashed by rolling sums over its bytes and their
   weights are added up. The weights (2 MB at 18 bits, whatever the tables' sizes) go along with the task. Nothing is shuffled.

Null urls and urls without ``://`` have an empty host and path: no rule fits and the score is 0.5, so they are allowed. Very
long urls are read whole; urls that occur again get the same verdict, row by row. An empty table gives an empty result, an
empty or one-sided labelled table a model of zeros that allows everything. Null labels or urls in the labelled table are left
out. Other columns of ``pages`` are not read, whatever their names.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

LABELLED = Path(__file__).parent / "data" / "labelled_urls.csv"
SIZES = (3, 4, 5)
DIGITS = bytes.maketrans(b"123456789", b"000000000")


@dataclass(frozen=True)
class Rule:
    """Fits urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does. ``rules`` is a short list."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    told = [F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: -len(r.name))]
    return F.coalesce(*told, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _hashes(parts: Sequence[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all n-grams of ``parts``: the part's number and the hash. Parts are laid end to end; windows that would run over an
    end are left out."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    owner, left = np.repeat(np.arange(len(parts)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    owners, hashes = [], []
    for n in SIZES:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        whole = left[: len(h)] >= n
        owners.append(owner[: len(h)][whole])
        hashes.append((h >> np.uint64(64 - bits))[whole].astype(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *owners]), np.concatenate([none, *hashes])


def _features(host: pd.Series, path: pd.Series, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct n-gram of a row. 0x01 and 0x02 begin a host and a path, 0x03 ends either; a digit is as
    good as another."""
    mark = lambda x, at: [at + t.encode().translate(DIGITS) + b"\x03" if t else b"" for t in x]
    row, h = _hashes([*mark(host, b"\x01"), *mark(path, b"\x02")], bits)
    row = np.where(row >= len(host), row - len(host), row)
    once = np.unique(row << bits | h)
    return once >> bits, once & ((1 << bits) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bits: int

    def score(self, host: pd.Series, path: pd.Series) -> np.ndarray:
        """The chance of the label 1."""
        row, h = _features(host, path, self.bits)
        z = np.bincount(row, weights=self.weights[h], minlength=len(host))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def labelled_urls(spark: SparkSession, path: Path = LABELLED) -> DataFrame:
    """(url, label) of the packaged table: 1 for urls of gambling, pills, adult, spam, advert and tracking hosts."""
    with path.open(newline="") as f:
        return spark.createDataFrame([(r["url"], int(r["label"])) for r in csv.DictReader(f)], "url string, label int")


def fit(labelled: DataFrame, bits: int = 18, penalty: float = 0.002, rounds: int = 300, max_rows: int = 20_000) -> Model:
    """Learns from (url, label); label 1 is to be blocked. Of a table beyond ``max_rows`` rows, those with the smallest hashes of
    their url are taken. Both classes weigh the same in sum; steps are Nesterov's, of the inverse of the curvature's bound."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url is not null and label in (0, 1)").select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"), F.xxhash64("url").alias("h"))
    rows = rows.orderBy("h", "host", "path", "label").limit(max_rows).toPandas()
    y, model = rows["label"].to_numpy(), Model(np.zeros(1 << bits), bits)
    if len(set(y)) < 2:
        return model
    row, h = _features(rows["host"], rows["path"], bits)
    known, at = np.unique(h, return_inverse=True)
    weigh = 1 / np.where(y == 1, (y == 1).sum(), (y == 0).sum()) / 2
    step = 1 / (0.25 * (weigh * np.bincount(row, minlength=len(y))).sum() + penalty)  # the trace bounds the largest eigenvalue
    w = ahead = np.zeros(len(known))
    for k in range(rounds):
        z = np.bincount(row, weights=ahead[at], minlength=len(y))
        slope = np.bincount(at, weights=((1 / (1 + np.exp(-z)) - y) * weigh)[row], minlength=len(known)) + penalty * ahead
        before, w = w, ahead - step * slope
        ahead = w + k / (k + 3) * (w - before)
    model.weights[known] = w
    return model


def judge(pages: DataFrame, model: Model, rules: Iterable[Rule] = (), block_from: float = 0.55, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict and score (label 1 likelier the higher)."""

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.score(host, path))

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"by_rule": rule_of(F.col("host"), F.col("path"), rules), "score": score("host", "path")})
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("score") >= block_from, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
