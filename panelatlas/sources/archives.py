"""Raw deliveries: folders of files, zip archives of separated text, pages with tables, topologies."""

from __future__ import annotations

import csv
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranged import listed, member_rows, members, relative

# File name parts of members that hold no party results.
OTHER_MEMBERS = ["preferenze", "candidati", "estero", "vaosta"]


@dataclass(frozen=True)
class MemberRule:
    """Fits members whose name holds all ``parts``, in archives of ``year`` and ``kind`` where these are given."""

    year: int | None
    kind: str
    parts: tuple[str, ...]


def read_member_rules(path: Path = Path(__file__).parents[1] / "data" / "member_rules.csv") -> list[MemberRule]:
    """The rules of a data file (its values are fixed), the first that fits any member counts."""
    with path.open(newline="") as f:
        return [MemberRule(int(r["year"]) if r["year"] else None, r["kind"], tuple(r["parts"].split("|"))) for r in csv.DictReader(f)]


MEMBER_RULES = read_member_rules()
#: Folders (clean, raw) of an election, the first that is there counts. {} is the election's key.
LAYOUTS = [("{}/validated/clean/", "{}/validated/raw/"), ("{}/existing/clean/", "{}/existing/raw/"), ("{}/raw_option_urls/clean/", "{}/raw_option_urls/raw/"), ("{}_clean/", "{}_raw/")]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes) of every file below ``root``, paths relative to it; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size_bytes"))


def resolve(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per ``wanted.name`` the file with that path as its end, whole parts only; of several the first by path. Names
    that no file has give a null path."""
    parts = F.split("path", "/")
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("name"))
    tidy = F.regexp_replace(F.replace(F.col("name"), F.lit("\\"), F.lit("/")), "^(\\./|/)+", "")
    asked = wanted.select("name", tidy.alias("end")).distinct()
    return asked.join(ends.withColumnRenamed("name", "end"), "end", "left").groupBy("name").agg(F.min("path").alias("path"))


def elections(files: DataFrame) -> DataFrame:
    """(election_key, election_year, clean, raw_entities) from a listing's folders ``camera_YYYY``: the first of
    the known layouts that has files, and its entities file where there is one; both null where no layout is there."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    key = F.regexp_replace(top, "_(clean|raw)$", "")
    rows = files.select("path", top.alias("top"), key.alias("election_key")).filter(F.col("election_key").rlike(r"^camera_\d{4}"))
    place = lambda pattern: F.regexp_replace(F.lit(pattern), r"\{\}", F.col("election_key"))
    seen = []
    for i, (clean, raw) in enumerate(LAYOUTS):
        seen += [F.max(F.startswith("path", place(clean))).alias(f"clean{i}"), F.max(F.col("path") == F.concat(place(raw), F.lit("entities.csv"))).alias(f"raw{i}")]
    found = rows.groupBy("election_key").agg(F.max(F.col("top") == F.col("election_key")).alias("own"), *seen).filter("own")
    clean, entities = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (c, r) in reversed(list(enumerate(LAYOUTS))):
        entities = F.when(F.col(f"clean{i}"), F.when(F.col(f"raw{i}"), F.concat(place(r), F.lit("entities.csv")))).otherwise(entities)
        clean = F.when(F.col(f"clean{i}"), place(c)).otherwise(clean)
    return found.select("election_key", F.regexp_extract("election_key", r"(\d{4})", 1).cast("int").alias("election_year"), clean.alias("clean"), entities.alias("raw_entities"))


def consultations(page: Column) -> Column:
    """Array of struct(election_type, year, relative_path, filename, election_date) that a page's script lists; of one
    file name the first."""
    pattern = r'(?i)\[\s*"(camera|assemblea_costituente)",\s*"(\d{4})",\s*"([^"]+)",\s*"([^"]+\.zip)",\s*"([^"]+)"'
    at = [F.regexp_extract_all(page, F.lit(pattern), F.lit(i)) for i in range(1, 6)]
    rows = F.arrays_zip(*[a.alias(n) for a, n in zip(at, ("election_type", "year", "relative_path", "filename", "election_date"), strict=True)])
    names = at[3]
    firsts = F.filter(rows, lambda r, i: F.array_position(names, r["filename"]) == i + 1)
    return F.transform(firsts, lambda r: F.struct(F.lower(r["election_type"]).alias("election_type"), r["year"].cast("int").alias("year"), r["relative_path"].alias("relative_path"), r["filename"].alias("filename"), r["election_date"].alias("election_date")))


def primary_member(members: Column, year: Column, kind: Column, rules: Sequence[MemberRule] = MEMBER_RULES) -> Column:
    """The member of an archive that holds the party results: of the tables the first that the first fitting rule names,
    else the first; null if none is a table."""
    has = lambda m, parts: reduce(operator.and_, [F.contains(F.lower(m), F.lit(t)) for t in parts])
    useful = lambda m: reduce(operator.and_, [~F.contains(F.lower(m), F.lit(t)) for t in OTHER_MEMBERS], F.lower(m).rlike(r"\.(txt|csv)$"))
    tables, kind = F.filter(members, useful), F.lower(F.trim(F.coalesce(kind, F.lit("camera"))))

    def named(rule: MemberRule) -> Column:
        asked = ([year == rule.year] if rule.year else []) + ([kind == rule.kind] if rule.kind else [])
        return F.when(reduce(operator.and_, asked, F.lit(True)), F.get(F.filter(tables, lambda m: has(m, rule.parts)), F.lit(0)))

    return F.coalesce(*[named(r) for r in rules], F.get(tables, F.lit(0)))


def zip_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per zip file its members, how many there are, and those that end in csv and xlsx."""
    found = members(listed(spark, path))
    ending = lambda e: F.filter("members", lambda m: F.lower(m).endswith(e))
    return found.select("path", F.size("members").alias("entry_count"), "members", ending(".csv").alias("csv_members"), ending(".xlsx").alias("xlsx_members"))


def zip_rows(spark: SparkSession, path: str, entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each archive's primary member, only ``columns`` kept, as text. ``entries`` has filename, year and
    election_type. Archives and members may be of any size."""
    known = zip_inventory(spark, path).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    chosen = known.join(entries, "filename").select("path", primary_member(F.col("members"), F.col("year"), F.col("election_type")).alias("member")).filter("member IS NOT NULL")
    return member_rows(chosen, columns)


class _Tables(HTMLParser):
    """Rows of cells of each table, nested tables after the one around them."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[tuple[bool, str]]]] = []
        self.open: list[list] = []  # per open table: its rows, the open cell's pieces or None, is it a header, its span
        self.title, self.in_title = "", False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag == "table":
            rows: list = []
            self.tables.append(rows)
            self.open.append([rows, None, False, 1])
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1][0].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            span = dict(attrs).get("colspan") or "1"
            self.open[-1][1:] = [[], tag == "th", int(span) if span.isdigit() else 1]

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif self.open and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                self.open.pop()

    def _close_cell(self):
        rows, pieces, header, span = self.open[-1]
        if pieces is not None:
            if not rows:
                rows.append([])
            rows[-1] += [(header, " ".join("".join(pieces).split()))] * max(span, 1)
            self.open[-1][1] = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        for table in self.open[-1:]:
            if table[1] is not None:
                table[1].append(data)


_CELLS = "url string, html_file string, title string, table_idx int, rownum int, column_name string, cell_value string"


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for url, file, html in zip(batch["url"], batch["html_file"], batch["html"], strict=True):
            reader = _Tables()
            reader.feed(html or "")
            reader.close()
            for i, table in enumerate([t for t in reader.tables if any(t)]):
                table = [r for r in table if r]
                named = all(header for header, _ in table[0])
                width = max(map(len, table))
                names = [x for _, x in table[0]] if named else []
                names += [str(k) for k in range(len(names), width)]
                for n, row in enumerate(table[1:] if named else table):
                    out += [(url, file, reader.title.strip(), i, n, name, row[k][1] if k < len(row) else None) for k, name in enumerate(names)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _CELLS.split(", ")]).astype({"table_idx": "int32", "rownum": "int32"})


def table_cells(pages: DataFrame) -> DataFrame:
    """Every cell of every table of ``pages`` (url, html_file, html), long form. A first row of header cells alone names
    the columns, else their numbers do; short rows end in nulls; pages without a table give no row."""
    return pages.select("url", "html_file", "html").mapInPandas(_cells, _CELLS)


def archive_urls(rows: DataFrame, fixed: Column, order: str) -> DataFrame:
    """Rows whose url is of a third or fourth level, and of one rewritten url (``fixed``) the first by ``order``."""
    kept = rows.filter(F.contains("url", F.lit("-lev3")) | F.contains("url", F.lit("-lev4"))).withColumn("fixed_url", fixed)
    first = F.row_number().over(Window.partitionBy("fixed_url").orderBy(order, "url"))
    return kept.withColumn("__first", first).filter("__first = 1").drop("__first")


def topology_rings(arcs: DataFrame, shapes: DataFrame, scale: tuple[float, float] = (1.0, 1.0), translate: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``shapes`` (id, ring, arcs: array of arc numbers, ~n for arc n backwards) with their points, from ``arcs`` (arc,
    points: array of struct(x, y), each after the first as steps from the one before). Of joined arcs the point they share
    is taken once; arcs that are missing give no points."""

    def walk(axis: str, by: float, start: float):
        steps = F.transform("points", lambda p: p[axis].cast("double"))
        sums = F.aggregate(steps, F.array().cast("array<double>"), lambda done, s: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + s)))
        return F.transform(sums, lambda v: v * by + start)

    paths = arcs.withColumns({"xs": walk("x", scale[0], translate[0]), "ys": walk("y", scale[1], translate[1])}).select("arc", F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).alias("path"))
    uses = shapes.select("id", "ring", F.posexplode("arcs").alias("at", "use")).withColumn("arc", F.when(F.col("use") < 0, -F.col("use") - 1).otherwise(F.col("use")))
    turned = uses.join(paths, "arc").withColumn("path", F.when(F.col("use") < 0, F.reverse("path")).otherwise(F.col("path")))
    part = F.when(F.col("at") > 0, F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path"))
    parts = turned.groupBy("id", "ring").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("path")))).alias("parts"))  # a ring's arcs
    return parts.select("id", "ring", F.flatten(F.transform("parts", lambda p: p["path"])).alias("points"))
