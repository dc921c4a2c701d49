"""Files read in pieces, from tasks: members of archives by their central directory, digests, headers, counts of records.

A listing (path, length) is Spark's, which reads no content; a task opens a file of it by Arrow's file systems and reads what
it needs by ranges or as a stream, so files and archives of any size take a few megabytes of a task.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panel_store import stored

PIECE = 1 << 22
csv.field_size_limit(2**31 - 1)  # cells of any length


def listed(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """(path, length) of the files at or below ``path``, of the given endings; each file is a task's own where there are few. As
    everywhere in Spark, files of no bytes aren't listed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", "*.{" + ",".join(kinds) + "}") if kinds else reader
    return reader.load(path).select("path", "length").repartition(spark.sparkContext.defaultParallelism, "path")


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/*", "file:///", uri))
    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


def opened(uri: str):
    """A file to read from anywhere in it."""
    store, path = _at(uri)
    return store.open_input_file(path)


def relative(path: Column, root: str) -> Column:
    """A reader's whole location as what follows ``root``."""
    name = "/" + root.rstrip("/").split("://")[-1].removeprefix("file:").lstrip("/")
    whole = F.regexp_replace(path, "^[A-Za-z0-9]+:/*", "/")
    return F.when(F.startswith(whole, F.lit(name + "/")), F.substring(whole, len(name) + 2, 1 << 20)).otherwise(whole)


def put(files: DataFrame, root: str) -> DataFrame:
    """Write each row's ``content`` (binary) as the file ``path`` below ``root``, and return (path, size_bytes). A file is
    written under another name first, so a task that runs twice leaves one whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                store, path = _at(f"{root.rstrip('/')}/{name}")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, path)
            yield pd.DataFrame({"path": batch["path"], "size_bytes": batch["content"].map(len)})

    written = files.select("path", "content").mapInPandas(run, "path string, size_bytes long")
    return stored(written, "put")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names = []
        for path in batch["path"]:
            with opened(path) as f, zipfile.ZipFile(f) as archive:
                names.append(archive.namelist())
        yield pd.DataFrame({"path": batch["path"], "members": names})


def members(files: DataFrame) -> DataFrame:
    """(path, members) of zip archives; the central directory at an archive's end is all that is read."""
    return files.select("path").mapInPandas(_members, "path string, members array<string>")


def _encoding(archive: zipfile.ZipFile, member: str) -> str:
    """The first encoding that reads the whole member; it's read in pieces."""
    for name in ("utf-8-sig", "cp1252"):
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with archive.open(member) as f:
                while piece := f.read(PIECE):
                    decoder.decode(piece)
            decoder.decode(b"", final=True)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def _rows(columns: Sequence[str], sep: str, rows_at_once: int = 5000) -> Callable:
    names = ["path", "member", "row", *columns]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, member in zip(batch["path"], batch["member"], strict=True):
                with opened(path) as whole, zipfile.ZipFile(whole) as archive:
                    code = _encoding(archive, member)
                    with archive.open(member) as f:
                        lines = csv.reader(io.TextIOWrapper(f, code, newline=""), delimiter=sep)
                        head = [x.strip().strip('"') for x in next(lines, [])]
                        at = {c: head.index(c) for c in columns if c in head}
                        held: list[list] = []
                        for number, line in enumerate((x for x in lines if x), 1):
                            held.append([path, member, number, *[line[at[c]].strip().strip('"') if c in at and at[c] < len(line) else None for c in columns]])
                            if len(held) == rows_at_once:
                                yield pd.DataFrame(held, columns=names)
                                held = []
                        if held:
                            yield pd.DataFrame(held, columns=names)

    return read


def member_rows(chosen: DataFrame, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Rows of one member of each archive of ``chosen`` (path, member): path, member, row and ``columns`` as text, streamed out of
    the archive. A column the member lacks is null."""
    schema = ", ".join(["path string", "member string", "row long", *[f"`{c}` string" for c in columns]])
    return chosen.select("path", "member").mapInPandas(_rows(columns, sep), schema)


def _looked_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            digest, head = hashlib.sha256(), None
            with opened(path) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
                if path.lower().endswith(".csv"):
                    f.seek(0)
                    head = next(csv.reader(io.TextIOWrapper(f, "utf-8-sig", errors="replace", newline="")), [])
            out.append((path, digest.hexdigest(), head))
        yield pd.DataFrame(out, columns=["path", "sha256", "columns"])


def looked_at(files: DataFrame) -> DataFrame:
    """(path, sha256, columns): the digest of each file, and of a csv its first record, of any length."""
    return files.select("path").mapInPandas(_looked_at, "path string, sha256 string, columns array<string>")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for batch in batches:
        done = []
        for path, start, line in zip(batch["path"], batch["start"], batch["value"], strict=True):
            if (path, start) != key:
                done += [(*key, *state)] if key else []
                key, state = (path, start), [0, 0, 0]
            odd, said = line.count('"') % 2, bool(line.strip())
            inside = state[0]  # if the block began outside quotes
            state[0] ^= odd
            state[1] += state[0] == 0 and (said or inside == 1)
            state[2] += state[0] == 1 and (said or inside == 0)
        if done:
            yield pd.DataFrame(done, columns=["path", "start", "odd", "outside", "inside"])
    if key:
        yield pd.DataFrame([(*key, *state)], columns=["path", "start", "odd", "outside", "inside"])


def record_counts(spark: SparkSession, root: str) -> DataFrame:
    """(path, row_count) of the csv files below ``root``, their headers not counted, blank lines neither. Files are read by
    splits: each counts the records that end in it, once as if it began outside quotes and once inside; which holds follows
    from the quotes in the splits before."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    blocks = lines.mapInPandas(_blocks, "path string, start long, odd int, outside long, inside long")
    before = F.coalesce(F.sum("odd").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2  # a row a split
    ends = blocks.withColumn("n", F.when(before == 0, F.col("outside")).otherwise(F.col("inside")))
    return ends.groupBy("path").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("row_count"))
