"""Small helpers shared by the operators: tables, the shared folder, text normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, a temporary folder is set once; on a cluster that is an error, as a
    folder of one machine would not be seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root is None:
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelatlas-shared-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/panelatlas/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, *, sort: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, since the files are in the shared store.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df = df.sortWithinPartitions(*sort) if sort else df
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    Text whose length in characters equals its length in bytes is ASCII, where ``lower`` changes A-Z alone.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


HEAVY_KEYS = 10_000


def heavy_from(rows: int) -> int:
    """A key that more rows than this have is heavy; of ``rows`` rows, at most HEAVY_KEYS keys can be."""
    return max(200, rows // HEAVY_KEYS)


def lookup(rows: DataFrame, index: DataFrame, on: list[str], limit: int, n: str = "n") -> DataFrame:
    """Inner join with an index of one row per key whose column ``n`` tells how many rows have the key.

    Keys of over ``limit`` rows, at most HEAVY_KEYS if ``limit`` is from ``heavy_from``, are joined by broadcast, so that
    their rows aren't sent to one task. ``index`` should hold little besides the key.
    """
    heavy = F.broadcast(index.filter(F.col(n) > limit))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(index.filter(F.col(n) <= limit), on)
    both = rows.join(heavy, on)
    return both.unionByName(rest)
