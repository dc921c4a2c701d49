"""The panel as a stored table (S09, S03, U02): a row a cell, a partition an election, bucketed and sorted by place.

A cell holds its counts, its leaders and its parties as arrays, so that summary, results and own shares come from one scan. A
filter on elections prunes partitions, one on places prunes buckets, and what goes by place (windows, joins, aggregations)
needs no exchange, as a bucket's files are read together. Rows of an election replace those that are there (``put``).

The table lies in the folder that driver and executors share (``spark.checkpoint.dir``); a lost executor loses none of it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY, PLACE = "election_key", "municipality_id"
PART_BYTES = 4 << 20  # of the tables' files that a partition of a store is made from, so that its sorts stay in memory


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    root, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if root is None and held.isDefined():
        root = held.get()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelatlas-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written into the shared folder and read back, so that what is read again and again is made once."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of every file below the paths (one level), by the file system's own listing."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)]
    return tuple(out)


def parts_of(spark: SparkSession, files: tuple) -> int:
    """Partitions for a store made from ``files`` (of ``fingerprint``): they follow the files' size, so a task's share does
    not grow with it; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(size for _, size, _ in files) // PART_BYTES))


@contextmanager
def exchanging(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside exchanges ``n`` partitions, and adaptive execution puts none together beyond 1 MB."""
    for_now = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    before = {k: spark.conf.get(k) for k in for_now}
    try:
        for k, v in for_now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class PanelStore:
    """A stored panel by its table's name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def write(cls, cells: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None, dealt: bool = False) -> PanelStore:
        """Store ``cells``. A bucket of all elections is one task's, so no task writes a whole election. Cells that come
        ``dealt`` by place into as many partitions aren't moved again."""
        spark = cells.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = name or f"panel_{uuid.uuid4().hex}"
        rows = cells.select(*[c for c in cells.columns if c != KEY], KEY)
        rows = rows if dealt else rows.repartition(n, PLACE)
        rows.write.partitionBy(KEY).bucketBy(n, PLACE).sortBy(PLACE).option("path", path or shared_folder(spark, "panel")).saveAsTable(name)
        return cls(spark, name)

    def cells(self) -> DataFrame:
        return self.spark.table(self.name)

    def elections(self, *keys: str) -> DataFrame:
        """The cells of some elections; other partitions aren't read."""
        return self.cells().filter(self.cells()[KEY].isin(*keys))

    def put(self, cells: DataFrame) -> None:
        """Replace the elections that ``cells`` has; others stay. Repeating it changes nothing, so it may run again."""
        held = self.cells()
        n = int(self.spark.sql(f"DESCRIBE FORMATTED {self.name}").filter("col_name = 'Num Buckets'").first()["data_type"])
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            cells.select(*held.columns).repartition(n, PLACE).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
