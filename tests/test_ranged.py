"""Files in pieces: archives and files beyond 2 GB (sparse, so they take no disk), digests, headers and counts of records."""

import csv
import hashlib
import random
import zipfile

from panelatlas.sources import archives as A
from panelatlas.sources import catalog as K
from panelatlas.sources import ranged


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.zip", "w+b") as f:
        f.truncate(2_200_000_000)  # what stands before an archive is not read
        f.seek(0, 2)
        with zipfile.ZipFile(f, "a") as z:
            z.writestr("preferenze.csv", "no;no\n")
            z.writestr("camera-1.txt", "A;B\n1;€\n\n2;y\n".encode("cp1252"))
    (stock,) = A.zip_inventory(spark, str(tmp_path / "big.zip")).collect()
    assert stock.members == ["preferenze.csv", "camera-1.txt"]
    entries = spark.createDataFrame([("big.zip", 1963, None)], "filename string, year int, election_type string")
    rows = A.zip_rows(spark, str(tmp_path / "big.zip"), entries, ["B", "C"]).orderBy("row").collect()
    assert [(r.row, r.B, r.C) for r in rows] == [(1, "€", None), (2, "y", None)]


def test_digest_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(2_200_000_000)
    want = hashlib.sha256()
    for _ in range(2_200):
        want.update(bytes(1_000_000))
    assert ranged.looked_at(ranged.listed(spark, str(tmp_path / "big.bin"))).select("sha256").first()[0] == want.hexdigest()


def test_records_by_splits(spark, tmp_path):
    rnd, want = random.Random(3), {}
    for k in range(4):
        rows = [[rnd.choice(["a", "b\nc", 'q"q', "", "x,y", "\n\n", "long " * 40]) for _ in range(3)] for _ in range(rnd.choice([0, 1, 300]))]
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["h" * 70_000 if k == 1 else "h", "i\nj", "k"])
            w.writerows(rows)
            f.write("\n" * (k % 2))
        want[f"f{k}.csv"] = len(rows)
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "d.json").write_text('{"entries": [1, 2, 3]}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.path.rsplit("/", 1)[1]: r.row_count for r in ranged.record_counts(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: got.get(k, 0) for k in want} == want
    seen = {r.path.rsplit("/", 1)[1]: r for r in K.file_summaries(spark, str(tmp_path)).collect()}
    assert {k: seen[k].row_count for k in want} == want and seen["f1.csv"].columns == ["h" * 70_000, "i\nj", "k"]
    assert "none.csv" not in seen and tuple(seen["d.json"].counts) == ("entry_count", 3)
    assert seen["f0.csv"].sha256 == hashlib.sha256((tmp_path / "f0.csv").read_bytes()).hexdigest()
