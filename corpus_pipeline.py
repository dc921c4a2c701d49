"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Between
two stages the rows are written as Parquet and read again.

1. toxicity: documents that score 0.5 or more go; the model learns from the labelled documents among the stage's input.
2. exact dedup: of texts equal but for the case of A-Z, the row with the largest doc_id stays.
3. SimHash near-dedup: sets of shingles of five words with a Jaccard similarity of 0.8 or more are linked. Bands of several
   independent fingerprints give the shards, each shard's BK-tree the candidates, and each is checked exactly. Of each group the smallest doc_id stays.
4. mixing: the rows are put in the order of the mixture; each file holds a stretch of the schedule.
5. packing: rows are packed slot by slot of the mixture into sequences of at most 4096 ids, so that sequence_id follows the
   schedule. As readers pack files in any order, the stage works out the slots again, from the same rows.

Null and empty texts go through all stages (stage 2 leaves one of them); rows with a null doc_id are kept by stages 1, 3
and 4 and count as one document's copies in stage 2 where their texts are equal. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelatlas.llm.common import materialise, table
from panelatlas.llm.exact_dedup import drop_exact_copies
from panelatlas.llm.mixing import in_mixed_order, placed
from panelatlas.llm.packing import pack
from panelatlas.llm.queries import BLOCK_ROWS, SHARES
from panelatlas.llm.similar import similar_components
from panelatlas.llm.tokens import default_vocabulary
from panelatlas.llm.toxicity import drop_toxic, fit, sample


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit(*sample(docs, table(spark, sf_dir, "labels"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs, keep="max")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = similar_components(docs, words=5, jaccard=0.8)
    gone = classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs, SHARES, block_rows=BLOCK_ROWS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, slot, place = placed(docs, SHARES, block_rows=BLOCK_ROWS)
    return pack(rows, default_vocabulary(), end_id=2, slot_col=slot, place_col=place)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_near_dedup), ("mixing", mixing), ("packing", packing)]

#: Scores, fingerprints and token ids are beyond SQL; tests hold exact and near-dedup against brute force, and packing's order
#: against the schedule; toxicity's scores are not held against one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
