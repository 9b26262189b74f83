"""Index maintenance from a stream of documents and deletions.

Postings stand in a Parquet table of numbered versions. Every micro-batch of (doc_id, text, deleted) rows replaces the
postings of the documents that it names: old ones go by an anti-join, new ones are appended. A batch's version is written
whole and named by the batch, so that a repeated batch writes the same version again. Counts are aggregates of the
postings, hence nothing else is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscope.plans.relations import TOKEN

POSTINGS = "doc_id bigint, term string, tf bigint, positions array<int>"


def postings(docs: DataFrame) -> DataFrame:
    """Surface postings with positions."""
    tok = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("pos", "term"))
    return tok.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Postings after changes (doc_id, text, deleted); of several changes of a document the one of highest `seq` counts."""
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct("text", "deleted"), "seq").alias("c")).select("doc_id", "c.*")
    kept = current.join(last.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(postings(last.where("not deleted")))


def term_stats(table: DataFrame) -> DataFrame:
    return table.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version}"


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(version_path(root, version))


def maintain(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start the query; version 0 is empty, batch b reads version b and writes version b + 1."""
    spark = changes.sparkSession
    spark.createDataFrame([], POSTINGS).write.mode("ignore").parquet(version_path(root, 0))

    def batch(rows: DataFrame, number: int) -> None:
        apply_changes(read_version(spark, root, number), rows).write.mode("overwrite").parquet(version_path(root, number + 1))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
