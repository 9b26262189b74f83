"""Query sets and manual judgements: JSON lines of queries with their grades, loaded as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANUAL = "qid string, doc_id bigint, grade int"


def save(queries: DataFrame, manual: DataFrame, path: str) -> None:
    """Queries (qid, text and what else there is) in one JSON line each, with their manual grades by document."""
    grades = manual.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc_id", "grade"))).alias("manual"))
    queries.join(grades, "qid", "left").write.json(path)


def load(spark: SparkSession, path: str, columns: str = "qid string, text string") -> tuple[DataFrame, DataFrame]:
    """Queries and manual grades (qid, doc_id, grade) that save wrote."""
    rows = spark.read.schema(f"{columns}, manual array<struct<doc_id:bigint,grade:int>>").json(path)
    manual = rows.select("qid", F.explode("manual").alias("m")).select("qid", "m.doc_id", "m.grade")
    return rows.drop("manual"), manual


def set_grades(manual: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual grades after changes, which win; grades are held between 0 and 2, a null one takes a judgement back."""
    kept = manual.join(changes.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    new = changes.where("grade is not null").withColumn("grade", F.greatest(F.lit(0), F.least(F.lit(2), "grade")))
    return kept.unionByName(new)
