"""From raw documents to packed training sequences: five operators of corpuscope.llm, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import decontam, langid, near_dup, packing, toxicity

#: A prediction below this is as good as none among the learned languages.
LEAST_LANG_SCORE = 0.3
#: Documents are near duplicates at a Jaccard similarity of five-word shingles of 4/5 or more; bands of 5 miss one pair in 20,000 there.
SIMILAR = (80, 100)
BAND_ROWS = 5


#: What the operators call their columns: columns of the documents of such names are set aside while a stage works.
_TAKEN = ("score", "lang_pred", "n_words", "spans", "items")
_ASIDE = "_pipeline_"


def _aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({n: _ASIDE + n for n in _TAKEN if n in docs.columns})


def _kept(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{_ASIDE + n if n in _TAKEN else n}`").alias(n) for n in names])


# Stages keep null ids, repeated rows of one id but for near duplicates, and columns of any name; they return an empty
# table for an empty one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of score 0.5 or more; the grammar is learned from the labelled ones among docs. Null and empty texts stay."""
    rows = _aside(docs)
    learned = toxicity.learn(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(toxicity.score(rows, learned).where("score < 0.5"), docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter (null and empty ones) or fit no learned language; learned from docs themselves."""
    rows = _aside(docs)
    found = langid.identify(rows, langid.learn(rows))
    return _kept(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANG_SCORE)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id, its rows once (the smallest text, where they differ).

    Rows of null doc_id stay.
    """
    gone = near_dup.near_duplicates(docs, num=SIMILAR[0], den=SIMILAR[1], rows=BAND_ROWS).where("not kept").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    once = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{n}`") for n in docs.columns]), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return left.join(twice, "doc_id", "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns]).unionByName(once.select(*[F.col(f"`{n}`") for n in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which benchmark passages make a twentieth or more; shorter passages are cut out of the rest. Null texts stay."""
    found = decontam.find_spans(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = decontam.n_hit()
    clean = decontam.remove_spans(found.where((hits == 0) | (20 * hits < F.col("n_words"))))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _kept(clean, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its place in a training sequence; a null text is the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores, kernels and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written below the shared folder and read by the next."""
    from corpuscope.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
