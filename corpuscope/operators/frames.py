"""Queries that SQL cannot express: sentences, snippets, spelling, fuzzy search, projections, training, index streams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions.distance import alignment, default_distance, distance_within, table
from corpuscope.functions.sentences import sentences, split_sentences
from corpuscope.functions.stopwords import STOP_WORDS
from corpuscope.operators import composed, models, statistics
from corpuscope.operators.embedding import relations as embedding_relations
from corpuscope.operators.query_language import search_sql
from corpuscope.plans.dialect import DUCK, SPARK
from corpuscope.plans.relations import TOKEN, VECTOR_WORD, duck, made, open_index, spark_sql
from corpuscope.sources import query_sets
from corpuscope.sources.documents import identifiers
from corpuscope.streaming import index_stream

#: A fuzzy word stands for so many dictionary words at most, the closest first.
FUZZY_LIMIT = 30


def _docs(spark: SparkSession, sf_dir: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if only is not None:  # the few documents of a page
        rows = rows.join(F.broadcast(only.select("doc_id")), "doc_id", "left_semi")
    return rows.select("doc_id", *columns)


def sentence_rows(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Sentences of every line of every text (or of the documents of `only`), numbered in the document."""
    lines = _docs(spark, sf_dir, F.posexplode(F.split("text", "\n")).alias("line", "t"), only=only)
    rows = lines.select("doc_id", "line", F.posexplode(sentences("t")).alias("k", "sentence"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "k"))).select("doc_id", "n", "sentence")


def sentence_hits(spark: SparkSession, sf_dir: str, query: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, hits, distinct): words of a sentence whose stem the query asks for, and how many stems they have."""
    wanted = spark_sql(spark, sf_dir, f"SELECT word AS surface, stem FROM stem_dim WHERE stem IN ({composed.positive_stems_sql(SPARK, query)})")
    tokens = sentence_rows(spark, sf_dir, only).select("doc_id", "n", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(TOKEN), F.lit(0))).alias("surface"))
    return tokens.join(wanted, "surface").groupBy("doc_id", "n").agg(F.count("*").alias("hits"), F.count_distinct("stem").alias("distinct"))


def snippets(spark: SparkSession, sf_dir: str, query: str = "nd ing", only: DataFrame | None = None) -> DataFrame:
    """The two best sentences of every document for a query: by distinct stems, hits, then place."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.col("distinct") * 1000 + F.col("hits")), "n")
    best = sentence_hits(spark, sf_dir, query, only).withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    return best.join(sentence_rows(spark, sf_dir, only), ["doc_id", "n"]).select("doc_id", "rank", "n", "sentence", "hits")


def document_view(spark: SparkSession, sf_dir: str, query: str = "nd ing") -> DataFrame:
    """Numbered sentences of every document with their unit (title, abstract, body) and the query's hits in each."""
    field = F.when(F.col("line") == 0, "title").when(F.col("line") == 1, "abstract").otherwise("body")
    lines = _docs(spark, sf_dir, F.posexplode(F.split("text", "\n")).alias("line", "t"))
    rows = lines.select("doc_id", "line", F.posexplode(sentences("t")).alias("k", "sentence"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "k")))
    hits = sentence_hits(spark, sf_dir, query).select("doc_id", "n", "hits")
    return rows.join(hits, ["doc_id", "n"], "left").select("doc_id", "n", field.alias("field"), "sentence", F.coalesce("hits", F.lit(0)).alias("hits"))


def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in a sentence made for every document: two that are named, one of them twice, and one in an address."""
    made_up = F.concat(F.lit("see PMC00"), F.col("doc_id") + 1, F.lit(", PMID: "), F.col("n_chars") + 1000, F.lit(" and pmc "), F.col("doc_id") + 1, F.lit("; https://pubmed.ncbi.nlm.nih.gov/0"), F.col("n_chars") + 5_000_000)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(identifiers(made_up)).alias("n", "i"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n"), "i.kind", "i.number")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, statistics._surface(SPARK))


def words_within(words: DataFrame, asked: str, k: int | None = None) -> DataFrame:
    """(word, distance, cf) of dictionary words within k edits: length and plain distance filter first, in the JVM."""
    asked = asked.lower()
    k = default_distance(asked) if k is None else k
    near = words.where((F.abs(F.length("word") - len(asked)) <= k) & (F.levenshtein("word", F.lit(asked)) <= 2 * k))
    return near.withColumn("distance", distance_within("word", F.lit(asked), k)).where("distance is not null")


def osa_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_within(dictionary(spark, sf_dir), "tinoable", 2)


def fuzzy_words(spark: SparkSession, sf_dir: str):
    """What a fuzzy word of the query language stands for."""

    def expand(word: str, k: int) -> list[str]:
        near = words_within(dictionary(spark, sf_dir), word, k or None)
        return [r["word"] for r in near.orderBy("distance", F.desc("cf"), "word").limit(FUZZY_LIMIT).collect()]

    return expand


def search(spark: SparkSession, sf_dir: str, query: str, method: str = "bm25", default: str = "AND", scope: str = "all", limit: int | None = None) -> DataFrame:
    """Ranked documents of any query of the language, the first `limit` or all."""
    return spark_sql(spark, sf_dir, search_sql(SPARK, query, method, default, scope, fuzzy_words(spark, sf_dir), limit))


def corrections(spark: SparkSession, sf_dir: str, query: str, n: int = 5) -> dict[str, list[str]]:
    """The query's words that the collection lacks, each with its n nearest dictionary words."""
    words = dictionary(spark, sf_dir)
    plain = [w.lower() for _, w, role in composed.analyse(re.sub(r"\w+[*~]\d?", " ", query)) if role == "term"]
    asked = list(dict.fromkeys(w for w in plain if len(w) > 2 and not w.isdigit()))
    known = {r["word"] for r in words.where(F.col("word").isin(asked)).collect()} if asked else set()
    order = lambda rows: rows.orderBy("distance", F.desc("cf"), "word").limit(n).collect()
    return {w: [r["word"] for r in order(words_within(words, w).where(F.col("word") != w))] for w in asked if w not in known}


def engine_search(spark: SparkSession, sf_dir: str, query: str, method: str = "bm25", default: str = "AND", limit: int = 10, autocorrect: bool = True) -> tuple[DataFrame, dict]:
    """The page of a search with snippets, and how the query was read: its words' roles, corrections, whether they were used.

    A query that matches nothing is run again with each unknown word replaced by its best correction, if any.
    """
    found = corrections(spark, sf_dir, query)
    fixed = query
    for w, near in found.items():
        if near:
            fixed = re.sub(rf"(?<!\w){re.escape(w)}(?![\w*~])", near[0], fixed, flags=re.I)

    def page(q: str) -> DataFrame:
        """At most `limit` rows, found once: they are asked whether there are any, and for their snippets."""
        path = made(spark, "page")
        spark_sql(spark, sf_dir, composed.engine_sql(SPARK, q, method, default, limit, fuzzy_words(spark, sf_dir))).write.parquet(path)
        return spark.read.parquet(path)

    out, used = page(query), query
    if autocorrect and fixed != query and not out.limit(1).count():
        again = page(fixed)
        if again.limit(1).count():
            out, used = again, fixed
    best = snippets(spark, sf_dir, used, out).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("s"))
    shown = out.join(best.select("doc_id", F.array_join("s.sentence", " … ").alias("snippet")), "doc_id", "left")
    return shown, {"query": used, "words": composed.analyse(used), "corrections": found, "corrected": used != query}


def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a misspelt query that is run again as corrected."""
    return engine_search(spark, sf_dir, "hendntx thanedblq", default="OR")[0]


def spell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five corrections for each word of three queries that is neither known nor short nor a number."""
    words = dictionary(spark, sf_dir)
    asked = [w for w in "tioon hereof thandx".split() if len(w) > 2 and not w.isdigit() and w not in STOP_WORDS]
    known = {r["word"] for r in words.where(F.col("word").isin(asked)).collect()}
    rows = [words_within(words, w).where(F.col("word") != w).orderBy("distance", F.desc("cf"), "word").limit(5).select(F.lit(w).alias("asked"), "word", "distance", "cf") for w in asked if w not in known]
    out = rows[0] if rows else words.select(F.lit("").alias("asked"), "word", F.lit(0).cast("bigint").alias("distance"), "cf").where("1 = 0")
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def edit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and alignment of the first two words of every benchmark text."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["item_id"], pdf["text"], strict=True):
                a, b = (t.lower().split(" ") + ["", ""])[:2]
                out += [(i, a, b, x, y, c, None) for x, row in enumerate(table(a, b)) for y, c in enumerate(row)]
                out += [(i, a, b, n, None, None, f"{op} {p}>{q}") for n, (op, p, q) in enumerate(alignment(a, b))]
            yield pd.DataFrame(out, columns=["item_id", "a", "b", "i", "j", "cost", "op"]).astype({"j": "Int64", "cost": "Int64"})

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return items.mapInPandas(run, "item_id bigint, a string, b string, i bigint, j bigint, cost bigint, op string")


def _top_vectors(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT word, rank, vec, 1 AS one FROM model WHERE rank <= {n}", embedding_relations(SPARK))


def _plane(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = np.array(pdf["vec"].tolist())
        y, share = models.pca2(x)
        if kind == "tsne":
            y, share = models.tsne(x), (0.0, 0.0)
        return pd.DataFrame({"word": pdf["word"], "x": y[:, 0], "y": y[:, 1], "explained": float(share[0] + share[1])})

    return run


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane of the 400 most frequent words: a display of so many points, one group."""
    return _top_vectors(spark, sf_dir, 400).groupBy("one").applyInPandas(_plane("pca"), "word string, x double, y double, explained double")


def tsne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_vectors(spark, sf_dir, 200).groupBy("one").applyInPandas(_plane("tsne"), "word string, x double, y double, explained double")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram and CBOW over the sentences of the documents, side by side."""
    return models.train_corpus(training_sentences(_docs(spark, sf_dir, "text")), lambda name: made(spark, name), dim=20, epochs=3, least=2)


def training_sentences(docs: DataFrame) -> DataFrame:
    """(model, words): every sentence of every line once a model, without stop words and single letters; repeated words stay."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(split_sentences)

    lines = docs.select(F.explode(F.split("text", "\n")).alias("t"))
    items = lines.select(F.explode(F.pandas_udf(run, "array<string>")("t")).alias("s"))
    words = F.transform(F.regexp_extract_all("s", F.lit(VECTOR_WORD), F.lit(0)), F.lower)
    rows = items.select(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(STOP_WORDS))).alias("words")).where(F.size("words") > 1)
    return rows.select(F.explode(F.array(F.lit("sg-d20"), F.lit("cbow-d20"))).alias("model"), "words")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics of an index that a stream of documents maintains: every document, then deletion of every tenth."""
    base = made(spark, "stream")
    docs = _docs(spark, sf_dir, "text", F.lit(False).alias("deleted"), F.lit(0).alias("seq"))
    gone = docs.where("doc_id % 10 = 0").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"), F.lit(1).alias("seq"))
    docs.unionByName(gone).write.parquet(f"{base}/in")
    changes = spark.readStream.schema("doc_id bigint, text string, deleted boolean, seq int").parquet(f"{base}/in")
    query = index_stream.maintain(changes, f"{base}/index", f"{base}/checkpoint")
    query.awaitTermination()
    return index_stream.term_stats(index_stream.read_version(spark, f"{base}/index", query.lastProgress["batchId"] + 1))


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word vectors, saved and loaded again: word, count, rank and the first component to five places."""
    path = made(spark, "model")
    rows = spark_sql(spark, sf_dir, "SELECT word, cf, rank, vec FROM model", embedding_relations(SPARK))
    models.save_model(rows, path, {"dim": 64, "model": "given"})
    loaded, params = models.load_model(spark, path)
    if params != {"dim": 64, "model": "given"}:
        raise ValueError("parameters of the model were not kept")
    return loaded.select("word", "cf", "rank", F.element_at("vec", 1).alias("x"), F.size("vec").cast("bigint").alias("dim"))


def query_set_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as a query set with manual grades: saved, two grades set, one taken back, loaded again."""
    path = made(spark, "queries")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), F.lower("text").alias("text"))
    query_sets.save(items, spark.createDataFrame([], query_sets.MANUAL), f"{path}/a")
    queries, manual = query_sets.load(spark, f"{path}/a")
    manual = query_sets.set_grades(manual, spark.createDataFrame([("1", 5, 7), ("1", 6, 1), ("2", 5, 1)], query_sets.MANUAL))
    manual = query_sets.set_grades(manual, spark.createDataFrame([("1", 6, None)], query_sets.MANUAL))
    query_sets.save(queries, manual, f"{path}/b")
    queries, manual = query_sets.load(spark, f"{path}/b")
    return queries.join(manual, "qid", "left").select("qid", F.length("text").cast("bigint").alias("size"), "doc_id", "grade")


FUZZY = "hendn~1 OR thaneble~1"

FRAMES = {
    "t7_sentences": sentence_rows,
    "r9_snippets": snippets,
    "r10_document_view": document_view,
    "s11_parse_ids": text_ids,
    "r22_osa_within": osa_within,
    "q8_fuzzy": lambda spark, sf_dir: search(spark, sf_dir, FUZZY),
    "r7_did_you_mean": did_you_mean,
    "s15_model_round_trip": model_round_trip,
    "s16_query_set": query_set_round_trip,
    "q15_spellcheck": spell_check,
    "t16_edit_matrix": edit_matrix,
    "r23_pca": pca,
    "r24_tsne": tsne,
    "r28_sgns": train,
    "stream_index": stream,
}


def _duck_near(word: str, k: int, more: str = "") -> str:
    """Dictionary words by distance with transpositions: at one edit the restricted distance is the same."""
    low, up = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ()[]{}<"
    distance = f"damerau_levenshtein(translate(word, '{low}', '{up}'), '{word}')"
    return f"SELECT word, CAST({distance} AS BIGINT) AS distance, cf FROM ({statistics._surface(DUCK)}) AS s WHERE {distance} <= {k} {more}"


def _duck_fuzzy(word: str, k: int) -> str:
    return f"SELECT word FROM ({_duck_near(word, k)} ORDER BY distance, cf DESC, word LIMIT {FUZZY_LIMIT}) AS near"


def oracle_sql() -> dict[str, str]:
    asked = [w for w in ("tioon", "hereof", "thandx")]
    spelt = " UNION ALL ".join(f"SELECT * FROM (SELECT '{w}' AS asked, word, distance, cf FROM ({_duck_near(w, default_distance(w))}) AS n WHERE word <> '{w}' AND NOT EXISTS (SELECT 1 FROM tok WHERE surface = '{w}') ORDER BY distance, cf DESC, word LIMIT 5) AS a" for w in asked)
    ids = "SELECT doc_id, 0 AS n, 'pmc' AS kind, CAST(doc_id + 1 AS VARCHAR) AS number FROM documents UNION ALL SELECT doc_id, 1, 'pmid', CAST(n_chars + 1000 AS VARCHAR) FROM documents UNION ALL SELECT doc_id, 2, 'pmid', CAST(n_chars + 5000000 AS VARCHAR) FROM documents"
    kept = "SELECT '1' AS qid, 5 AS doc_id, 2 AS grade UNION ALL SELECT '2', 5, 1"
    return {
        "q8_fuzzy": duck(search_sql(DUCK, FUZZY, fuzzy=_duck_fuzzy)),
        "q15_spellcheck": duck(spelt),
        "s11_parse_ids": f"SELECT doc_id, CAST(n AS BIGINT) AS n, kind, number FROM ({ids}) AS i",
        "s15_model_round_trip": duck("SELECT word, cf, rank, round(vec[1], 5) AS x, CAST(len(vec) AS BIGINT) AS dim FROM model", embedding_relations(DUCK)),
        "s16_query_set": f"SELECT CAST(b.item_id AS VARCHAR) AS qid, CAST(length(b.text) AS BIGINT) AS size, CAST(k.doc_id AS BIGINT) AS doc_id, CAST(k.grade AS INT) AS grade FROM benchmark b LEFT JOIN ({kept}) AS k ON k.qid = CAST(b.item_id AS VARCHAR)",
    }


QUERIES: dict = {}
__all__ = ["FRAMES", "QUERIES", "open_index", "search"]
