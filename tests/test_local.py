"""What is made where a document lies: no token, pair or vector component is shuffled, and results are the same."""

import duckdb
import numpy as np
import pytest

from corpuscope.functions.porter import stem, stem_ctes
from corpuscope.operators import scoring
from corpuscope.operators.embedding import QUERIES, relations
from corpuscope.operators.query_language import Compiler, parse
from corpuscope.plans.dialect import DUCK, SPARK
from corpuscope.plans.relations import open_index, spark_sql

SF = "/root/testdata/sf0.001"


def test_python_stems_equal_sql():
    c = duckdb.connect()
    c.sql("CREATE TABLE v AS SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM '" + SF + "/documents.parquet'")
    c.executemany("INSERT INTO v VALUES (?)", [(w,) for w in "caresses ponies agreed bled sized hopping falling filing sky ying yed aaed controll éting adoption probate".split()])
    ctes = ", ".join(f"{n} AS ({q})" for n, q in stem_ctes(DUCK, "(SELECT DISTINCT word FROM v)"))
    assert not [(w, s) for w, s in c.sql(f"WITH {ctes} SELECT word, stem FROM stem_dim").fetchall() if stem(w) != s]


def test_a_search_filters_tokens_without_a_join(spark):
    hits = spark_sql(spark, SF, Compiler(SPARK).compile(parse("nd")).hits)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and hits.count()
    assert not spark_sql(spark, SF, Compiler(SPARK).compile(parse("nds")).hits).count()  # its stem is there, the word is not


def test_columns_do_not_ask_for_relations_of_their_name(spark):
    from corpuscope.plans.relations import _read

    assert _read("SELECT power(2e0, hits) AS zone, d.docs FROM doc_len d JOIN n_docs n ON 1 = 1") == {"doc_len", "n_docs"}


def test_tasks_return_the_first_documents_only(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 37)  # several blocks of the model
    monkeypatch.setattr(scoring, "ITEMS", 3)
    whole = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in spark_sql(spark, SF, QUERIES["r18_rank"](SPARK), relations(SPARK)).collect()}
    index = open_index(spark, SF)
    items = spark.table(index.views["query_vec"]).count()
    found = spark.table(index.views["vector_top"])
    assert found.count() <= spark.table(index.views["dw_lists"]).rdd.getNumPartitions() * 4 * items * (scoring.DEPTH + scoring.SPARE)
    docs = {r["doc_id"]: np.array(r["vec"]) for r in index.query("SELECT * FROM doc_vec", relations(SPARK)).collect()}
    for r in spark.table(index.views["query_vec"]).collect():
        best = sorted(docs, key=lambda x: (-round(float(docs[x] @ np.array(r["vec"])), 9), x))[:10]
        for k, doc in enumerate(best, 1):
            assert whole[r["item_id"], k][1] == pytest.approx(float(docs[doc] @ np.array(r["vec"])), abs=2e-6)


def test_first_keeps_ties_by_document():
    f = scoring.First(1)
    for at in range(0, 400, 100):
        docs = np.arange(399 - at, 299 - at, -1)
        f.add(docs, np.ones((100, 1)), np.ones((100, 1), dtype=bool))
        f.cut()
    assert f.cut()[1].tolist() == list(range(scoring.DEPTH + scoring.SPARE))


def test_bytes_are_cut_as_spark_cuts_texts(spark, tmp_path):
    """Words, places, fields and sizes of texts of all kinds, against Spark's own expressions."""
    from corpuscope.plans.relations import TOKEN, VECTOR_WORD

    texts = ["Der ÄRGER-straße\nZwei 2-x 3-4 a-b--c -d 9a-1\nİstanbul ΣΑΣ", "İa İb\nx İc\ny", "plain Text, 7 the\n\nlast the", None, "", "\n", "a b  c\x85d", "٣٤ ½ x² ǅ", "a-1-b 1-a 12 -x- Kelvin K-b", "Ÿ ſ ŉ Þ×÷", "\x1c a\x1fb"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels", "embeddings", "conversations", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = lambda sql: sorted(map(tuple, spark_sql(spark, str(tmp_path), sql, relations(SPARK)).collect()), key=repr)
    field = "CASE WHEN pos < nt THEN 'title' WHEN pos < nt + na THEN 'abstract' ELSE 'body' END"
    lists = f"SELECT doc_id, {SPARK.all('lower(text)', TOKEN)} AS w, {SPARK.size(SPARK.all('title', TOKEN))} AS nt, {SPARK.size(SPARK.all('abstract', TOKEN))} AS na FROM docs"
    assert rows("SELECT doc_id, pos, field, surface FROM tok") == rows(f"SELECT doc_id, CAST(pos AS BIGINT), {field}, surface FROM ({lists}) AS l LATERAL VIEW posexplode(w) AS pos, surface")
    vector = f"SELECT doc_id, lower(x) AS word FROM documents LATERAL VIEW explode({SPARK.all('text', VECTOR_WORD)}) AS x"
    want = rows(f"SELECT doc_id, word, count(*) FROM ({vector}) AS v WHERE length(word) > 1 AND word NOT IN (SELECT word FROM stop) GROUP BY doc_id, word")
    assert want and rows("SELECT doc_id, word, tf FROM dw_tf") == want
    white = f"SELECT doc_id, explode({SPARK.all('lower(text)', SPARK.words_a)}) AS x FROM documents"
    assert rows("SELECT doc_id, n_a, d_a FROM doc_sizes WHERE n_a > 0") == rows(f"SELECT doc_id, count(*), count(DISTINCT x) FROM ({white}) AS a GROUP BY doc_id")
    assert rows("SELECT term, CAST(sum(cf) AS BIGINT), CAST(sum(df) AS BIGINT) FROM raw_parts GROUP BY term") == rows(f"SELECT x, count(*), count(DISTINCT doc_id) FROM ({white}) AS a GROUP BY x")


def test_long_batches_are_cut_by_bytes_and_counts_given_out_early(spark, monkeypatch):
    import pyarrow as pa

    from corpuscope.plans import tokens

    monkeypatch.setattr(tokens, "BYTES", 10)
    b = pa.RecordBatch.from_pydict({"text": ["x" * 30, "a", None, "b" * 9, "c"]})
    assert [s.num_rows for s in tokens.slices([b])] == [1, 3, 1]
    held = tokens.Held("term_parts")
    held.add(["a", "b"], [np.array([1, 2])] * 8)
    held.add(["b", "c"], [np.array([3, 4])] * 8)
    out = pa.Table.from_batches(held.rows()).to_pylist()
    assert [(r["term"], r["cf"], r["max_tf"]) for r in out] == [("a", 1, 1), ("b", 5, 3), ("c", 4, 4)] and not held.at


def test_asked_weights_of_several_blocks_equal_sql(spark, monkeypatch):
    from corpuscope.operators import ranking

    index = open_index(spark, SF)
    index.query("SELECT * FROM query_stems JOIN vsm_lists ON 1 = 1 JOIN vsm_term ON 1 = 1", relations(SPARK))
    want = index.query(f"SELECT w.doc_id, w.term, w.w FROM ({ranking.weights_sql('ltc')}) AS w LEFT SEMI JOIN query_stems q ON q.term = w.term", relations(SPARK)).collect()
    monkeypatch.setattr(scoring, "WORDS", 1000)
    lists = index.query("SELECT doc_id, words, tfs FROM vsm_lists")
    got = {(r["doc_id"], t): w for r in scoring.asked_weights(index, lists, "vsm_term", "term", "query_stems").collect() for t, w in zip(r["terms"], r["ws"], strict=True)}
    assert len(want) == len(got) and all(got[r["doc_id"], r["term"]] == pytest.approx(r["w"], abs=1e-12) for r in want)
    by_vectors = dict(relations(SPARK))["vector_top"]  # reads no terms
    assert by_vectors.needs == ("query_vec",) and "doc_stems" not in by_vectors
