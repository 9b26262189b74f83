"""A query writes what it reads: no other tokens, no other conditions."""

import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpuscope import catalog
from corpuscope.functions.porter import stem
from corpuscope.operators import models, scoring
from corpuscope.plans import tokens
from corpuscope.plans.dialect import SPARK
from corpuscope.plans.relations import Index, asked_only

SF = "/root/testdata/sf0.001"


@pytest.fixture
def index(spark):
    return Index(spark, SF, uuid.uuid4().hex)


def run(index, name):
    q, relations = catalog._sql()[name]
    return index.query(q(SPARK), relations(SPARK)).collect()


def test_a_search_writes_the_tokens_of_its_stems_alone(spark, index):
    asked = {"r6_ranked_boolean": "nd ing ble hendnt", "r7_engine_search": "nd ing ble hendnt", "j_semi": "nd"}
    got = {name: run(index, name) for name in asked}
    assert not {"tok", "doc_terms", "doc_words", "term_parts"} & set(index.views)
    for name, words in asked.items():
        kept = [v for n, v in index.views.items() if n.startswith("tok_") and set() < {r[0] for r in spark.table(v).select("stem").distinct().collect()} <= {stem(w) for w in words.split()}]
        assert kept, name
    later = Index(spark, SF, uuid.uuid4().hex)
    for name in ("tok", "term_parts"):  # where an index has all tokens, they are read
        later.query(f"SELECT * FROM {name}")
    assert {n: run(later, n) for n in asked} == got
    assert not [n for n in later.views if n.startswith("tok_")]


def test_names_in_a_search_are_left_alone():
    sql = asked_only("SELECT doc_id, 'say FROM tok \\' JOIN hits' AS label FROM hits JOIN term_stats s ON 1 = 1", {"nd"}, set())
    assert "'say FROM tok \\' JOIN hits'" in sql and "FROM hits_" in sql and "JOIN term_stats_" in sql


@pytest.mark.parametrize("name", ["a13_power", "a13_median_curve", "a12_cfdf_zones"])
def test_one_condition_counts_one_kind_of_word(index, name, spark):
    assert run(index, name)
    assert not {"raw_parts", "term_parts", "zipf"} & set(index.views)
    words = spark.table(index.views["word_parts"])  # one row a word, and nothing by task is written
    assert words.count() == words.select("word").distinct().count()
    made = spark._jvm.org.apache.hadoop.fs.Path(index.path)
    written = {f.getPath().getName() for f in made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(made)}
    assert not {n for n in written if n.endswith("_by_task")}


def test_the_median_curve_gathers_no_list(index):
    q, relations = catalog._sql()["a13_median_curve"]
    assert "collect_list" not in index.query(q(SPARK), relations(SPARK))._jdf.queryExecution().optimizedPlan().toString()


def test_weightings_are_ranked_where_documents_lie(spark, index):
    assert run(index, "e10_vsm_search")
    assert not {"doc_terms", "term_parts", "word_parts", "doc_stems"} & set(index.views)
    q, relations = catalog._sql()["e10_vsm_search"]
    items = spark.table(index.views["query_nnc"]).select("item_id").distinct().count()
    parts = spark.table(index.views["vsm_lists"]).rdd.getNumPartitions()
    assert 0 < index.query("SELECT * FROM plain_top", relations(SPARK)).count() <= parts * items * 3 * (scoring.DEPTH + scoring.SPARE)


def test_weightings_of_several_blocks_equal_the_oracle(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ITEMS", 3)
    index = Index(spark, SF, uuid.uuid4().hex)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(catalog.oracle_sql()["e10_vsm_search"])
    at = [x[0] for x in want.description]
    place = at.index("score")
    got = sorted(tuple(r[n] for n in at) for r in run(index, "e10_vsm_search"))
    want = sorted(want.fetchall())
    assert [r[:place] + r[place + 1 :] for r in got] == [r[:place] + r[place + 1 :] for r in want]
    assert [r[place] for r in got] == pytest.approx([r[place] for r in want], abs=2e-6)


def test_nearest_words_are_found_by_task(spark, index, monkeypatch):
    monkeypatch.setattr(scoring, "ITEMS", 50)
    assert run(index, "r26_bucket_eval")
    _, relations = catalog._sql()["r26_bucket_eval"]
    rows = index.query("SELECT * FROM near_8", relations(SPARK))
    graded = spark.table(index.views["graded"])
    chosen, parts = graded.where("pick <= 120").count(), graded.rdd.getNumPartitions()
    assert rows.count() <= parts * chosen * (8 + scoring.SPARE) < chosen * (graded.count() - 1)


def test_a_vector_without_length_is_last(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", None), ("e", [-1.0, 0.0])], "word string, vec array<double>")
    got = scoring._near(rows.coalesce(1), ["a"], [[1.0, 0.0]], 8).collect()
    assert [(r["near"], None if r["sim"] is None else round(r["sim"], 6)) for r in got] == [("c", 0.707107), ("e", -1.0), ("b", None), ("d", None)]


def test_a_large_corpus_is_trained_by_shards(spark, tmp_path, monkeypatch):
    """Every word that a single task would train has a vector, words that share a context are nearer than others."""
    r = np.random.default_rng(3)
    groups = [[f"{g}{i:02d}" for i in range(12)] for g in "abc"]
    lines = [[str(w) for w in r.choice(groups[k % 3], 8)] for k in range(3000)] + [["rare", "once"], ["rare", "a00"]]
    rows = spark.createDataFrame([(m, x) for m in ("sg-x", "cbow-x") for x in lines], "model string, words array<string>")
    asked = {"dim": 8, "epochs": 4, "least": 2, "sample": 1.0, "rate": 0.1}
    folder = lambda name: str(tmp_path / uuid.uuid4().hex)
    one = {(x["model"], x["word"]): x for x in models.train_models(rows, **asked).collect()}
    assert {(x["model"], x["word"], tuple(x["vec"])) for x in models.train_corpus(rows, folder, **asked).collect()} == {(*k, tuple(x["vec"])) for k, x in one.items()}
    monkeypatch.setattr(models, "MAX_TOKENS", 100)
    monkeypatch.setattr(models, "SHARD", 9000)
    many = {(x["model"], x["word"]): x for x in models.train_corpus(rows, folder, **asked).collect()}
    assert {k: (x["count"], x["rank"]) for k, x in many.items()} == {k: (x["count"], x["rank"]) for k, x in one.items()}
    for found in (one, many):
        x = np.array([found["sg-x", w]["vec"] for g in groups for w in g])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        same = np.kron(np.eye(3), np.ones((12, 12))) - np.eye(36)
        sims = x @ x.T
        assert (sims * same).sum() / same.sum() > (sims * (1 - same - np.eye(36))).sum() / (1 - same - np.eye(36)).sum() + 0.3


@pytest.mark.parametrize("name, runs", [("e11_methods_eval", 5), ("r21_methods", 5), ("e11_alpha_sweep", 11), ("r20_hybrid", 11)])
def test_methods_score_texts_as_they_are_read(spark, index, name, runs):
    """No list, vector or weight of a document is written, and a task gives back the first documents alone."""
    assert run(index, name)
    found = "method_top" if runs == 5 else "mixed_top"
    assert found in index.views
    assert not {"dw_lists", "vsm_lists", "doc_sums", "mean_sums", "doc_stems", "doc_words_asked", "doc_terms", "w_rank"} & set(index.views)
    items, parts = spark.table(index.views["query_stems"]).select("item_id").distinct().count(), spark.table(index.views["documents"]).rdd.getNumPartitions()
    rows = spark.table(index.views[found])
    assert 0 < rows.count() <= parts * items * runs * (scoring.DEPTH + scoring.SPARE)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["r21_methods", "r20_hybrid", "e11_methods_eval", "e11_alpha_sweep"])
def test_methods_of_several_blocks_equal_the_oracle(spark, monkeypatch, name):
    for k, n in {"ITEMS": 7, "BLOCK": 37, "WORDS": 500, "HELD": 20000}.items():
        monkeypatch.setattr(scoring, k, n)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in want.description]
    got = sorted(tuple(r[n] for n in at) for r in run(Index(spark, SF, uuid.uuid4().hex), name))
    want = sorted(want.fetchall())
    real = [k for k, x in enumerate(want[0]) if isinstance(x, float)]
    rest = lambda rows: [tuple(x for k, x in enumerate(r) if k not in real) for r in rows]
    assert rest(got) == rest(want)
    for k in real:
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], abs=2e-6)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    words = pa.array(["one", "", "two", "three", "längere-9"])
    asked = pa.array(["two", "none", "längere-9", "", "three", "one"])
    for change in (None, lambda w: np.array([len(x) % 2 for x in w.to_pylist()], dtype=np.uint64)):
        if change:
            monkeypatch.setattr(scoring, "_hashes", change)
        assert scoring.Places(words).find(asked, scoring._hashes(asked)).tolist() == [2, -1, 4, 1, 3, 0]
        assert scoring.Places(words[:0]).find(asked, scoring._hashes(asked)).tolist() == [-1] * 6


def test_stems_of_title_and_abstract_need_no_more_than_two_lines():
    texts = ["Running dogs\nran x\nrunning on", None, "", "\n", "\n\nbody here", "one line of words", "a\r\nmany bodies\n\nb"]
    lists = [None] * len(texts) + [["tïtle", "words", "here", "longer", "body"], []]
    b = pa.RecordBatch.from_pydict({"text": pa.array([*texts, None, None], pa.string()), "w": pa.array(lists, pa.list_(pa.string())), "nt": pa.array([None] * 7 + [1, 0], pa.int32()), "na": pa.array([None] * 7 + [2, 0], pa.int32())})
    stems, doc, term, _, _, title, abstract, _ = tokens._by_stem(tokens.Bag(b))
    want = sorted((d, stems[t], n) for d, t, n in zip(doc.tolist(), term.tolist(), (title + abstract).tolist()) if n)
    stems, doc, term, n = tokens.head_stems(b)
    assert want and sorted(zip(doc.tolist(), [stems[t] for t in term], n.tolist())) == want


def test_the_model_ranks_the_words_that_have_vectors(spark, index):
    _, relations = catalog._sql()["e11_methods_eval"]
    got = {tuple(r) for r in index.query("SELECT word, df, cf, rank FROM model", relations(SPARK)).collect()}
    assert index.query("SELECT * FROM w_first", relations(SPARK)).count() < index.query("SELECT * FROM w_stats", relations(SPARK)).count()
    want = {tuple(r) for r in index.query("SELECT r.word, r.df, r.cf, r.rank FROM w_rank r JOIN embeddings e ON e.vec_id = r.rank - 1", relations(SPARK)).collect()}
    assert got == want and got


def test_counts_of_words_alone_ask_for_no_stems(monkeypatch):
    def never(words):
        raise AssertionError(words)

    held = tokens.Held("w_parts")
    held.add(["a", "b"], [np.array([1, 2])] * 2)
    monkeypatch.setattr(tokens, "_stemmed", never)
    assert pa.Table.from_batches(held.rows()).to_pylist() == [{"word": "a", "cf": 1, "df": 1}, {"word": "b", "cf": 2, "df": 2}]
