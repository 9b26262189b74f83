"""Registered queries against DuckDB over the smallest tables; the whole catalogue with CORPUSCOPE_ALL=1."""

import math
import os
import re

import duckdb
import numpy as np
import pytest

from corpuscope import catalog

SF = "/root/testdata/sf0.001"
SOME = "t4_porter_vocab t12_char_classes a1_postings a10_fit a12_zone_terms a4_doc_fields q6_phrase q9_nested q11_not r1_bm25 r4_title_boost r11_weights_ltc r15_rank_ltc e4_ndcg e7_kendall r18_rank r20_hybrid r22_candidates s14_upsert_delete q8_fuzzy q14_query_analysis t13_highlight_spans r7_engine_search e10_vsm_compare e8_overrides r21_methods a14_auto_terms s11_parse_ids s15_model_round_trip s16_query_set r2_tfidf".split()
NAMES = sorted(catalog.oracle_sql()) if os.environ.get("CORPUSCOPE_ALL") else SOME
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 6)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, want.fetchall())
    assert len(got) == len(want) and all(a == b or all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)) for a, b in zip(got, want, strict=True))


def test_fuzzy_search_covers_the_exact_word(spark):
    from corpuscope.operators.frames import search

    exact = {r["doc_id"] for r in search(spark, SF, "thanedble").collect()}
    fuzzy = {r["doc_id"] for r in search(spark, SF, "thanedble~1").collect()}
    assert exact <= fuzzy


def test_phrase_is_within_and(spark):
    from corpuscope.operators.frames import search

    phrase = {r["doc_id"] for r in search(spark, SF, '"and attion to thanedble"').collect()}
    both = {r["doc_id"] for r in search(spark, SF, "attion AND thanedble").collect()}
    none = {r["doc_id"] for r in search(spark, SF, "NOT (attion AND thanedble)").collect()}
    assert phrase and phrase <= both and not both & none and len(both) + len(none) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stream_equals_rebuild(spark):
    from corpuscope.operators.frames import stream
    from corpuscope.streaming.index_stream import postings, term_stats

    kept = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 10 <> 0")
    key = lambda df: sorted(map(tuple, df.select("term", "df", "cf").collect()))
    assert key(stream(spark, SF)) == key(term_stats(postings(kept)))


def test_words_of_every_bucket_are_evaluated(spark, duck):
    from corpuscope.operators.embedding import BUCKETS, _buckets, relations
    from corpuscope.plans.dialect import SPARK
    from corpuscope.plans.relations import spark_sql

    test_equals_oracle("r26_bucket_eval", spark, duck)
    k = 60  # the vectors know no stems, so that few variants are nearer
    got = {r["bucket"]: r for r in spark_sql(spark, SF, _buckets(SPARK, k), relations(SPARK)).collect()}
    sql = f"SELECT m.word, m.vec, s.stem, md5(m.word) AS h, {BUCKETS.format(c='m.cf')} AS bucket FROM model m LEFT JOIN stem_dim s ON s.word = m.word"
    model = sorted(spark_sql(spark, SF, sql, relations(SPARK)).collect(), key=lambda r: (r["h"], r["word"]))
    x = np.array([r["vec"] for r in model])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    assert set(got) == {r["bucket"] for r in model}
    for bucket, r in got.items():
        mine = [i for i, w in enumerate(model) if w["bucket"] == bucket]
        assert r["words"] == len(mine) and r["sampled"] == min(120, len(mine))
        ranks = []
        for i in mine[:120]:
            near = sorted((j for j in range(len(model)) if j != i), key=lambda j: (-sims[i, j], model[j]["word"]))
            kin = {j for j in near if model[i]["stem"] is not None and model[j]["stem"] == model[i]["stem"]}
            if kin:
                ranks.append(next((n for n, j in enumerate(near[:k], 1) if j in kin), 0))
        assert r["with_variant"] == len(ranks)
        if ranks:
            assert r["variant_hit"] == pytest.approx(np.mean([n > 0 for n in ranks]), abs=2e-6)
            assert r["variant_mrr"] == pytest.approx(np.mean([1 / n if n else 0 for n in ranks]), abs=2e-6)
    assert any(r["variant_hit"] for r in got.values())


def test_rows_only_queries(spark):
    q = catalog.queries()
    sentences = q["t7_sentences"](spark, SF).groupBy("doc_id").count().collect()
    assert len(sentences) > 100
    vectors = q["r28_sgns"](spark, SF).collect()
    assert {r["model"] for r in vectors} == {"sg-d20", "cbow-d20"} and all(len(r["vec"]) == 20 for r in vectors)
    assert q["r23_pca"](spark, SF).count() == 400


def test_training_reads_every_word_of_the_documents(spark, monkeypatch):
    from corpuscope.functions.sentences import split_sentences
    from corpuscope.functions.stopwords import STOP_WORDS
    from corpuscope.operators import frames, models
    from corpuscope.plans.relations import VECTOR_WORD

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["Insulin, insulin x b insulin.\ninsulin again", None, ""]
    want = []
    for sentence in (s for t in texts if t for line in t.split("\n") for s in split_sentences(line)):
        words = [w.lower() for w in re.findall(VECTOR_WORD, sentence)]
        words = [w for w in words if len(w) > 1 and w not in STOP_WORDS]
        want += [words] if len(words) > 1 else []
    assert ["insulin"] * 3 in want
    rows = frames.training_sentences(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(r["words"] for r in rows.where("model = 'sg-d20'").collect()) == sorted(want)
    monkeypatch.setattr(models, "MAX_TOKENS", 100)
    with pytest.raises(ValueError, match="more than the 100"):
        models.train_models(rows)


def test_sentences_views_and_snippets(spark):
    """Sentences, their hits and the best two of each document, by plain Python."""
    from corpuscope.functions.sentences import split_sentences
    from corpuscope.operators.frames import spark_sql

    stems = {r["word"]: r["stem"] for r in spark_sql(spark, SF, "SELECT word, stem FROM stem_dim").collect()}
    asked = {stems["nd"], stems["ing"]}
    sentences, view, best = {}, {}, {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        n, ranked = 0, []
        for k, line in enumerate(r["text"].split("\n")):
            for s in split_sentences(line):
                n += 1
                found = [stems[w] for w in re.findall(r"[^\W_]+", s.lower()) if stems[w] in asked]
                sentences[r["doc_id"], n] = s
                view[r["doc_id"], n] = ("title", "abstract", "body")[min(k, 2)], s, len(found)
                if found:
                    ranked.append((-1000 * len(set(found)) - len(found), n))
        best |= {(r["doc_id"], i): n for i, (_, n) in enumerate(sorted(ranked)[:2], 1)}
    q = catalog.queries()
    assert {(r["doc_id"], r["n"]): r["sentence"] for r in q["t7_sentences"](spark, SF).collect()} == sentences
    assert {(r["doc_id"], r["n"]): (r["field"], r["sentence"], r["hits"]) for r in q["r10_document_view"](spark, SF).collect()} == view
    assert {(r["doc_id"], r["rank"]): r["n"] for r in q["r9_snippets"](spark, SF).collect()} == best


def test_osa_by_brute_force(spark):
    def osa(a, b):
        m = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    m[i][j] = min(m[i][j], m[i - 2][j - 2] + 1)
        return m[-1][-1]

    from corpuscope.operators.frames import dictionary

    want = {(r["word"], k) for r in dictionary(spark, SF).collect() if abs(len(r["word"]) - 8) <= 2 and (k := osa("tinoable", r["word"])) <= 2}
    assert {(r["word"], r["distance"]) for r in catalog.queries()["r22_osa_within"](spark, SF).collect()} == want


def test_misspelt_query_is_run_again(spark):
    from corpuscope.operators.frames import engine_search

    page, how = engine_search(spark, SF, "hendntx")
    assert how["corrected"] and how["corrections"]["hendntx"] and page.count() > 0 and all(r["snippet"] for r in page.collect())
    page, how = engine_search(spark, SF, "nd AND ing", limit=3)
    assert not how["corrected"] and page.count() == 3


def test_changed_tables_get_a_new_index(spark, tmp_path):
    from corpuscope.plans.relations import spark_sql

    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    count = lambda: spark_sql(spark, str(tmp_path), "SELECT df FROM term_stats WHERE term = 'zebrafinch'").collect()
    assert count() == []
    spark.createDataFrame([(10**6, "zebrafinch", "en", "x", 10)], spark.read.parquet(f"{SF}/documents.parquet").schema).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert [r["df"] for r in count()] == [1]
    assert not {"documents", "tok", "labels"} & {t.name for t in spark.catalog.listTables()}


def test_training_separates_two_topics():
    from corpuscope.operators.models import train_vectors

    r = np.random.default_rng(3)
    topics = [[f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]]
    text = [list(r.choice(topics[k % 2], 4, replace=False)) for k in range(600)]
    for cbow in (False, True):
        words, counts, x, losses = train_vectors(text, cbow=cbow, dim=12, window=3, epochs=8, least=1, sample=1.0, rate=0.05)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        own = np.array([w[0] == "a" for w in words])
        same, other = (x[own] @ x[own].T).mean(), (x[own] @ x[~own].T).mean()
        assert len(words) == 12 and sum(counts) == 2400 and losses[-1] < losses[0] and same > other + 0.2


def test_tsne_keeps_neighbours(spark):
    from corpuscope.operators.models import tsne

    r = np.random.default_rng(5)
    x = np.repeat(10 * r.standard_normal((4, 16)), 15, axis=0) + r.standard_normal((60, 16))
    y = tsne(x)
    near = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(near, np.inf)
    assert np.mean(near.argmin(axis=1) // 15 == np.arange(60) // 15) > 0.9
