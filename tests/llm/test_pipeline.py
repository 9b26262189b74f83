"""The pipeline's stages: what they keep, and that each works on what is left."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscope.llm import decontam, encoder, near_dup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= before and len(left) > 0.6 * len(before), name
        before = left
    assert near_dup.near_duplicates(docs).where("not kept").count() == 0
    found = decontam.find_spans(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert found.where("size(spans) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == before


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, n_words string, spans string, items string, id string, n string, rep string"


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names and empty tables."""
    clean = "the weather in the valley was mild and the people there went about their work as ever before"
    texts = [(1, None), (2, ""), (3, " \n"), (4, clean), (4, clean), (5, clean.upper()), (None, clean), (None, None), (6, (clean + " and more ") * 3000)]
    rows = [(i, t, "en" if t else None, None, len(t) if t else None, *"abcdefgh") for i, t in texts]
    rows += [(100 + k, f"{clean} number {k * 7919} of {k} " + " ".join(random.Random(k).choices(clean.split(), k=30)), "en", "s", 9, *"abcdefgh") for k in range(30)]
    docs = spark.createDataFrame(rows, CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and stage(spark, docs.limit(0), SF).count() == 0, name
        kept = out.collect()
        assert {(r.score, r.lang_pred, r.n_words, r.spans, r.items, r.id, r.n, r.rep) for r in kept} == {tuple("abcdefgh")}, name
        ids = [r.doc_id for r in kept]
        if name == "language":
            assert not {1, 2, 3} & set(ids) and ids.count(None) == 1 and ids.count(4) == 2
        elif name == "near_duplicates":
            assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2 and {1, 2, 3, 6} <= set(ids)
        else:
            assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    """All stages in a row: what they reject is gone, each by brute force or by its operator on what the stage before left."""
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    text = {r.doc_id: r.text for r in docs.collect()}
    tokenizer = Tokenizer.from_file(encoder.tokenizer_path())
    want = [(i, k, at, zlib.crc32(np.array(part, dtype="<u4").tobytes())) for i, t in text.items() for ids in [[*tokenizer.encode(t, add_special_tokens=False).ids, 1]] for k, at in enumerate(range(0, len(ids), 4096)) for part in [ids[at : at + 4096]]]
    assert sorted((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == sorted(want)
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    words = lambda t: t.lower().split()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in text.items() for w in [words(t)]}
    assert not [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for family in range(60):
        base = [word() for _ in range(200)]
        for k in range(3):
            copy = list(base)
            for _ in range(k * r.randint(1, 5)):
                copy[r.randrange(len(copy))] = word()
            rows.append((10 * family + k, " ".join(copy)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 10 == b // 10}
    assert sum(0.8 <= s < 0.85 for s in similar.values()) >= 5 and sum(s < 0.8 for s in similar.values()) >= 5
    root = {i: i for i in sets}
    for _ in range(3):
        for (a, b), s in similar.items():
            if s >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(x["doc_id"] for x in left.collect()) == [i for i in sorted(sets) if root[i] == i]
