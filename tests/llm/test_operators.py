"""The operators on small tables with nulls, empty and long texts, repeats, clashing columns, and against brute force."""

import gzip
import glob
import random
import re
import zlib

import numpy as np
import pytest

from corpuscope.llm import decontam, encoder, grammar, html_text, langid, license_scan, near_dup, packing, token_files, toxicity, vector_dup, warc
from corpuscope.llm.common import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, score double"


def docs(spark, rows):
    """Rows of (doc_id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


LONG = prose(1, 30_000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, LONG), (6, LONG), (6, LONG), (None, "no id here at all"), (8, "...!?")]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(0, i) for i in range(400, 900)] + [(i, i + 1) for i in range(1000, 1064)] + [(5, 5)]
    parent = list(range(1100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(text, items, window=13):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for key, t in items:
        w = decontam.words_of(t)
        m = min(window, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(key))
    return len(words), len(hit), found


def test_decontamination(spark, monkeypatch):
    item = prose(7, 30)
    long = " ".join(LONG.split()[:9000]) + " " + item + " " + " ".join(LONG.split()[9000:12000])
    items = [(1, item), (2, "short one"), (3, None), (4, "..."), (5, " ".join(item.split()[3:20]))]
    rows = [*ODD, (10, f"x {item.upper()}! y"), (11, long), (12, " ".join(item.split()[:12])), (13, "a short, ONE b short one"), (14, item), (14, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *brute_hits(t, items)) for i, t in rows], key=repr)
    for words, block in ((decontam.SHARD_WORDS, decontam.BLOCK_BYTES), (500, 150)):
        monkeypatch.setattr(decontam, "SHARD_WORDS", words)
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        found = decontam.find_spans(docs(spark, rows), bench)
        got = sorted([(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), set(r["items"])) for r in found.collect()], key=repr)
        assert got == want
        assert {"score", "lang"} <= set(found.columns)
    cut = decontam.remove_spans(found.where("doc_id = 10").select("doc_id", "text", "spans")).collect()[0]["text"]
    assert re.sub(r"\s+", " ", cut) == "x ! y"
    assert decontam.find_spans(docs(spark, []), bench).count() == 0
    assert decontam.find_spans(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("size(spans) > 0").count() == 0


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (6, LONG), (7, LONG + " more")]
    for family in range(6):
        base = prose(100 + family, 150).split()
        for k in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = prose(r.random(), 1)
            rows.append((100 * (family + 1) + k, " ".join(copy)))
    sets = {i: set(near_dup.shingles(t, near_dup._WordHash()).tolist()) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(list(sets), linked)
    out = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) and x["n_shingles"] == len(sets[x["doc_id"]]) for x in out)
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    twice = near_dup.near_duplicates(docs(spark, [(9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in twice), key=repr) == [(9, 9, True), (9, 9, True), (None, None, True)]
    unlike = near_dup.near_duplicates(docs(spark, [(9, "a b c d e f"), (9, "g h i j k l"), (7, "g h i j k l"), (8, "a b c d e f"), (10, "x y z u v w"), (11, "x y z u v w"), (11, None)])).collect()
    assert {x["doc_id"]: x["component_id"] for x in unlike} == {7: 7, 8: 7, 9: 7, 10: 10, 11: 10} and [x["component_id"] for x in unlike].count(7) == 4


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 16))
    rows = []
    for k, b in enumerate(base):
        for j in range(30 if k == 0 else 6):
            rows.append((100 * k + j, (b + 0.08 * r.standard_normal(16)).tolist()))
    rows += [(6000 + i, [float(i % 3), 1.0, 2.0]) for i in range(7)]  # vectors of another length
    rows += [(5000, rows[0][1]), (5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 3), (5005, [None] * 16)]
    got = {x["vec_id"]: x for x in vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = {i: np.array(v) for i, v in rows if i <= 5000 or i == 5004 or i >= 6000}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else 0
    linked = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b]) >= 0.9]
    want = brute_components([i for i, _ in rows], linked)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert {i: x["n_links"] for i, x in got.items()} == {i: sum(i in e for e in linked) for i, _ in rows}
    assert vector_dup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_crosses_shards(spark, monkeypatch):
    """Pairs without a common cluster are found over united edges that leave the shard; none counts twice."""
    monkeypatch.setattr(vector_dup, "SHARD", 128)
    r = np.random.default_rng(8)
    x = vector_dup.unit_rows((np.repeat(r.standard_normal((150, 6)), 8, axis=0) + 0.12 * r.standard_normal((1200, 6))).tolist())
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, m long, v array<double>")
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    centres = vector_dup.centres_of(x, 20)
    counts, _ = vector_dup._search(classes, centres, 2, 0.9)
    got = {y["id"]: y["links"] for y in counts.collect()}
    assert all(got.get(i, 0) <= n for i, n in enumerate(true))
    own = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :2]
    together = (own[:, None, :, None] == own[None, :, None, :]).any(axis=(2, 3)) & (x @ x.T >= 0.9)
    assert sum(got.values()) > together.sum() - len(x) and sum(got.values()) >= 0.97 * true.sum()


def test_vectors_of_repeated_keys(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (None, [1.0, 0.0]), (4, [-1.0, 0.0])]
    got = vector_dup.near_vectors(spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, id long, rep string")).collect()
    assert sorted(((x["vec_id"], x["component_id"], x["kept"]) for x in got), key=repr) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)]


def test_search_over_the_graph_finds_what_is_near():
    r = np.random.default_rng(4)
    x = vector_dup.unit_rows((np.repeat(r.standard_normal((40, 24)), 20, axis=0) + 0.1 * r.standard_normal((800, 24))).tolist())
    graph = vector_dup._pad(vector_dup.with_back_edges(vector_dup.robust_prune(x)))
    assert graph.shape[1] < 800
    found = sum(len(n) for n in vector_dup.range_search(x, graph, x, 0.9))
    assert found >= 0.98 * (x @ x.T >= 0.9).sum()


def thin_pairs(seed, n, pairs, group=0):
    """n scattered vectors of which so many have one near copy each, and a dense group."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 24))
    x = np.concatenate((x, x[:pairs] + 0.05 * r.standard_normal((pairs, 24)), x[-1] + 0.05 * r.standard_normal((group, 24))))
    return vector_dup.unit_rows(x.tolist())


def test_audit_sees_lost_links(spark):
    x = thin_pairs(6, 1500, 80, 300)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, m long, v array<double>").cache()
    counts = lambda links: spark.createDataFrame([(i, int(n)) for i, n in enumerate(links)], "id long, links long")
    assert vector_dup._audit(classes, counts(true), len(x), 0.9) == 1
    lost = true.copy()  # every second pair; the group keeps its links, which are most
    lost[0:80:2] = lost[1500:1580:2] = 0
    assert lost.sum() > 0.99 * true.sum()
    assert vector_dup._audit(classes, counts(lost), len(x), 0.9) < 0.7


def test_vectors_are_all_compared_where_the_search_falls_short(spark, monkeypatch):
    x = thin_pairs(7, 400, 40, 30)
    lossy = vector_dup._search
    monkeypatch.setattr(vector_dup, "_search", lambda *a: tuple(t.where("id % 2 = 0") if "id" in t.columns else t.where("b % 2 = 0") for t in lossy(*a)))
    monkeypatch.setattr(vector_dup, "EXACT_BLOCK", 150)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(9000, x[3].tolist()), (9001, x[3].tolist())]
    got = {r["vec_id"]: r for r in vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    y = np.array([v for _, v in rows])
    hit = y @ y.T >= 0.9
    ids = [i for i, _ in rows]
    assert [got[i]["n_links"] for i in ids] == (hit.sum(axis=1) - 1).tolist()
    assert {i: got[i]["component_id"] for i in ids} == brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True) if a < b])


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in langid.langid_query(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    held = [i for i, r in out.items() if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert np.mean([out[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    model = langid.learn(d)
    more = [*ODD, *enumerate(("½", "² ³", "Ⅷ", "①", "x½", "中"), 50)]
    odd = langid.identify(docs(spark, more), model).collect()
    assert langid.identify(docs(spark, []), model).count() == 0
    assert len(odd) == len(more) and all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["score"] <= 1 for r in odd)
    nothing = langid.learn(docs(spark, []))
    assert [r["lang_pred"] for r in langid.identify(docs(spark, [(1, "abc")]), nothing).collect()] == ["und"]


@pytest.fixture(scope="module")
def plain_encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoder.tokenizer_path())


def test_words_encode_as_whole_texts(plain_encoder, monkeypatch):
    r = random.Random(12)
    odd = ["ÉCOLE. d's, İ; ok.. 'll", "<|endoftext|>. x", "Ａb ªº, fi ǅ", "a\tb\x1cq  z", "é ́e", "It's 12% of—it", prose(3, 500), "", None]
    marks = [" ", "\n", "\x1c", "\x85", "\xa0", "'", "'s", "'RE", "'LL", "É", "ß", "ª", "²", "½", "7", "..", "<|", "|>", "×", "中", "e\u0301", "İ", "Σ", "\u200b", "\x00", "Ⅷ", "a", "Bc"]
    odd += ["".join(r.choice(marks) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    monkeypatch.setattr(encoder, "JOINED", 7)
    monkeypatch.setattr(encoder, "WINDOW", 50)
    monkeypatch.setattr(encoder, "KEPT_BYTES", 5000)
    e = encoder.Encoder(encoder.tokenizer_path(), slots=512)
    got = [x for i in range(0, len(odd), 40) for x in e.encode(odd[i : i + 40])]
    for t, x in zip(odd, got, strict=True):
        assert x.tolist() == (plain_encoder.encode(t, add_special_tokens=False).ids if t else [])
    assert e.slots <= 2048 and e.taken <= 1300


def test_token_files(spark, tmp_path, plain_encoder, monkeypatch):
    rows = [*ODD, (40, prose(9, 50)), (-3, "Minus")]
    path = f"file://{tmp_path}/tokens"
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 200)
    token_files.write_token_files(docs(spark, rows), path)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path).where("doc_id is not null").collect())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*(plain_encoder.encode(t, add_special_tokens=False).ids if t else []), 2], dtype="<u4")
        if i is not None:
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    shard = token_files.Shard(spark.read.parquet(path).orderBy("part", "first").first()["file"])
    ids = shard.matrix.decode()
    assert shard.token(0, 0) == ids[0] and shard.count(2) == (ids == 2).sum()
    assert [shard.starts[d] + i for d, i in shard.occurrences(2)] == np.flatnonzero(ids == 2).tolist()
    with pytest.raises(ValueError):
        token_files.Shard(b"nothing")
    empty = f"file://{tmp_path}/none"
    token_files.write_token_files(docs(spark, []), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing(spark, plain_encoder):
    rows = [*ODD, *[(100 + i, prose(i, 40 * (i % 37) + 1)) for i in range(200)]]
    out = packing.pack_documents(docs(spark, rows)).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 4096 and g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
    assert out["sequence_id"].nunique() <= 1.04 * out["length"].sum() / 4096 + 2
    want = []
    for i, t in rows:
        ids = [*(plain_encoder.encode(t, add_special_tokens=False).ids if t else []), 1]
        want += [(i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)) for part in [ids[at : at + 4096]]]
    got = packing.pieces(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def fewest_by_best_fit(lengths):
    bins = packing._Bins(4096)
    for n in sorted(lengths.tolist(), reverse=True):
        bins.best_fit(n)
    return bins.n


def test_linear_grouping_is_near_the_optimum():
    r = np.random.default_rng(1)
    for low, high in ((1, 4096), (1100, 2900), (600, 1400), (4096, 4097), (1, 2)):
        lengths = r.integers(low, high, 3000)
        number, n = packing.linear_grouping(lengths)
        assert np.bincount(number, weights=lengths).max() <= 4096 and n == number.max() + 1
        assert packing.pack(lengths).max() + 1 <= 1.04 * fewest_by_best_fit(lengths) + 1
    assert len(packing.pack(np.zeros(0, dtype=np.int64))) == 0


def test_grouping_alone_packs_documents_to_the_least(spark):
    lengths = np.array([r["length"] for r in packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length").collect()])
    assert packing.pack(lengths).max() + 1 <= 1.01 * -(-lengths.sum() // 4096)


def test_licenses():
    t = license_scan.Templates()
    mit = license_scan.TEMPLATES[4][1]
    n, found = t.scan(f"x {mit.replace('hereby', 'hereby now')} y {mit} Licensed under CC BY-NC 4.0. z")
    assert [m["license"] for m in found] == ["MIT", "MIT", "CC-BY-NC-4.0"] and found[1]["coverage"] == 1.0
    assert t.scan(None) == t.scan("") == (0, []) and t.scan(LONG)[1] == []
    assert t.scan("licensed the under of apache x y license version then 2 and 0 " * 3)[1] == []
    lines = " ".join(["Licensed under the MIT License."] * 3000)
    assert len(t.scan(lines)[1]) == 3000
    full = dict(license_scan.TEMPLATES)["BSD-3-Clause"]
    assert [m["license"] for m in t.scan(f"a b c {full} d e f")[1]] == ["BSD-3-Clause"]
    assert license_scan.align([1, 9, 2, 3, 3, 4], [1, 2, 3, 4]) == [(0, 0), (2, 1), (4, 2), (5, 3)]


def test_license_query(spark):
    lines = {"under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in license_scan.license_query(spark, SF).collect():
        assert r["licenses"] == ",".join(sorted({v for k, v in lines.items() if k in text[r["doc_id"]]}))


def test_main_text(spark):
    net = html_text.trained()
    r = random.Random(1234)
    pages = [html_text.make_page(r) for _ in range(80)]
    got = html_text.main_texts([p for p, _ in pages], net)
    assert np.mean([g == "\n".join(w) for g, (_, w) in zip(got, pages)]) > 0.85
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<script>x</script>"), (4, "u", pages[0][0]), (4, "u", pages[0][0])]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), net=net).collect()
    assert [(x["text"], x["n_chars"]) for x in out[:3]] == [("", 0)] * 3 and out[3] == out[4]
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br><p>Three four five six.</p></article><footer>&copy; x</footer>"
    assert html_text.main_texts([page], net) == ["A & B\nOne two\nThree four five six."]


def test_all_words_of_a_block_are_read():
    start = prose(11, 100)
    one, two = (html_text.block_vectors([html_text.Block(f"{start} {prose(k, 200)}.", ("p",), 0)])[0] for k in (12, 13))
    words = slice(html_text.PATH_DIM, html_text.PATH_DIM + html_text.WORD_DIM)
    assert np.abs(one[words] - two[words]).max() > 0.05
    counts = [html_text.block_vectors([html_text.Block(prose(14, n), ("p",), 0)])[0][words.stop + 4] for n in (50, 200, 800)]
    assert counts == sorted(set(counts))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>a</p><svg-icon name="x"></svg-icon><p>rest of article</p>', ["a", "rest of article"]),
        ('<p>a <svg class="i"/> b</p><p>rest</p>', ["a b", "rest"]),
        ('<p>a <svg class="i"> b</p><p>rest</p>', ["a b", "rest"]),
        ('<p>a <svg class="i"> b</p><p>rest</p><svg><title>t</title></svg><p>end</p>', ["a b", "rest", "end"]),
        ("<p>a <svg><svg><text>t</text></svg><text>u</text></svg> b</p><p>rest</p>", ["a b", "rest"]),
        ("<p>a</p><select-box></select-box><template-x>b</template-x><script-x></script-x><p>rest</p>", ["a", "b", "rest"]),
        ("<p>a</p><select><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><TEMPLATE id=t><p>no</p></template ><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><select><option>no</option></select><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><script>var s = '<svg>';</script><p>rest</p><svg>no</svg>", ["a", "rest"]),
        ("<p>a</p><script>if (a </p>", ["a"]),
        ("<p>a</p><svg", ["a"]),
    ],
)
def test_broken_markup_loses_no_text(page, want):
    assert [b.text for b in html_text.blocks_of(page)] == want


def test_warc(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, f"http://x/{i}", "".join(chr(r.randint(32, 1000)) for _ in range(r.randint(0, 3000)))) for i in range(60)]
    rows += [(100 + i, "u", rows[i][2]) for i in range(20)] + [(200, None, None), (201, "a\r\nb", "")]
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2, "page_id")
    warc.write_warc(pages, path)
    want = {x[0]: tuple(x) for x in warc.expected([(i, h) for i, _, h in rows])}
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    for size in (None, 5000, 900):
        got = warc.read_warc(spark, path, split_bytes=size).collect()
        assert len(got) == len(want) and {x["page_id"]: (x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got} == want
    spark.conf.set("spark.sql.files.openCostInBytes", old)
    for f in glob.glob(f"{tmp_path}/w/*.txt"):
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_warc_scan_gives_false_magics_back():
    body = warc.MAGIC * 3 + b"text"
    gz = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = gz.compress(b"WARC/1.1\r\n" + body) + gz.flush()
    scan = warc.MemberScan()
    out = [scan.feed(s) for s in stored.split(warc.MAGIC)[1:]]
    assert out[-1] == [(b"WARC/1.1\r\n" + body, None)] and not any(out[:-1])
    scan = warc.MemberScan()  # a false magic first, then the tail of its member, then a real member
    out = [x for s in [b"\x00\x00\x00\x00\x00\x00\x03", b"no member", *stored.split(warc.MAGIC)[1:]] for x in scan.feed(s)]
    assert [w for w, _ in out if w] == [b"WARC/1.1\r\n" + body] and len([x for _, x in out if x]) == 2 and scan.rest() is None


def test_toxicity(spark):
    out = {r["doc_id"]: r for r in toxicity.toxicity_query(spark, SF).collect()}
    assert len(out) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = toxicity.learn(d, labels)
    assert toxicity.score(docs(spark, []), learned).count() == 0
    odd = toxicity.score(docs(spark, [*ODD, (50, "You are an idiot and a clown, idiot. You moron, worthless trash!")]), learned).collect()
    by = {r["doc_id"]: r["score"] for r in odd}
    assert by[50] >= 0.5 and max(by[i] for i in (1, 2, 3, 4, 5)) < 0.5
    none = toxicity.learn(d, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs(spark, ODD), none).collect())


def test_clause_grammar():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "weak": 1.0}, {"zorg": 1.0}, {"kill": 3.0})
    kinds = lambda t: [k for clause in toxicity.matches(t, lexicon)[0] for k, _, _ in clause]
    assert kinds("What an idiot.") == ["insult:plain"]
    assert kinds("You idiot! He said idiot. Not an idiot. It is not such a very big idiot.") == ["insult:aimed", "insult:reported", "insult:negated", "insult:plain"]
    assert kinds("zorgling; zorg kill you") == ["insult:plain", "threat:aimed"]
    assert kinds("an idiot, you are") == ["insult:aimed"] and kinds("not weak") == [] and kinds("") == []
    weight = lambda t: sum(w for clause in toxicity.matches(t, lexicon)[0] for _, w, _ in clause)
    assert weight("you idiot") > weight("idiot") > weight("quoted: idiot") > weight("never idiot")


def all_paths(machines, symbols):
    """Weights of all readings of symbols by machines one after the other, with what is written at last."""
    rows = {(tuple(symbols), 0.0)}
    for m in machines:
        now = set()
        for row, w in rows:
            paths = [(m.start, (), w)]
            for s in row:
                paths = [(t, (*out, write), v + more) for state, out, v in paths for write, more, t in m.arcs.get(state, {}).get(s, ())]
            now |= {(out, v + m.final[state]) for state, out, v in paths if state in m.final}
        rows = now
    return rows


def test_composition_by_all_paths():
    r = random.Random(9)
    stages = grammar.stages()
    words = {"w": [("other", 0.0)], "you": [("target", 0.0)], "not": [("negation", 0.0)], "said": [("report", 0.0)], "kill": [("threat", 1.5), ("other", 0.0)], "fool": [("insult", 3.0), ("other", 0.0)], "both": [("insult", 0.25), ("threat", 0.5), ("target", 0.0)]}
    for _ in range(400):
        clause = [r.choice(list(words)) for _ in range(r.randint(0, 6))]
        every = [(c, w) for w in clause for c in [words[w]]]
        readings = [()]
        for options, _ in every:
            readings = [(*x, o) for x in readings for o in options]
        best = max(sum(w for _, w in x) + v for x in readings for _, v in all_paths(stages, [c for c, _ in x]))
        before, row = 0, []
        for w in clause:  # others count as a gap
            if w == "w":
                before += 1
            else:
                row.append((before, w))
                before = 0
        got, found = grammar.read_clause(row, words.__getitem__)
        assert got == pytest.approx(best) and sum(w for _, w, _ in found) == pytest.approx(best)
        assert all(len(all_paths(stages, [c for c, _ in x])) == 1 for x in readings)  # one reading for each row of classes


def test_toxicity_of_held_out_documents(spark):
    docs_, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_query(spark, "/root/testdata/sf0.1").where("held_out").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.join(docs_, "doc_id", "left_semi").collect() if r["doc_id"] in out}
    toxic = [i for i, y in truth.items() if y == 1]
    assert sum(out[i] for i in toxic) >= 0.85 * len(toxic) and sum(out[i] for i, y in truth.items() if y == 0) <= 0.01 * len(truth)


def test_kernel_by_sets():
    """Presence kernels and regression values against sets of buckets counted one by one."""
    texts = ["Der Hund schläft.", "the dog sleeps", "le chien dort", "the cat; the dog", "ab", "12 a"]

    def grams(t):
        clean = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        out = set()
        for n in range(1, 4):
            for i in range(len(clean) - n + 1):
                out.add(clean[i : i + n])
        return out

    spectra = [langid.spectrum(t) for t in texts]
    for t, s in zip(texts, spectra, strict=True):
        padded = " " + re.sub(r"[\W\d_]+", " ", t.lower()) + " "
        assert abs(int(s.sum()) - len({padded[i : i + n] for n in range(1, 4) for i in range(len(padded) - n + 1)})) <= 1  # buckets may be shared
        assert grams(t) <= {padded[i : i + n] for n in range(1, 4) for i in range(len(padded) - n + 1)}
    rows = [("x", s) for s in spectra[:3]] + [("y", s) for s in spectra[3:]]
    model = langid.fit(rows, ["x", "y"], landmarks=2)
    marks = [set(np.flatnonzero(s)) for s in (*spectra[:2], *spectra[3:5])]
    for s in spectra:
        own = set(np.flatnonzero(s))
        k = np.array([len(own & m) / np.sqrt(len(own) * len(m)) for m in marks] + [1.0])
        assert np.allclose(k @ model.weights, model.values([s])[0], atol=1e-5)


def test_alignment_by_brute_force():
    """Aligned places increase and hold equal words; no fewer than the anchors that a plain search for them gives; never more than a longest common subsequence."""
    r = random.Random(21)
    for _ in range(200):
        a, b = [r.randint(0, 12) for _ in range(r.randint(0, 14))], [r.randint(0, 12) for _ in range(r.randint(0, 14))]
        got = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(got) <= lcs[-1][-1]
        values = [r.randint(0, 20) for _ in range(r.randint(0, 10))]
        best = max((len(x) for n in range(1 << len(values)) for x in [[v for k, v in enumerate(values) if n >> k & 1]] if all(p < q for p, q in zip(x, x[1:]))), default=0)
        assert len(license_scan.longest_increasing(values)) == best


def test_planted_licenses(spark):
    """Whole texts and notices, some words changed, between random words: all are found where they stand, nothing else is."""
    r = random.Random(22)
    rows, want = [], {}
    for i in range(40):
        words, places = prose(300 + i, 50).split(), []
        for _ in range(r.randint(0, 3)):
            name, text = license_scan.TEMPLATES[r.randrange(len(license_scan.TEMPLATES))]
            w = [x.decode() for x in decontam.words_of(text)]
            if len(w) > 40:
                w[r.randrange(5, len(w) - 5)] = "changedword"
            places.append((name, len(words), len(words) + len(w)))
            words += w + prose(r.random(), 60).split()
        rows.append((i, " ".join(words)))
        want[i] = places
    out = license_scan.scan_licenses(docs(spark, [*rows, (100, None), (101, ""), (102, "MIT"), (102, "MIT")])).collect()
    got = {x["doc_id"]: [(m["license"], m["start"], m["end"]) for m in x["licenses"]] for x in out}
    for i, places in want.items():  # an end may lack what follows the last anchor, a tenth of the template at most
        assert [a for _, a, _ in places] == [a for _, a, _ in got[i]]
        assert all(b - 0.1 * (b - a) <= end <= b for (_, a, b), (_, _, end) in zip(places, got[i], strict=True))
    assert sum(g[0] == w[0] for i in want for g, w in zip(got[i], want[i])) >= 0.9 * sum(map(len, want.values()))  # notices that are nearly alike share words
    assert got[100] == got[101] == got[102] == [] and license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_warc_on_odd_rows(spark, tmp_path):
    kind = "page_id long, url string, html string, member string, path string, at string, payload string"
    rows = [(1, "u", "same"), (1, "u", "same"), (2, None, "same"), (None, "n", "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 2_000_000)]
    pages = spark.createDataFrame([(*x, "m", "p", "a", "y") for x in rows], kind)
    warc.write_warc(pages, f"file://{tmp_path}/odd")
    got = warc.read_warc(spark, f"file://{tmp_path}/odd").collect()
    assert len(got) == len(rows) and sorted(r["payload_bytes"] for r in got) == [0, 0, 4, 4, 4, 4, 2_000_000]
    # the smallest id's rows are all responses, and so is a row of no id
    assert sum(r["record_type"] == "response" for r in got) == 5 and {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {1, 3}
    warc.write_warc(spark.createDataFrame([], kind), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_pages_on_odd_rows(spark):
    net = html_text.trained()
    long = "<article>" + "".join(f"<p>{prose(k, 40).capitalize()}.</p>" for k in range(2500)) + "</article>"
    kind = "page_id long, url string, html string, text string, n_chars string"
    out = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame([(1, None, None, "t", "n"), (2, "u", long, None, None), (None, "u", "<p>", "", "")], kind), net=net).collect()}
    assert out[1]["text"] == "" and out[None]["text"] == "" and out[2]["n_chars"] == len(out[2]["text"]) and out[2]["text"].count("\n") > 2000
    assert html_text.extract(spark.createDataFrame([], kind), net=net).count() == 0
