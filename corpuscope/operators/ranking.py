"""Boolean retrieval, BM25, TF-IDF and count ranking, and the vector-space model."""

from __future__ import annotations

from corpuscope.operators.query_language import docs_sql, search_sql
from corpuscope.plans.dialect import Dialect
from corpuscope.plans.relations import TOKEN
from corpuscope.plans.tokens import Made, words_there

TF_VARIANTS = {"n": "CAST({tf} AS DOUBLE)", "l": "(1e0 + ln({tf}))", "a": "(0.5e0 + 0.5e0 * {tf} / greatest({max}, 1))", "b": "1e0"}
DF_VARIANTS = {"n": "1e0", "t": "ln(CAST({n} AS DOUBLE) / {df})", "p": "CASE WHEN {df} < {n} THEN greatest(0e0, ln(({n} - {df}) / CAST({df} AS DOUBLE))) ELSE 0e0 END"}
#: Named weightings: tf, df, norm.
SCHEMES = ("nnn", "lnn", "btn", "ntn", "ltn", "nnc", "lnc", "ntc", "ltc", "atc", "lpc")


def parse_scheme(scheme: str) -> tuple[str, str, str]:
    s = (scheme or "ltc").strip().lower()
    if s == "bm25":
        return "bm25", "", ""
    if len(s) != 3 or s[0] not in TF_VARIANTS or s[1] not in DF_VARIANTS or s[2] not in "nc":
        raise ValueError(f"no such weighting: {scheme}")
    return s[0], s[1], s[2]


def weights_sql(scheme: str, tf_table: str = "vsm_tf") -> str:
    """(doc_id, term, w) of a scheme; terms of zero df weight are dropped, c divides by the document's length."""
    t, f, norm = parse_scheme(scheme)
    w = f"{TF_VARIANTS[t].format(tf='p.tf', max='d.max_tf')} * {DF_VARIANTS[f].format(n='n.n', df='s.df')}"
    raw = f"SELECT p.doc_id, p.term, {w} AS w FROM {tf_table} p JOIN vsm_term s ON s.term = p.term JOIN vsm_doc d ON d.doc_id = p.doc_id JOIN n_docs n ON 1 = 1 WHERE {DF_VARIANTS[f].format(n='n.n', df='s.df')} <> 0e0"
    if norm == "n":
        return raw
    return f"SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM ({raw}) AS r"


def query_weights_sql(scheme: str = "nnc") -> str:
    """(item_id, term, w) of every benchmark text."""
    t, f, norm = parse_scheme(scheme)
    if t == "bm25":
        t, f, norm = "n", "n", "c"
    w = f"{TF_VARIANTS[t].format(tf='q.tf', max='q.max_tf')} * {DF_VARIANTS[f].format(n='n.n', df='s.df')}"
    raw = f"SELECT q.item_id, q.term, {w} AS w FROM (SELECT item_id, term, tf, max(tf) OVER (PARTITION BY item_id) AS max_tf FROM query_tf) AS q JOIN vsm_term s ON s.term = q.term JOIN n_docs n ON 1 = 1"
    raw = f"SELECT * FROM ({raw}) AS r WHERE w <> 0e0"
    return raw if norm == "n" else f"SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM ({raw}) AS r"


def rank_sql(scheme: str = "ltc", qscheme: str = "nnc", k: int = 10) -> str:
    """Top k of every benchmark text: sum of query weight times document weight, by (score descending, doc_id)."""
    if scheme == "bm25":
        part = "q.tf * ln(1 + (n.n - s.df + 0.5e0) / (s.df + 0.5e0)) * p.tf * 2.2e0 / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * d.length / greatest(a.avg_len, 1e0)))"
        scored = f"SELECT q.item_id, p.doc_id, sum({part}) AS score, count(*) AS matched FROM query_tf q JOIN vsm_tf p ON p.term = q.term JOIN vsm_term s ON s.term = q.term JOIN vsm_doc d ON d.doc_id = p.doc_id JOIN n_docs n ON 1 = 1 JOIN vsm_avg a ON 1 = 1 GROUP BY q.item_id, p.doc_id"
    else:
        scored = f"SELECT q.item_id, w.doc_id, sum(q.w * w.w) AS score, count(*) AS matched FROM ({query_weights_sql(qscheme)}) AS q JOIN ({weights_sql(scheme)}) AS w ON w.term = q.term GROUP BY q.item_id, w.doc_id"
    return f"SELECT item_id, doc_id, round(score, 6) AS score, matched, rank FROM (SELECT item_id, doc_id, score, matched, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({scored}) AS s) AS z WHERE rank <= {k}"


def relations(d: Dialect) -> list[tuple[str, str]]:
    """The vector-space collection: title and abstract of every document; benchmark texts are the queries."""
    listed = f"SELECT item_id, {d.all('lower(text)', TOKEN)} AS w FROM benchmark"
    return [
        ("query_listed", listed),
        ("query_tok", d.posexplode("item_id", "query_listed", "w", "pos", "surface")),
        # in Spark the words of the texts alone are looked for in the documents
        *([("query_words", "SELECT DISTINCT surface AS word FROM query_tok"), ("query_words_there", Made("SELECT doc_id, text, w FROM listed", lambda index, listed: words_there(index, listed, "query_words"), ("query_words",), stored=False)), ("query_stem_dim", "SELECT DISTINCT word, stem FROM query_words_there")] if d.name == "spark" else []),
        ("query_tf", f"SELECT q.item_id, s.stem AS term, count(*) AS tf FROM query_tok q JOIN {'query_stem_dim' if d.name == 'spark' else 'stem_dim'} s ON s.word = q.surface LEFT JOIN stop p ON p.word = q.surface WHERE p.word IS NULL GROUP BY q.item_id, s.stem"),
        ("vsm_tf", "SELECT doc_id, term, tf_title + tf_abstract AS tf FROM doc_terms WHERE tf_title + tf_abstract > 0" if d.name == "spark" else "SELECT doc_id, term, count(*) AS tf FROM hits WHERE field IN ('title', 'abstract') GROUP BY doc_id, term"),
        ("vsm_term", "SELECT term, df_v AS df, cf_v AS cf, max_v AS max_tf, cf_v / CAST(df_v AS DOUBLE) AS mean_tf FROM vsm_parts" if d.name == "spark" else "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf, avg(tf) AS mean_tf FROM vsm_tf GROUP BY term"),
        ("vsm_doc", "SELECT doc_id, n_v AS length, max_v AS max_tf, d_v AS n_terms FROM doc_sizes WHERE n_v > 0" if d.name == "spark" else "SELECT doc_id, CAST(sum(tf) AS BIGINT) AS length, max(tf) AS max_tf, count(*) AS n_terms FROM vsm_tf GROUP BY doc_id"),
        ("vsm_avg", "SELECT CAST(coalesce(sum(d.length), 0) AS DOUBLE) / max(n.n) AS avg_len FROM vsm_doc d JOIN n_docs n ON 1 = 1"),
    ]


def _bm25(d: Dialect) -> str:
    part = "ln(1 + (c.n - s.df + 0.5e0) / (s.df + 0.5e0)) * p.tf * 2.5e0 / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * l.length / greatest(c.avg_len, 1e0))) * CASE WHEN p.in_title = 1 THEN 1.25e0 ELSE 1e0 END"
    return f"""SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
      (SELECT q.item_id, p.doc_id, sum({part}) AS score FROM (SELECT DISTINCT item_id, term FROM query_tf) AS q JOIN postings p ON p.term = q.term JOIN term_stats s ON s.term = p.term
       JOIN doc_len l ON l.doc_id = p.doc_id JOIN corpus c ON 1 = 1 GROUP BY q.item_id, p.doc_id) AS x) AS z WHERE rank <= 10"""


def _field_scores(d: Dialect) -> str:
    part = "ln(1 + (c.n - s.df + 0.5e0) / (s.df + 0.5e0)) * p.tf * 2.5e0 / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * l.length / greatest(a.avg_len, 1e0)))"
    return f"""SELECT p.doc_id, round(coalesce(sum(CASE WHEN p.field = 'title' THEN {part} END), 0e0), 6) AS title, round(coalesce(sum(CASE WHEN p.field = 'abstract' THEN {part} END), 0e0), 6) AS abstract,
      round(coalesce(sum(CASE WHEN p.field = 'body' THEN {part} END), 0e0), 6) AS body FROM field_postings p JOIN {d.stems} w ON w.stem = p.term AND w.word IN ('nd', 'ing') JOIN term_stats s ON s.term = p.term
      JOIN field_len l ON l.doc_id = p.doc_id AND l.field = p.field JOIN field_avg a ON a.field = p.field JOIN corpus c ON 1 = 1 GROUP BY p.doc_id"""


def _match_map(d: Dialect) -> str:
    """Hits of two words in 40 bins of a document: 4 over the title, 8 over the abstract, 28 over the body."""
    return f"""SELECT doc_id, bin, count(*) AS n FROM (SELECT h.doc_id, CASE h.field WHEN 'title' THEN CAST(floor(h.pos * 4e0 / r.nt) AS BIGINT)
        WHEN 'abstract' THEN 4 + CAST(floor((h.pos - r.nt) * 8e0 / r.na) AS BIGINT) ELSE 12 + CAST(floor((h.pos - r.nt - r.na) * 28e0 / r.nb) AS BIGINT) END AS bin
      FROM hits h JOIN {d.stems} w ON w.stem = h.term AND w.word IN ('nd', 'ing') JOIN
      (SELECT doc_id, count(CASE WHEN field = 'title' THEN 1 END) AS nt, count(CASE WHEN field = 'abstract' THEN 1 END) AS na, count(CASE WHEN field = 'body' THEN 1 END) AS nb FROM tok GROUP BY doc_id) AS r ON r.doc_id = h.doc_id) AS b GROUP BY doc_id, bin"""


def _contributions(d: Dialect) -> str:
    return f"SELECT q.item_id, w.doc_id, q.term, round(q.w, 6) AS qw, round(w.w, 6) AS dw, round(q.w * w.w, 6) AS part FROM ({query_weights_sql()}) AS q JOIN ({weights_sql('ltc')}) AS w ON w.term = q.term"


def _doc_vector(d: Dialect) -> str:
    """Every document's ten heaviest terms with their share of the squared length."""
    return f"SELECT doc_id, term, round(w, 6) AS w, round(share, 6) AS share, rank FROM (SELECT doc_id, term, w, w * w / sum(w * w) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM ({weights_sql('ltc')}) AS v) AS z WHERE rank <= 10"


def _term_rows(d: Dialect) -> str:
    return "SELECT s.term, s.cf, s.df, round(s.df / CAST(n.n AS DOUBLE), 6) AS df_ratio, round(ln(CAST(n.n AS DOUBLE) / s.df), 6) AS idf, round(CASE WHEN s.df < n.n THEN greatest(0e0, ln((n.n - s.df) / CAST(s.df AS DOUBLE))) ELSE 0e0 END, 6) AS prob_idf, s.max_tf, round(s.mean_tf, 6) AS mean_tf FROM vsm_term s JOIN n_docs n ON 1 = 1"


def _label_rules(d: Dialect) -> str:
    """Documents of which every group of patterns hits a label; grade 2 if the document is not toxic by its label."""
    both = " UNION ALL ".join(f"SELECT {g} AS grp, {d.lit(p)} AS pattern" for g, p in ((1, "^src1"), (1, "^src2$"), (2, "^(de|fr)$"), (2, "^es$")))
    hit = " OR ".join(f"(r.pattern = {d.lit(p)} AND {d.rx('v.label', p)})" for p in ("^src1", "^src2$", "^(de|fr)$", "^es$"))
    return f"""SELECT m.doc_id, CASE WHEN coalesce(l.toxic, 1) = 0 THEN 2 ELSE 1 END AS grade FROM (SELECT v.doc_id FROM
      (SELECT doc_id, lang AS label FROM documents UNION ALL SELECT doc_id, source AS label FROM documents) AS v JOIN ({both}) AS r ON {hit} GROUP BY v.doc_id HAVING count(DISTINCT r.grp) = 2) AS m LEFT JOIN labels l ON l.doc_id = m.doc_id"""


BOOLEAN = {
    "q3_term": "hendnt",
    "q5_field": "title:nd",
    "q6_phrase": '"onlyhe this atshsh"',
    "q6_phrase_stopword_gap": '"ing and the re"',
    "q7_prefix": "thane*",
    "q4_compound": "ing-re",
    "q9_and": "nd AND ing AND ble",
    "q10_or": "hendnt OR thanedble",
    "q11_not": "NOT nd",
    "q9_nested": '(nd OR ung) AND (ing OR sch) -ble "er"',
    "q9_implicit": "body:nd title:re",
}
RANKED = {
    "r2_tfidf": ("nd ing ble", "tfidf", "OR", "all"),
    "r3_count": ("nd ing ble", "count", "OR", "all"),
    "r4_title_boost": ("title:nd OR ing", "bm25", "AND", "all"),
    "r6_scope_abstract": ("nd ing", "bm25", "OR", "abstract"),
    "r6_ranked_boolean": ("nd AND (ing OR ble) NOT hendnt", "bm25", "AND", "all"),
}

QUERIES = {n: (lambda d, q=q: docs_sql(d, q)) for n, q in BOOLEAN.items()}
QUERIES |= {n: (lambda d, a=a: search_sql(d, a[0], a[1], a[2], a[3])) for n, a in RANKED.items()}
QUERIES |= {
    "r1_bm25": _bm25, "r5_field_scores": _field_scores, "r8_match_map": _match_map, "q16_label_rules": _label_rules,
    "r14_vsm_bm25": lambda d: rank_sql("bm25"), "r15_rank_ltc": lambda d: rank_sql("ltc"), "r15_contributions": _contributions,
    "r12_doc_vector": _doc_vector, "a6_term_rows": _term_rows,
}
QUERIES |= {f"r11_weights_{s}": (lambda d, s=s: f"SELECT doc_id, term, round(w, 6) AS w FROM ({weights_sql(s)}) AS x") for s in SCHEMES}
QUERIES["r13_query_vectors"] = lambda d: f"SELECT item_id, term, round(w, 6) AS w FROM ({query_weights_sql('ltc')}) AS x"
