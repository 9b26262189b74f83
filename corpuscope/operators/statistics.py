"""The index and its statistics: postings, terms, documents, corpus, labels, incremental maintenance, spelling candidates."""

from __future__ import annotations

from corpuscope.plans.dialect import Dialect
from corpuscope.plans.relations import WORD, WORD_HYPHEN


def _doc_stats(d: Dialect) -> str:
    """Per document and field: characters, words, index terms, distinct terms."""
    fields = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {f} AS t FROM docs" for f in ("title", "abstract", "body"))
    return f"""SELECT f.doc_id, f.field, CAST(length(f.t) AS BIGINT) AS characters, CAST({d.size(d.all("f.t", WORD))} AS BIGINT) AS words, CAST({d.size(d.all("f.t", WORD_HYPHEN))} AS BIGINT) AS words_hyphen_merged,
      coalesce(p.n, 0) AS index_terms, coalesce(p.u, 0) AS unique_terms FROM ({fields}) AS f LEFT JOIN (SELECT doc_id, field, CAST(sum(tf) AS BIGINT) AS n, count(*) AS u FROM field_postings GROUP BY doc_id, field) AS p ON p.doc_id = f.doc_id AND p.field = f.field"""


def _doc_totals(d: Dialect) -> str:
    return f"""SELECT t.doc_id, t.tokens, t.stop_words, coalesce(l.length, 0) AS index_terms, coalesce(l.n_terms, 0) AS unique_terms, round(CASE WHEN l.length > 0 THEN CAST(l.n_terms AS DOUBLE) / l.length ELSE 0e0 END, 6) AS lexical_diversity,
      w.words, round(w.chars / CAST(greatest(w.words, 1) AS DOUBLE), 6) AS avg_word_length FROM (SELECT doc_id, count(*) AS tokens, count(CASE WHEN term IS NULL THEN 1 END) AS stop_words FROM tok GROUP BY doc_id) AS t
      LEFT JOIN doc_len l ON l.doc_id = t.doc_id JOIN (SELECT doc_id, CAST({d.size(d.all("text", WORD))} AS BIGINT) AS words, CAST(length(text) - length({d.sub("text", WORD, "")}) AS BIGINT) AS chars FROM documents) AS w ON w.doc_id = t.doc_id"""


def _corpus(d: Dialect) -> str:
    return f"""SELECT n.n AS documents, w.characters, w.words, round(w.words / CAST(n.n AS DOUBLE), 6) AS avg_words, v.vocabulary, v.index_terms FROM n_docs n
      JOIN (SELECT CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum({d.size(d.all("text", WORD))}) AS BIGINT) AS words FROM documents) AS w ON 1 = 1
      JOIN (SELECT count(*) AS vocabulary, CAST(sum(cf) AS BIGINT) AS index_terms FROM term_stats) AS v ON 1 = 1"""


def _histogram(d: Dialect) -> str:
    bucket = "CASE WHEN df = 1 THEN '1' WHEN df < 10 THEN '2-9' WHEN df < 100 THEN '10-99' WHEN df < 1000 THEN '100-999' ELSE '1000+' END"
    return f"SELECT {bucket} AS bucket, count(*) AS terms, CAST(sum(cf) AS BIGINT) AS cf, {d.median('max_tf')} AS median_max_tf FROM term_stats GROUP BY {bucket}"


def _upsert(d: Dialect) -> str:
    """Term statistics after every tenth document is deleted and every seventh replaced by its title alone."""
    return """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM
      (SELECT p.term, p.doc_id, p.tf FROM postings p WHERE p.doc_id % 10 <> 0 AND p.doc_id % 7 <> 0
       UNION ALL SELECT f.term, f.doc_id, f.tf FROM field_postings f WHERE f.field = 'title' AND f.doc_id % 10 <> 0 AND f.doc_id % 7 = 0) AS x GROUP BY term"""


def _surface(d: Dialect) -> str:
    if d.name == "spark":
        return "SELECT word, cf FROM surface_counts"
    return f"SELECT surface AS word, count(*) AS cf FROM tok WHERE length(surface) > 1 AND NOT {d.rx('surface', '^[0-9]+$')} GROUP BY surface"


def _top_terms(d: Dialect) -> str:
    if d.name == "spark":
        return "SELECT doc_id, term, tf, rank FROM top_terms"
    return "SELECT doc_id, term, tf, rank FROM (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM postings) AS x WHERE rank <= 15"


def _candidates(d: Dialect) -> str:
    """Words within two edits of three misspelt words: the lossless length filter, then the distance."""
    asked = " UNION ALL ".join(f"SELECT '{w}' AS asked" for w in ("tionable", "ofreshd", "menteux"))
    return f"SELECT a.asked, s.word, CAST({d.lev('a.asked', 's.word')} AS BIGINT) AS distance, s.cf FROM ({_surface(d)}) AS s JOIN ({asked}) AS a ON abs(length(s.word) - length(a.asked)) <= 2 WHERE {d.lev('a.asked', 's.word')} <= 2"


def _levenshtein(d: Dialect) -> str:
    """Distance of every benchmark item's first word from the next item's."""
    first = f"SELECT item_id, lower(split_part(text, ' ', 1)) AS w FROM benchmark"
    return f"SELECT a.item_id, a.w AS a, b.w AS b, CAST({d.lev('a.w', 'b.w')} AS BIGINT) AS distance FROM ({first}) AS a JOIN ({first}) AS b ON b.item_id = a.item_id + 1"


def _topics(d: Dialect) -> str:
    """Documents by topic and split, and how many have that topic clean."""
    split = "CASE WHEN d.doc_id % 4 = 0 THEN 'test' ELSE 'train' END"
    return f"SELECT d.lang AS topic, {split} AS split, count(*) AS documents, count(CASE WHEN l.toxic = 0 THEN 1 END) AS clean, count(DISTINCT d.source) AS sources FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang, {split}"


QUERIES = {
    "a1_postings": lambda d: f"SELECT term, doc_id, tf, first_pos, in_title, positions FROM {'positions' if d.name == 'spark' else 'postings'}",
    "a2_term_stats": lambda d: "SELECT term, df, cf, max_tf FROM term_stats",
    "a2_field_averages": lambda d: "SELECT field, round(avg_len, 6) AS avg_len FROM field_avg",
    "a3_vocab_prefix": lambda d: f"SELECT term, cf, df FROM term_stats WHERE {d.starts('term', 'the')} ORDER BY cf DESC, term LIMIT 50",
    "a4_doc_fields": _doc_stats,
    "a4_doc_totals": _doc_totals,
    "a4_top_terms": _top_terms,
    "a5_corpus_stats": _corpus,
    "a7_df_histogram": _histogram,
    "a16_surface_vocab": _surface,
    "a19_topic_stats": _topics,
    "s14_upsert_delete": _upsert,
    "r22_candidates": _candidates,
    "t14_levenshtein": _levenshtein,
}
