"""Zipf statistics: collection and document frequencies under five conditions, fits, zones, resolving power, stem groups."""

from __future__ import annotations

from corpuscope.plans.dialect import Dialect

#: A: white space; B: runs of letters and digits; C: B without stop words; D: C stemmed; E: B stemmed.
CONDITIONS = ("A", "B", "C", "D", "E")

# Thresholds of the map of collection against document frequency.
MAP = {"common_df": 0.85, "boiler_df": 0.25, "boiler_burst": 1.3, "topic_df": 0.15, "topic_burst": 1.3, "key_df": 0.05, "key_burst": 3.0}
#: The running median spans this factor of a rank to both sides, and so many ranks at least.
SPAN, SPAN_LEAST = 10**0.15, 4


def condition_sql(d: Dialect, condition: str) -> str:
    """(doc_id, term) of every token under a condition."""
    if condition == "A":
        listed = f"SELECT doc_id, {d.all('lower(text)', d.words_a)} AS w FROM documents"
        return f"SELECT doc_id, term FROM ({d.posexplode('doc_id', f'({listed}) AS l', 'w', 'pos', 'term')}) AS x"
    return {
        "B": "SELECT doc_id, surface AS term FROM tok",
        "C": "SELECT doc_id, surface AS term FROM tok WHERE term IS NOT NULL",
        "D": "SELECT doc_id, term FROM tok WHERE term IS NOT NULL",
        "E": "SELECT doc_id, stem AS term FROM tok",
    }[condition]


def _counts(d: Dialect) -> str:
    """(condition, term, cf, df) in Spark, from the counted words."""
    own = {"A": "term, cf, df FROM raw_parts", "B": "word, cf, df FROM word_parts", "C": "word, cf, df FROM word_parts WHERE NOT stop", "D": "term, cf, df FROM term_parts WHERE df > 0", "E": "term, n_all, df_all FROM term_parts"}
    return " UNION ALL ".join(f"SELECT '{c}' AS condition, {q.replace(',', ' AS term,', 1).replace('n_all, df_all', 'n_all AS cf, df_all AS df')}" for c, q in own.items())


def _ranks(name: str, counts: str) -> list[tuple[str, str]]:
    """(condition, term, cf, df, rank) of a relation of counts, and what it is made of."""
    return [
        (f"{name}_groups", f"SELECT condition, cf, substr(term, 1, 2) AS head, count(*) AS n FROM {counts} GROUP BY condition, cf, substr(term, 1, 2)"),
        (f"{name}_offsets", f"SELECT condition, cf, head, CAST(coalesce(sum(n) OVER (PARTITION BY condition ORDER BY cf DESC, head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM {name}_groups"),
        (name, f"SELECT z.condition, z.term, z.cf, z.df, o.ahead + row_number() OVER (PARTITION BY z.condition, z.cf, substr(z.term, 1, 2) ORDER BY z.term) AS rank FROM {counts} z JOIN {name}_offsets o ON o.condition = z.condition AND o.cf = z.cf AND o.head = substr(z.term, 1, 2)"),
    ]


def relations(d: Dialect) -> list[tuple[str, str]]:
    spark = d.name == "spark"
    each = " UNION ALL ".join(f"SELECT '{c}' AS condition, term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM ({condition_sql(d, c)}) AS t GROUP BY doc_id, term) AS g GROUP BY term" for c in CONDITIONS)
    return [
        ("zipf_counts", _counts(d) if spark else each),
        # a rank is what stands before a term's group (frequency, first letters), from a small histogram, and its place in the group:
        # no task sorts a whole vocabulary
        *_ranks("zipf", "zipf_counts"),
        ("zipf_logs", "SELECT condition, term, cf, df, rank, log10(CAST(rank AS DOUBLE)) AS x, log10(CAST(cf AS DOUBLE)) AS y FROM zipf"),
        ("zipf_fit", "SELECT condition, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM zipf_logs GROUP BY condition"),
        # in Spark condition C is counted and ranked by itself, and zones, which ask for no rank, read the counts of B
        *([("zipf_c_counts", "SELECT 'C' AS condition, word AS term, cf, df FROM word_parts WHERE NOT stop"), *_ranks("zipf_c", "zipf_c_counts")] if spark else []),
        ("power", "SELECT z.condition, z.term, z.cf, z.df, z.rank, log10(CAST(n.n AS DOUBLE) / z.df) AS idf, z.cf * log10(CAST(n.n AS DOUBLE) / z.df) AS power FROM zipf z JOIN n_docs n ON 1 = 1 WHERE z.condition = 'C'".replace("FROM zipf ", "FROM zipf_c " if spark else "FROM zipf ")),
        ("zone", f"SELECT 'B' AS condition, m.term, m.cf, m.df, {_zone(d)} AS zone FROM (SELECT w.word AS term, w.cf, w.df, w.df / CAST(n.n AS DOUBLE) AS spread, w.cf / CAST(w.df AS DOUBLE) AS burst FROM word_parts w JOIN n_docs n ON 1 = 1) AS m" if spark else f"SELECT m.condition, m.term, m.cf, m.df, m.rank, {_zone(d)} AS zone FROM (SELECT z.*, z.df / CAST(n.n AS DOUBLE) AS spread, z.cf / CAST(z.df AS DOUBLE) AS burst FROM zipf z JOIN n_docs n ON 1 = 1 WHERE z.condition = 'B') AS m"),
    ]


def _zone(d: Dialect) -> str:
    t = {k: f"{v}e0" for k, v in MAP.items()}
    return (
        f"CASE WHEN {d.rx('m.term', '^[0-9]+$')} THEN 'number' WHEN m.spread >= {t['common_df']} THEN 'function' WHEN m.spread >= {t['boiler_df']} AND m.burst < {t['boiler_burst']} THEN 'boilerplate' "
        f"WHEN m.spread < {t['key_df']} AND m.burst >= {t['key_burst']} AND m.df >= 2 THEN 'keyword' WHEN m.spread >= {t['topic_df']} AND m.burst >= {t['topic_burst']} THEN 'topic' ELSE 'other' END"
    )


def _fit(d: Dialect) -> str:
    return """SELECT f.condition, f.n, round(f.slope, 6) AS slope, round(f.intercept, 6) AS intercept, round(-f.slope, 6) AS exponent, round(f.r2, 6) AS r2, round(sqrt(avg((l.y - f.intercept - f.slope * l.x) * (l.y - f.intercept - f.slope * l.x))), 6) AS rmse
      FROM zipf_fit f JOIN zipf_logs l ON l.condition = f.condition GROUP BY f.condition, f.n, f.slope, f.intercept, f.r2"""


def _summary(d: Dialect) -> str:
    return "SELECT z.condition, CAST(sum(z.cf) AS BIGINT) AS tokens, count(*) AS vocabulary, round(sum(z.cf) / CAST(max(n.n) AS DOUBLE), 6) AS avg_tokens, count(CASE WHEN z.cf = 1 THEN 1 END) AS hapax, round(count(CASE WHEN z.cf = 1 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS hapax_share, round(sum(CASE WHEN z.rank <= 10 THEN z.cf ELSE 0 END) / CAST(sum(z.cf) AS DOUBLE), 6) AS top10_share FROM zipf z JOIN n_docs n ON 1 = 1 GROUP BY z.condition"


def _segments(d: Dialect) -> str:
    """Three parts of equal length on the logarithmic rank axis: own fits, and residuals of the whole curve's fit."""
    bounds = "SELECT condition, greatest(2e0, round(power(n, 1e0 / 3))) AS a, greatest(greatest(2e0, round(power(n, 1e0 / 3))) + 1, round(power(n, 2e0 / 3))) AS b FROM zipf_fit"
    part = "CASE WHEN l.rank < s.a THEN 'high' WHEN l.rank < s.b THEN 'middle' ELSE 'low' END"
    rows = f"SELECT l.condition, {part} AS segment, l.x, l.y, l.cf, l.y - f.intercept - f.slope * l.x AS e FROM zipf_logs l JOIN ({bounds}) AS s ON s.condition = l.condition JOIN zipf_fit f ON f.condition = l.condition"
    return f"SELECT condition, segment, count(*) AS n, CAST(sum(cf) AS BIGINT) AS cf, round(regr_slope(y, x), 6) AS slope, round(sqrt(avg(e * e)), 6) AS global_rmse, round(avg(e), 6) AS global_bias FROM ({rows}) AS r GROUP BY condition, segment"


def _power_zones(d: Dialect) -> str:
    """Shares of the words before, between and after two cut-off ranks (a twentieth and a half of the vocabulary's ranks)."""
    zone = "CASE WHEN p.rank < m.v / 20e0 THEN 'common' WHEN p.rank <= m.v / 2e0 THEN 'significant' ELSE 'rare' END"
    return f"SELECT {zone} AS zone, count(*) AS terms, CAST(sum(p.cf) AS BIGINT) AS cf, round(sum(p.power), 4) AS power, round(avg(p.idf), 6) AS mean_idf FROM power p JOIN (SELECT count(*) AS v FROM power) AS m ON 1 = 1 GROUP BY {zone}"


def _median_curve(d: Dialect) -> str:
    """Running median of the resolving power at thinned ranks: the first sixty, then seventy a decade."""
    thin = f"SELECT DISTINCT CASE WHEN i.i <= 60 THEN i.i ELSE CAST(floor(60 * power(10e0, (i.i - 60) / 70e0) + 1e-9) AS BIGINT) END AS r FROM ({d.series('i', '1', '480')}) AS i"
    window = f"p.rank >= greatest(1, least(t.r - {SPAN_LEAST}, CAST(floor(t.r / {SPAN:.12f}e0) AS BIGINT))) AND p.rank <= greatest(t.r + {SPAN_LEAST}, CAST(floor(t.r * {SPAN:.12f}e0) AS BIGINT))"
    if d.name == "spark":  # equal powers meet as counts, so that no window's values are gathered in a list
        counted = f"SELECT t.r, p.power, count(*) AS n FROM ({thin}) AS t JOIN (SELECT count(*) AS v FROM power) AS m ON t.r <= m.v JOIN power p ON {window} GROUP BY t.r, p.power"
        summed = f"SELECT r, power, sum(n) OVER (PARTITION BY r ORDER BY power) AS below, sum(n) OVER (PARTITION BY r) AS size FROM ({counted}) AS c"
        return f"SELECT r AS rank, round(min(power), 4) AS power FROM ({summed}) AS s WHERE below > floor(size / 2) GROUP BY r"
    return f"SELECT t.r AS rank, round({d.median('p.power')}, 4) AS power FROM ({thin}) AS t JOIN (SELECT count(*) AS v FROM power) AS m ON t.r <= m.v JOIN power p ON {window} GROUP BY t.r"


def _stem_groups(d: Dialect) -> str:
    return f"SELECT term AS stem, count(*) AS n_forms, CAST(sum(cf) AS BIGINT) AS cf, {d.join_sorted('surface', 'surface')} AS forms FROM (SELECT term, surface, count(*) AS cf FROM tok WHERE term IS NOT NULL GROUP BY term, surface) AS s GROUP BY term HAVING count(*) > 1"


QUERIES = {
    "a8_cf_df": lambda d: "SELECT condition, term, cf, df, rank FROM zipf",
    "a9_summary": _summary,
    "a10_fit": _fit,
    "a11_segments": _segments,
    "a12_cfdf_zones": lambda d: "SELECT zone, count(*) AS terms, CAST(sum(cf) AS BIGINT) AS cf, round(avg(log10(CAST(n.n AS DOUBLE) / z.df)), 6) AS mean_idf FROM zone z JOIN n_docs n ON 1 = 1 GROUP BY zone",
    "a12_zone_terms": lambda d: "SELECT term, cf, df, zone FROM zone",
    "a13_power": lambda d: "SELECT term, cf, df, rank, round(power, 4) AS power FROM power",
    "a13_zones": _power_zones,
    "a13_median_curve": _median_curve,
    "a14_poisson": lambda d: "SELECT z.term, z.cf, z.df, round(n.n * (1 - exp(-z.cf / CAST(n.n AS DOUBLE))), 4) AS poisson_df FROM zipf z JOIN n_docs n ON 1 = 1 WHERE z.condition = 'B'",
    "a15_stem_groups": _stem_groups,
    "a15_reduction": lambda d: "SELECT count(DISTINCT surface) AS words, count(DISTINCT term) AS stems, round(1 - count(DISTINCT term) / CAST(count(DISTINCT surface) AS DOUBLE), 6) AS reduction FROM tok WHERE term IS NOT NULL",
}
