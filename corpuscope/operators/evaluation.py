"""Ranked-retrieval evaluation: runs of two weightings for every benchmark text against grades from labels."""

from __future__ import annotations

from corpuscope.operators import ranking
from corpuscope.plans.dialect import Dialect

DEPTH = 20


def relations(d: Dialect) -> list[tuple[str, str]]:
    """run(run_id, item_id, doc_id, rank), grades(doc_id, grade): labels judge a document once for all texts."""
    run = lambda name, scheme: f"SELECT '{name}' AS run_id, item_id, doc_id, score, rank FROM ({ranking.rank_sql(scheme, k=DEPTH)}) AS r_{name}"
    return [
        *ranking.relations(d),
        ("run", f"{run('a', 'ltc')} UNION ALL {run('b', 'bm25')}"),
        ("grades", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM labels"),
        ("judged", "SELECT r.run_id, r.item_id, r.doc_id, r.rank, coalesce(g.grade, 0) AS grade FROM run r LEFT JOIN grades g ON g.doc_id = r.doc_id"),
        ("relevant", "SELECT count(*) AS n FROM grades WHERE grade > 0"),
        ("condensed", "SELECT r.run_id, r.item_id, r.doc_id, row_number() OVER (PARTITION BY r.run_id, r.item_id ORDER BY r.rank) AS rank, g.grade FROM run r JOIN grades g ON g.doc_id = r.doc_id"),
        ("measures", _measures("judged")),
        ("changes", f"SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.rank, 0) AS rank_a, coalesce(b.rank, 0) AS rank_b FROM (SELECT * FROM run WHERE run_id = 'a') AS a FULL OUTER JOIN (SELECT * FROM run WHERE run_id = 'b') AS b ON a.item_id = b.item_id AND a.doc_id = b.doc_id"),
    ]


def _measures(run: str) -> str:
    """Per run and text: P@5 and 10, R@10, R-precision, reciprocal rank, average precision, nDCG@10."""
    seen = f"SELECT j.*, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM {run} j"
    ideal = "SELECT sum((power(2e0, grade) - 1) / log2(rank + 1e0)) AS dcg FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC) AS rank FROM (SELECT grade FROM grades WHERE grade > 0 ORDER BY grade DESC LIMIT 10) AS g) AS i"
    return f"""SELECT s.run_id, s.item_id, sum(CASE WHEN s.grade > 0 AND s.rank <= 5 THEN 1 ELSE 0 END) / 5e0 AS p5, sum(CASE WHEN s.grade > 0 AND s.rank <= 10 THEN 1 ELSE 0 END) / 10e0 AS p10,
      coalesce(sum(CASE WHEN s.grade > 0 AND s.rank <= 10 THEN 1 ELSE 0 END) / CAST(max(r.n) AS DOUBLE), 0e0) AS r10,
      coalesce(sum(CASE WHEN s.grade > 0 AND s.rank <= r.n THEN 1 ELSE 0 END) / CAST(max(r.n) AS DOUBLE), 0e0) AS r_precision,
      coalesce(1e0 / min(CASE WHEN s.grade > 0 THEN s.rank END), 0e0) AS rr, coalesce(sum(CASE WHEN s.grade > 0 THEN s.hits / CAST(s.rank AS DOUBLE) ELSE 0e0 END) / max(r.n), 0e0) AS ap,
      coalesce(sum(CASE WHEN s.rank <= 10 THEN (power(2e0, s.grade) - 1) / log2(s.rank + 1e0) ELSE 0e0 END) / max(i.dcg), 0e0) AS ndcg10
      FROM ({seen}) AS s JOIN relevant r ON 1 = 1 JOIN ({ideal}) AS i ON 1 = 1 GROUP BY s.run_id, s.item_id"""


def _kendall(d: Dialect) -> str:
    """Agreement on the order of the union of both top tens; a document that a list lacks stands behind all of it."""
    rows = f"SELECT c.item_id, c.doc_id, CASE WHEN c.rank_a = 0 THEN s.big ELSE c.rank_a END AS a, CASE WHEN c.rank_b = 0 THEN s.big ELSE c.rank_b END AS b FROM changes c JOIN (SELECT item_id, max(greatest(rank_a, rank_b)) + 2 AS big FROM changes GROUP BY item_id) AS s ON s.item_id = c.item_id WHERE (c.rank_a BETWEEN 1 AND 10) OR (c.rank_b BETWEEN 1 AND 10)"
    pair = f"SELECT x.item_id, sign((x.a - y.a) * (x.b - y.b)) AS s FROM ({rows}) AS x JOIN ({rows}) AS y ON y.item_id = x.item_id AND x.doc_id < y.doc_id"
    every = "SELECT DISTINCT item_id FROM changes"  # one document alone agrees with itself
    return f"SELECT e.item_id, round(CASE WHEN count(CASE WHEN p.s <> 0 THEN 1 END) = 0 THEN 1e0 ELSE sum(CAST(p.s AS DOUBLE)) / count(CASE WHEN p.s <> 0 THEN 1 END) END, 6) AS tau FROM ({every}) AS e LEFT JOIN ({pair}) AS p ON p.item_id = e.item_id GROUP BY e.item_id"


QUERIES = {
    "e1_precision_recall": lambda d: "SELECT run_id, item_id, p5, p10, round(r10, 6) AS r10, round(r_precision, 6) AS r_precision FROM measures",
    "e2_rr": lambda d: "SELECT run_id, item_id, round(rr, 6) AS rr FROM measures",
    "e3_ap": lambda d: "SELECT run_id, item_id, round(ap, 6) AS ap FROM measures",
    "e4_ndcg": lambda d: "SELECT run_id, item_id, round(ndcg10, 6) AS ndcg10 FROM measures",
    "e5_condensed": lambda d: f"SELECT run_id, item_id, p5, p10, round(rr, 6) AS rr, round(ap, 6) AS ap, round(ndcg10, 6) AS ndcg10 FROM ({_measures('condensed')}) AS m",
    "e6_means_grouping_sets": lambda d: "SELECT coalesce(run_id, 'all') AS run_id, coalesce(CAST(kind AS VARCHAR(9)), 'all') AS kind, count(*) AS n, round(avg(p10), 6) AS p10, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(ndcg10), 6) AS ndcg10 FROM (SELECT m.*, item_id % 4 AS kind FROM measures m) AS k GROUP BY GROUPING SETS ((), (run_id), (run_id, kind))",
    "e7_overlap": lambda d: "SELECT item_id, count(CASE WHEN rank_a BETWEEN 1 AND 5 AND rank_b BETWEEN 1 AND 5 THEN 1 END) / 5e0 AS overlap5, count(CASE WHEN rank_a BETWEEN 1 AND 10 AND rank_b BETWEEN 1 AND 10 THEN 1 END) / 10e0 AS overlap10 FROM changes GROUP BY item_id",
    "e7_kendall": _kendall,
    "e7_rank_changes": lambda d: "SELECT item_id, doc_id, rank_a, rank_b FROM changes WHERE (rank_a BETWEEN 1 AND 10) OR (rank_b BETWEEN 1 AND 10)",
    "e8_rule_qrels": ranking._label_rules,
    "e9_topic_qrels": lambda d: "SELECT d.lang AS topic, d.doc_id, CASE WHEN l.toxic = 0 THEN 2 ELSE 1 END AS grade FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    "a24_qrels_summary": lambda d: "SELECT x.lang AS topic, count(*) AS judged, count(CASE WHEN g.grade = 2 THEN 1 END) AS grade2, count(CASE WHEN g.grade = 1 THEN 1 END) AS grade1 FROM grades g JOIN documents x ON x.doc_id = g.doc_id GROUP BY x.lang",
}
